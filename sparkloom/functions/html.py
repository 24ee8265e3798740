"""HTML helpers as Arrow-batched column functions."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_to_text(text: str | None) -> str | None:
    """Text of an HTML fragment: tags dropped, entities resolved, script and style left out; null stays null."""
    if text is None:
        return None
    if "<" not in text and "&" not in text:
        return text
    parser = _Text()
    parser.feed(text)
    parser.close()
    return "".join(parser.parts)


@F.pandas_udf(T.StringType())
def _strip(texts: pd.Series) -> pd.Series:
    return texts.map(html_to_text)


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def strip_html(text: Column) -> Column:
    """HTML to plain text with a real parser (a literal ``</p>`` inside a script is no tag)."""
    return _strip(text)


def resolve_entities(text: Column) -> Column:
    """HTML entities resolved once. Only texts with an ``&`` leave the JVM."""
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)
