"""Text normalisation as Column functions over token arrays; Python only where no built-in can say it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.stemming import stem

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Short function words left out by default, by language.
STOPWORDS = {
    "english": "a about after again all am an and any are as at be because been before being but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split(),
    "french": "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous".split(),
}


def tokenize(text: Column, lower: bool = False) -> Column:
    """Tokens by white space with punctuation at either end of a word set apart (our own contract, no treebank rules)."""
    spaced = F.regexp_replace(F.lower(text) if lower else text, r"(?<=^|[\s(\[{\"'])([(\[{\"'])|([.,;:!?)\]}\"'])(?=$|[\s.,;:!?)\]}\"'])", " $1$2 ")
    return F.filter(F.split(F.trim(spaced), r"\s+"), lambda t: t != "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _treebank(texts: pd.Series) -> pd.Series:
    word = regex.compile(r"\.\.\.|--|``|''|[\p{L}\p{N}]+(?=n't\b)|n't\b|'(?:s|m|d|re|ve|ll)\b|[\p{L}\p{N}_]+(?:[-.,'/@+][\p{L}\p{N}_]+)*|\p{P}|\p{S}", regex.I)
    return texts.map(lambda t: None if t is None else word.findall(t))


def tokenize_words(text: Column, lower: bool = False) -> Column:
    """Word tokens in the manner of treebank rules: contractions are parts, inner hyphens and points stay, other signs stand alone."""
    return _treebank(F.lower(text) if lower else text)


def identity_tokens(tokens: Column) -> Column:
    """Tokens as they are: the tokenizer of texts that are lists already."""
    return tokens


def drop_digits(tokens: Column) -> Column:
    """Digits taken out of tokens; tokens that become blank are dropped."""
    return F.filter(F.transform(tokens, lambda t: F.regexp_replace(t, r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]", "")), lambda t: F.regexp_replace(t, r"[\s\p{Z}\x0b\x85\x1c-\x1f]", "") != "")


def drop_single_letters(tokens: Column, compat: bool = False) -> Column:
    """Tokens of one letter dropped. compat: every token that is a run of consecutive letters of the alphabet (hi, no, de, st, xyz, and '') is."""
    if compat:
        return F.filter(tokens, lambda t: F.instr(F.lit(LETTERS), t) == 0)
    return F.filter(tokens, lambda t: ~t.rlike(r"^\p{L}?$"))


def drop_punctuation(tokens: Column, pattern: str = "[^0-9a-zA-Z]+", compat: bool = False) -> Column:
    """Single letters dropped, then every token split at runs of other signs (accented letters are such signs)."""
    parts = F.transform(drop_single_letters(tokens, compat), lambda t: F.split(F.trim(F.regexp_replace(t, pattern, " ")), " +"))
    return F.filter(F.flatten(parts), lambda t: t != "")


def drop_repeated_characters(tokens: Column, run: int = 3) -> Column:
    """Tokens with a run of one character at least so long are dropped; empty tokens stay."""
    return F.filter(tokens, lambda t: ~t.rlike(r"(.)\1{" + str(run - 1) + ",}"))


def drop_stopwords(tokens: Column, words: Iterable[str] = (), language: str | None = "english", min_length: int = 0) -> Column:
    """Stop words, and tokens not longer than min_length, dropped."""
    stop = sorted({*words, *(STOPWORDS[language] if language else ())})
    return F.filter(tokens, lambda t: ~t.isin(stop) & (F.length(t) > min_length))


def drop_duplicate_tokens(tokens: Column, keep: str | bool = "first") -> Column:
    """keep "first": one of each; keep False: every token that occurs more than once is dropped altogether."""
    if keep is False:
        ordered = F.array_sort(tokens)
        n = F.greatest(F.size(tokens) - 1, F.lit(0))
        again = F.zip_with(F.slice(ordered, F.lit(1), n), F.slice(ordered, F.lit(2), n), lambda a, b: F.when(a == b, a))  # equal neighbours
        return F.array_except(tokens, again)  # by hash; what is left occurs once, so the set keeps all of it in order
    return F.array_distinct(tokens)


def drop_similar_words(tokens: Column, threshold: float = 0.5) -> Column:
    """Tokens that have another one (at another position) with an edit similarity above the threshold are dropped."""

    def near(p: Column, t: Column, i: Column) -> Column:
        longest = F.greatest(F.length(p["t"]), F.length(t), F.lit(1))
        # the distance is only computed where the lengths leave it a chance
        close = (p["i"] != i) & (1 - F.abs(F.length(p["t"]) - F.length(t)) / longest > threshold)
        return F.when(close, 1 - F.levenshtein(p["t"], t) / longest > threshold).otherwise(False)

    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.filter(tokens, lambda t, i: ~F.exists(placed, lambda p: near(p, t, i)))


def drop_most_common(tokens: Column, n: int | float) -> Column:
    """The n (or that share of all tokens) most frequent tokens of a list dropped, ties by token, when it has more than 10."""
    counted = F.array_sort(F.transform(F.array_distinct(tokens), lambda w: F.struct((-F.size(F.filter(tokens, lambda t: t == w))).alias("n"), w.alias("w"))))
    top = F.lit(n) if isinstance(n, int) else F.floor(F.size(tokens) * n).cast("int")
    common = F.transform(F.slice(counted, F.lit(1), top), lambda e: e["w"])
    return F.when(F.size(tokens) > 10, F.filter(tokens, lambda t: ~F.array_contains(common, t))).otherwise(tokens)


def keep_lengths(tokens: Column, low: int, high: int, domain: Iterable[str] = ()) -> Column:
    """Tokens with low < length < high, and the domain words whatever their length."""
    domain = list(domain)
    return F.filter(tokens, lambda t: (F.length(t) > low) & (F.length(t) < high) | (t.isin(domain) if domain else F.lit(False)))


def split_domain(tokens: Column, domain: Iterable[str]) -> tuple[Column, Column]:
    """(domain words, other words) of a list."""
    domain = list(domain)
    return F.filter(tokens, lambda t: t.isin(domain)), F.filter(tokens, lambda t: ~t.isin(domain))


def n_grams(tokens: Column, n: int = 2) -> Column:
    """Runs of n tokens as arrays; none where the list is shorter."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.slice(tokens, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))


def window_of(tokens: Column, words: Iterable[str]) -> Column:
    """Mean distance over all pairs of positions of the given words; null below two of them."""
    words = list(words)
    positions = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(words), i)), lambda p: p.isNotNull())
    n = F.size(positions)
    # sum of (2 i - n + 1) p_i, with n kept out of the lambda, where it would be computed again for every element
    plain = F.aggregate(positions, F.lit(0.0), lambda a, p: a + p)
    ranked = F.aggregate(F.transform(positions, lambda p, i: p.cast("double") * i), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 1, (2 * ranked - (n - 1) * plain) / (n * (n - 1) / 2))


def mean_length(tokens: Column) -> Column:
    return F.try_divide(F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a + F.length(t)).cast("double"), F.size(tokens))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def stems(tokens: Column) -> Column:
    """Porter2 stems of lower-case English tokens."""
    return _stem(tokens)


def normalize(tokens: Column, domain: Iterable[str] = (), lower: bool = True, no_digits: bool = True, no_punctuation: bool = True, no_repeated: bool = True, no_single: bool = True, no_stopwords: bool = True, no_duplicates: bool = False, no_similar: bool = False, stop: Iterable[str] = (), compat: bool = False) -> Column:
    """The stages in their fixed order, as one expression: domain words aside, digits, punctuation, repeats, single letters,
    stop words, duplicates (every copy goes), similar words, and the domain words put back at the end."""
    domain = list(domain)
    out = F.transform(tokens, lambda t: F.lower(t)) if lower else tokens
    kept, out = split_domain(out, domain) if domain else (None, out)
    out = drop_digits(out) if no_digits else out
    out = drop_punctuation(out, compat=compat) if no_punctuation else out
    out = drop_repeated_characters(out) if no_repeated else out
    out = drop_single_letters(out, compat) if no_single else out
    out = drop_stopwords(out, stop) if no_stopwords else out
    out = drop_duplicate_tokens(out, keep=False) if no_duplicates else out
    out = drop_similar_words(out) if no_similar else out
    return F.concat(out, kept) if domain else out


def parse_tags(tags: Column) -> Column:
    """``<a><b>`` as an array."""
    return F.filter(F.split(F.regexp_replace(tags, "^<|>$", ""), "><"), lambda t: t != "")


def keep_allowed(items: Column, allowed: Iterable[str]) -> Column:
    allowed = list(allowed)
    return F.filter(items, lambda t: t.isin(allowed))


def _ratio(a: str, b: str) -> int:
    return round(100 * SequenceMatcher(None, a, b, autojunk=False).ratio()) if a or b else 0


_BETWEEN_WORDS = regex.compile(r"[^\p{L}\p{N}]+")


def _word_set(text: str) -> frozenset[str]:
    return frozenset(_BETWEEN_WORDS.sub(" ", text.lower()).split())


def token_set_ratio(a: str | None, b: str | None) -> int:
    """Likeness of two texts as word sets, 0 to 100: the best of common words, common and own words, compared with each other."""
    x, y = _word_set(a or ""), _word_set(b or "")
    if not x or not y:
        return 0
    common = x & y
    if common and (common == x or common == y):
        return 100  # the common words equal one side
    both = " ".join(sorted(common))
    left, right = (f"{both} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
    return max(_ratio(both, left) if both else 0, _ratio(both, right) if both else 0, _ratio(left, right))


def token_set_bounds(known: list[str]) -> Callable[[str], np.ndarray]:
    """A function of a text: per known text a score that ``token_set_ratio`` does not exceed, without comparing sequences.

    Matched letters are at most the common letters of both (counted), and the common words are the start of either side.
    """
    sets = [_word_set(b) for b in known]
    lengths = np.array([sum(map(len, s)) + max(0, len(s) - 1) for s in sets], float)
    sizes = np.array([len(s) for s in sets])
    letters = {c: i for i, c in enumerate(sorted({c for s in sets for w in s for c in w} | {" "}))}
    holders: dict[str, list[int]] = {}
    counts = np.zeros((len(known), len(letters)), np.int32)
    for i, s in enumerate(sets):
        for w in s:
            holders.setdefault(w, []).append(i)
        for c in " ".join(s):
            counts[i, letters[c]] += 1

    def bounds(a: str) -> np.ndarray:
        words = _word_set(a)
        mine = np.zeros(len(letters), np.int32)
        for c in " ".join(words):
            if c in letters:
                mine[letters[c]] += 1
        length = sum(map(len, words)) + max(0, len(words) - 1)
        shared, joined = np.zeros(len(known), int), np.zeros(len(known))
        for w in words:
            at = holders.get(w, [])
            shared[at] += 1
            joined[at] += len(w)
        joined += np.maximum(0, shared - 1)
        share = 2 * np.minimum(counts, mine).sum(1) / np.maximum(1, length + lengths)
        start = 2 * joined / np.maximum(1, joined + np.minimum(length, lengths))
        most = np.floor(100 * np.maximum(share, start) + 0.5 + 1e-6)
        most[(shared > 0) & ((shared == len(words)) | (shared == sizes))] = 100
        return most

    return bounds


def similarity_column(score: Callable[[str | None, str | None], float], kind: str = "int"):
    """A two-argument Python scorer as a column function (Arrow batches)."""

    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cache: dict[tuple, float] = {}
        for a, b in pairs:
            out = []
            for key in zip(a, b):
                if key not in cache:
                    if len(cache) > 100_000:
                        cache.clear()
                    cache[key] = score(*key)
                out.append(cache[key])
            yield pd.Series(out)

    run.__annotations__ = {"pairs": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def lexicon_by_target(df: DataFrame, target: str, tokens: str, share: float = 0.25) -> DataFrame:
    """target, token, n: of each target the most frequent tokens (that share of its distinct ones, at least one) that no earlier
    target has claimed; targets come in falling number of tokens, ties by name. A token goes to the first target that ranks it."""
    counts = df.select(F.col(target).alias("target"), F.explode(tokens).alias("token")).filter("target is not null").groupBy("target", "token").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("target").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"))
    ranked = counts.join(sizes, "target").withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("n"), "token")))
    kept = ranked.filter(F.col("r") <= F.greatest(F.ceil(F.col("distinct") * share), F.lit(1)))
    first = kept.groupBy("token").agg(F.min_by(F.struct("target", "n"), F.struct((-F.col("total")).alias("o"), F.col("target"))).alias("b"))
    return first.select("b.target", "token", "b.n")

