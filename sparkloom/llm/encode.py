"""Encoding a corpus with a public byte-level BPE tokenizer, by recursive DuckDB queries in each task.

A text is split by the tokenizer's pattern; each distinct word of a task is encoded once. New words of a batch
become token-position rows, one per byte. A recursive query joins neighbouring rows with the merge table and contracts,
in every word at once, the pair of least rank, from the left, until no pair of any word can be merged; an ordered
aggregation then gives the ids of each word. All occurrences of the least pair are contracted in one step, which is what
contracting the leftmost one again and again comes to, since a merge only makes pairs of higher rank.

The query stops after STEPS steps, after fewer where a word is longer than a group of words (LONG bytes), and goes on with the words that
are not finished, so it holds STEPS times LONG rows, or two generations of a very long word. The word cache of a task is emptied when it holds CACHE words. The merge table is
of fixed size (50,000 rows) and is the only thing broadcast.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the public pattern that splits a text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STEPS = 48
CACHE = 400_000
LONG = 1 << 16  # bytes of words encoded in one query

_STEP = """
WITH RECURSIVE t(w, pos, tok, step) AS (
  SELECT w, pos, tok, 0 FROM start
  UNION ALL
  (
    WITH near AS (SELECT w, pos, tok, step, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM t WHERE step < {steps}),
    ranked AS (
      SELECT near.*, m.rank, m.made, min(m.rank) OVER (PARTITION BY w) AS best
      FROM near LEFT JOIN merges m ON m.a = near.tok AND m.b = near.nxt
    ),
    hits AS (
      SELECT *, coalesce(rank = best, false) AS hit,
        pos - row_number() OVER (PARTITION BY w, coalesce(rank = best, false) ORDER BY pos) AS run
      FROM ranked WHERE best IS NOT NULL
    ),
    taken AS (SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, run ORDER BY pos) % 2 = 1 AS take FROM hits),
    left_over AS (SELECT *, lag(take, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone FROM taken)
    SELECT w, row_number() OVER (PARTITION BY w ORDER BY pos), CASE WHEN take THEN made ELSE tok END, step + 1
    FROM left_over WHERE NOT gone
  )
)
SELECT w, max(step) AS step, list(tok ORDER BY pos) AS ids
FROM (SELECT *, max(step) OVER (PARTITION BY w) AS last FROM t) WHERE step = last GROUP BY w ORDER BY w
"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_merges(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(id of each byte, merge table with the columns a, b, rank, made) of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary = model["vocab"]
    base = np.array([vocabulary[s] for s in byte_symbols()], np.int32)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    table = np.array([(vocabulary[a], vocabulary[b], rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)], np.int32)
    return base, table


class Encoder:
    """Encodes words by recursive queries; ``lookup`` keeps what it knows as numbers into one flat id table."""

    def __init__(self, base: np.ndarray, merges: np.ndarray) -> None:
        self.base = base
        # what does not fit goes where the executor's own spills go
        spill = os.path.join(os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0], f"duckdb-{os.getpid()}")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": spill})
        table = pa.table({n: merges[:, i] for i, n in enumerate(("a", "b", "rank", "made"))})
        self.db.register("merge_rows", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.split = regex.compile(PATTERN)
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, a group of words at a time."""
        out: list[np.ndarray] = []
        group: list[np.ndarray] = []
        size = 0
        for word in words:
            row = np.frombuffer(word.encode("utf-8"), np.uint8)
            if group and size + len(row) > LONG:
                out += self._fixpoint([self.base[g] for g in group])
                group, size = [], 0
            group.append(row)
            size += len(row)
        return out + (self._fixpoint([self.base[g] for g in group]) if group else [])

    def _fixpoint(self, tokens: list[np.ndarray]) -> list[np.ndarray]:
        done: list[np.ndarray | None] = [None] * len(tokens)
        names = list(range(len(tokens)))
        while names:
            lengths = np.array([len(t) for t in tokens])
            pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
            start = pa.table({"w": np.repeat(np.array(names, np.int32), lengths), "pos": pos, "tok": np.concatenate(tokens)})
            self.db.register("start", start)
            steps = max(1, min(STEPS, STEPS * LONG // max(1, int(lengths.sum()))))
            found = self.db.sql(_STEP.format(steps=steps)).to_arrow_table()
            self.db.unregister("start")
            ids = found["ids"].combine_chunks()
            values, offsets = ids.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())]
            again, rest = [], []
            for i, (w, step) in enumerate(zip(found["w"].to_pylist(), found["step"].to_pylist())):
                part = values[offsets[i] : offsets[i + 1]].astype(np.int32)
                if step < steps:
                    done[w] = part
                else:
                    again.append(w)
                    rest.append(part)
            names, tokens = again, rest
        return done

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets): null and empty texts have no ids."""
        if len(self.code) > CACHE:
            self.clear()
        words = [self.split.findall(t) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in self.code]
        if new:
            made = self.encode_words(new)
            at = len(self.code)
            self.code.update(zip(new, range(at, at + len(new))))
            lengths = np.array([len(m) for m in made], np.int64)
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(lengths) - lengths]
            self.length = np.r_[self.length, lengths]
            self.flat = np.concatenate([self.flat, *made]).astype(np.int32)
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(words)), np.int64)
        per_word = self.length[codes]
        ends = np.r_[0, np.cumsum(per_word)]
        flat = self.flat[np.repeat(self.start[codes] - ends[:-1], per_word) + np.arange(ends[-1])]
        return flat, ends[np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)]


def _with_encoder(df: DataFrame, text: str, path: str, make, schema: str) -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(read_merges(path))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            if encoder is None:
                encoder = Encoder(*model.value)
            at = batch.schema.get_field_index(text)
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                yield make(part, *encoder.encode(part.column(at).to_pylist()))

    return df.mapInArrow(run, schema)


def encode_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """<id>, ids (list of integers) of every document, without special tokens.

    Null and empty texts get an empty list. Special-token strings in a text are ordinary text. Rows are kept one to one.
    """

    def make(batch: pa.RecordBatch, flat: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], [id_col, "ids"])

    picked = documents.select(id_col, F.col(text_col).alias("_text"))
    return _with_encoder(picked, "_text", path, make, f"`{id_col}` {dict(picked.dtypes)[id_col]}, ids array<int>")


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """<id>, tokens of every document; null and empty texts have 0."""

    def make(batch: pa.RecordBatch, flat: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64())], [id_col, "tokens"])

    picked = documents.select(id_col, F.col(text_col).alias("_text"))
    return _with_encoder(picked, "_text", path, make, f"`{id_col}` {dict(picked.dtypes)[id_col]}, tokens long")
