"""Items that appear together, by a blocked Gram matrix.

The binary record x item matrix X is never built whole. Records come in blocks (Arrow batches); each block
is a sparse matrix whose item columns are split into blocks. The transpose-products of the blocks are summed
inside the task, so what leaves it is one partial count per distinct pair, not one row per pair occurrence;
the partial counts are then summed over all tasks and set against the marginals.

Scale and skew:
* Items below the support threshold cannot be in a pair that reaches it (n_ab <= min(n_a, n_b)); they are
  taken out first, which changes no result.
* A frequent item costs nothing extra: it is a column of every block, never a group key of raw rows.
* A record with very many items is split into item blocks of about ``wide`` items: its entries go to the tasks of all block pairs
  they belong to, and each task makes one block of the product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise

WIDE = 256  # items from which a record is split into item blocks
ITEM_BLOCKS = 16  # parts in which the items of any record are first collected
DENSE = 256  # columns of a dense item block
FLUSH = 2_000_000  # distinct pairs that a task holds before it emits its partial sums


def sparse_gram(indptr: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper triangle of X'X of a binary CSR block: (pairs as code_a << 32 | code_b, counts), a < b.

    Rows are taken by their length, so each product is over whole columns. ``codes`` must be distinct in a row.
    """
    lengths = np.diff(indptr)
    keys = []
    for k in np.unique(lengths):
        if k < 2:
            continue
        rows = np.flatnonzero(lengths == k)
        step = max(1, 4_000_000 // (k * k))
        left, right = np.triu_indices(k, 1)
        for at in range(0, len(rows), step):
            block = np.sort(codes[indptr[rows[at : at + step]][:, None] + np.arange(k)], axis=1).astype(np.int64)
            made, times = np.unique((block[:, left] << 32 | block[:, right]).ravel(), return_counts=True)
            keys.append((made, times))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _merge(np.concatenate([k for k, _ in keys]), np.concatenate([n for _, n in keys]))


def dense_gram(indptr: np.ndarray, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a block whose columns are all below ``width``, as one matrix product."""
    x = np.zeros((len(indptr) - 1, width), np.float32)
    x[np.repeat(np.arange(len(indptr) - 1), np.diff(indptr)), codes] = 1
    gram = np.triu(x.T @ x, 1)
    a, b = np.nonzero(gram)
    return a.astype(np.int64) << 32 | b, gram[a, b].astype(np.int64)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, counts, len(unique)).astype(np.int64)


class _Sums:
    """Partial sums of a task, keyed by the codes of a task-wide dictionary."""

    def __init__(self) -> None:
        self.index: dict = {}
        self.names: list = []
        self.parts: list = []
        self.size = 0

    def codes(self, dictionary: list) -> np.ndarray:
        out = np.empty(len(dictionary), np.int64)
        for i, name in enumerate(dictionary):
            code = self.index.get(name)
            if code is None:
                code = self.index[name] = len(self.names)
                self.names.append(name)
            out[i] = code
        return out

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > FLUSH and len(self.parts) > 1:
            self.parts = [_merge(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))]
            self.size = len(self.parts[0][0])

    def drain(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        keys, counts = _merge(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))
        self.parts, self.size = [], 0
        names = np.array(self.names, object)
        for at in range(0, len(keys), 50_000):
            a, b = names[keys[at : at + 50_000] >> 32], names[keys[at : at + 50_000] & 0xFFFFFFFF]
            swap = np.fromiter((x.encode() > y.encode() for x, y in zip(a, b)), bool, len(a))  # byte order, as Spark sorts strings
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(counts[at : at + 50_000])], ["item_a", "item_b", "n"])


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(0)
        encoded = lists.flatten().dictionary_encode()
        local = encoded.indices.to_numpy()
        indptr = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        names = encoded.dictionary.to_pylist()
        task = sums.codes(names)
        # columns by falling frequency, so that the first block holds the dense part
        order = np.argsort(-np.bincount(local, minlength=len(names)), kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        codes = rank[local]
        hot = codes < DENSE
        rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
        per_row = np.bincount(rows[hot], minlength=len(indptr) - 1)
        if (per_row.astype(np.float64) ** 2).sum() * 20 > len(per_row) * min(DENSE, len(names)) ** 2:
            # the hot columns against each other as a dense block, everything else sparse
            k, n = dense_gram(np.r_[0, np.cumsum(per_row)], codes[hot], min(DENSE, len(names)))
            parts = [(k, n)]
            k, n = sparse_gram(indptr, codes)
            cold = (k & 0xFFFFFFFF) >= DENSE
            parts.append((k[cold], n[cold]))
        else:
            parts = [sparse_gram(indptr, codes)]
        back = task[order]
        for k, n in parts:
            a, b = back[k >> 32], back[k & 0xFFFFFFFF]
            sums.add(np.minimum(a, b) << 32 | np.maximum(a, b), n)
        if sums.size > FLUSH:
            yield from sums.drain()
    yield from sums.drain()


def _cross_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of two different item blocks of wide records: left' right."""
    sums = _Sums()
    for batch in batches:
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = sums.codes(left), sums.codes(right)
            for at in range(0, len(a), max(1, FLUSH // max(1, len(b)))):
                part = a[at : at + max(1, FLUSH // max(1, len(b)))]
                x, y = np.repeat(part, len(b)), np.tile(b, len(part))
                sums.add(np.minimum(x, y) << 32 | np.maximum(x, y), np.ones(len(x), np.int64))
                if sums.size > FLUSH:
                    yield from sums.drain()
    yield from sums.drain()


PAIR_SCHEMA = "item_a string, item_b string, n long"


def pair_counts(entries: DataFrame, record: str = "record", item: str = "item", wide: int = WIDE, blocks: int = ITEM_BLOCKS) -> DataFrame:
    """item_a, item_b (item_a < item_b in byte order), n: the records holding both.

    ``entries`` is one row per (record, item), distinct.
    """
    rows = entries.select(F.col(record).alias("record"), F.col(item).alias("item"), F.pmod(F.xxhash64(F.col(item)), F.lit(blocks)).cast("int").alias("block"))
    # per record and item block first: no list ever holds more than one block of a record
    lists = rows.groupBy("record", "block").agg(F.collect_list("item").alias("items"))
    whole = lists.groupBy("record").agg(F.sum(F.size("items")).alias("size"), F.flatten(F.collect_list(F.when(F.size("items") <= wide, F.col("items")))).alias("items"))
    whole = materialise(whole.filter("size > 1"), "baskets")  # read by both branches
    narrow = whole.filter(F.col("size") <= wide).select("items").mapInArrow(_gram, PAIR_SCHEMA)
    # a wide record is dealt to as many blocks as it has items for, so a product of two blocks is small whatever the record's size
    broad = whole.filter(F.col("size") > wide).select("record", F.ceil(F.col("size") / wide).alias("deal"))
    single = lists.join(broad, "record").select("record", "deal", F.explode("items").alias("item"))
    dealt = single.select("record", "item", F.pmod(F.xxhash64("item", F.lit(1)), F.col("deal")).cast("int").alias("block"))
    parts = materialise(dealt.groupBy("record", "block").agg(F.collect_list("item").alias("items")), "blocks")
    same = parts.select("items").mapInArrow(_gram, PAIR_SCHEMA)
    left = parts.select("record", F.col("block").alias("a"), F.col("items").alias("left"))
    right = parts.select("record", F.col("block").alias("b"), F.col("items").alias("right"))
    # block pairs of one record: with k items (k / wide)^2 / 2 rows of 2 * wide items
    crossed = left.join(right, "record").filter("a < b").select("left", "right").mapInArrow(_cross_blocks, PAIR_SCHEMA)
    return narrow.unionByName(same).unionByName(crossed).groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))


def record_items(rows: DataFrame, record: str = "record", terms: str = "terms") -> DataFrame:
    """Distinct (record, item) entries of rows with an array of terms; nulls count nothing."""
    one = rows.select(F.col(record).alias("record"), F.col(terms).alias("terms")).distinct()
    return one.select("record", F.explode("terms").alias("item")).filter("record is not null and item is not null").distinct()


def pair_association(entries: DataFrame, min_count: int = 1, min_lift: float | None = None) -> DataFrame:
    """item_a, item_b, n, n_a, n_b, total, lift of every pair held together by at least ``min_count`` records.

    lift = n * total / (n_a * n_b), how many times more often than if the items were independent. With
    ``min_lift`` the comparison is made on whole numbers: n * total >= min_lift * n_a * n_b. An empty input
    and records with one item give no pairs.
    """
    support = materialise(entries.groupBy("item").agg(F.count(F.lit(1)).alias("support")), "support")  # read three times
    total = entries.select("record").distinct().agg(F.count(F.lit(1)).alias("total"))
    kept = entries
    if min_count > 1:
        kept = entries.join(support.filter(F.col("support") >= min_count).select("item"), "item", "left_semi")
    pairs = pair_counts(kept).filter(F.col("n") >= min_count)
    a = support.select(F.col("item").alias("item_a"), F.col("support").alias("n_a"))
    b = support.select(F.col("item").alias("item_b"), F.col("support").alias("n_b"))
    out = pairs.join(a, "item_a").join(b, "item_b").crossJoin(F.broadcast(total))  # total is one row
    if min_lift is not None:
        out = out.filter((F.col("n") * F.col("total")).cast("decimal(38,0)") >= F.lit(min_lift) * (F.col("n_a") * F.col("n_b")).cast("decimal(38,0)"))
    return out.select("item_a", "item_b", "n", "n_a", "n_b", "total", (F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("lift"))
