from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkloom.llm import cooccurrence, frequency, tokens

SCHEMA = "record long, terms array<string>, salt int, item string"


def brute(rows):
    times, ids = Counter(), defaultdict(set)
    for r, ts in rows:
        for t in ts or ():
            if r is not None and t is not None:
                times[t] += 1
                ids[t].add(r)
    return {(t, n, len(ids[t])) for t, n in times.items()}


def sample():
    rows = [(i % 400, [f"t{i % 17}", "hot", f"t{i % 17}", None]) for i in range(900)]
    return rows + [(None, ["x"]), (5, None), (5, []), (6, ["", "é" * 5000])]


def test_last_seen_counters(spark):
    rows = sample()
    df = spark.createDataFrame([(r, t, 1, "clash") for r, t in rows], SCHEMA).repartition(3)
    got = {tuple(r) for r in frequency.term_frequencies(df).collect()}
    assert got == brute(rows)
    few = {tuple(r) for r in frequency.term_frequencies(df, salts=1).collect()}
    assert few == got
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert {tuple(r) for r in frequency.term_frequencies(df, salts=1, flush=3).collect()} == got  # counters go between records
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_batches_keep_the_last_record(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i // 4, ["a", "b"]) for i in range(40)]
        df = spark.createDataFrame([(r, t, 1, "") for r, t in rows], SCHEMA)
        assert {tuple(r) for r in frequency.term_frequencies(df).collect()} == {("a", 40, 10), ("b", 40, 10)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_string_records_and_marks(spark):
    df = spark.createDataFrame([(f"r{i}", ["often"] + (["seldom"] if i < 2 else [])) for i in range(30)], "record string, terms array<string>")
    marked = frequency.mark_terms(frequency.term_frequencies(df), frequency.count_records(df))
    assert {(r.term, r.mark) for r in marked.collect()} == {("often", "common"), ("seldom", "rare")}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert frequency.term_frequencies(df).count() == 0
    assert frequency.count_records(df).head().n == 0
    assert cooccurrence.pair_association(cooccurrence.record_items(df)).count() == 0


def test_tag_notations(spark):
    raw = ["<C++><node.js>", "&lt;python&gt;", "java|generics", '["c#", "wpf"]', "< a > < b >", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "Id long, Tags string")
    got = {r.record: r.terms for r in tokens.tag_rows(df).collect()}
    assert got == {0: ["c++", "node.js"], 1: ["python"], 2: ["java", "generics"], 3: ["c#", "wpf"], 4: ["a", "b"]}


def pairs_brute(rows, least=1):
    ids = defaultdict(set)
    for r, ts in rows:
        if r is not None:
            ids[r] |= {t for t in ts or () if t is not None}
    ids = {r: s for r, s in ids.items() if s}
    single, both = Counter(), Counter()
    for s in ids.values():
        single.update(s)
        ordered = sorted(s, key=lambda t: t.encode())
        both.update((a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :])
    return {(a, b, n, single[a], single[b], len(ids)) for (a, b), n in both.items() if n >= least}


def test_pairs_equal_brute_force(spark):
    rows = sample() + [(1000 + i, [f"w{j}" for j in range(i % 40)]) for i in range(80)]
    df = spark.createDataFrame([(r, t, 1, "clash") for r, t in rows], SCHEMA)
    for least in (1, 5):
        got = {tuple(r)[:6] for r in cooccurrence.pair_association(cooccurrence.record_items(df), least).collect()}
        assert got == pairs_brute(rows, least)


def test_wide_records_are_split_into_item_blocks(spark):
    rows = [(i, [f"w{j}" for j in range(60 + i)]) for i in range(4)] + [(9, ["w1", "w2"])]
    df = spark.createDataFrame([(r, t, 1, "") for r, t in rows], SCHEMA)
    entries = cooccurrence.record_items(df)
    got = {tuple(r) for r in cooccurrence.pair_counts(entries, wide=20, blocks=5).collect()}
    assert got == {(a, b, n) for a, b, n, *_ in pairs_brute(rows)}


def test_dense_block_equals_sparse():
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(30, rng.integers(0, 9), replace=False)) for _ in range(200)]
    indptr, codes = np.r_[0, np.cumsum([len(r) for r in rows])], np.concatenate(rows)
    sparse, dense = cooccurrence.sparse_gram(indptr, codes), cooccurrence.dense_gram(indptr, codes, 30)
    assert dict(zip(*map(np.ndarray.tolist, sparse))) == dict(zip(*map(np.ndarray.tolist, dense)))


def test_lift(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i < 6 else ["c"]) for i in range(24)], "record long, terms array<string>")
    r = cooccurrence.pair_association(cooccurrence.record_items(df), 5, 3).head()
    assert (r.item_a, r.item_b, r.n, r.lift) == ("a", "b", 6, 4.0)
    assert cooccurrence.pair_association(cooccurrence.record_items(df), 7).filter(F.col("n") < 7).count() == 0
