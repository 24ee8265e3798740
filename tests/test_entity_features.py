from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from sparkloom.streaming import entity_features as ef

SCHEMA = "event_id long, customer_id string, event_type string, order_purchase_date timestamp_ntz, monetary_value double, entity string, n int"


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def brute(rows, until):
    seen, out = set(), defaultdict(lambda: [0, None, 0])
    for e, c, t, d, m in rows:
        if e is None or c is None or t is None or d is None or d >= until or c.strip(" \t").lower() in ("", "n/a") or e in seen:
            continue
        seen.add(e)
        v = out[(c.strip(" \t").lower(), t)]
        v[0] += 1
        v[1] = d if v[1] is None else max(v[1], d)
        v[2] += round((m or 0) * 100)
    return {k: tuple(v) for k, v in out.items()}


def test_stream_equals_brute_force(spark, tmp_path):
    until = datetime(2018, 9, 1)
    rows = []
    for i in range(600):
        who = ["HOT", " hot\t", "b", "c ", None, "n/a", ""][i % 7]
        rows.append((i, who, ["view", "buy", None][i % 3 if i % 11 else 2], None if i % 50 == 0 else datetime(2018, 1 + i % 12, 1 + i % 28), [1.005, None, -2.5, float("nan")][i % 4]))
    rows += [(7, "hot", "view", datetime(2018, 1, 1), 9.0)] * 0 + rows[:100] + [(None, "b", "view", datetime(2018, 1, 1), 1.0)]
    source = str(tmp_path / "events.parquet")
    for part in range(5):
        make(spark, rows[part::5]).coalesce(1).write.mode("append").parquet(source)
    clean = [(e, c, t, d, None if m is not None and m != m else m) for e, c, t, d, m in rows]
    want = brute(clean, until)
    got = ef.entity_features(spark, source, str(until), batches=3).select("entity", F.explode("types").alias("t", "v")).select("entity", "t", "v.count", "v.last", "v.cents").collect()
    assert {(r.entity, r.t): (r["count"], r.last, r.cents) for r in got} == want


def test_upsert_goes_on_as_files_arrive(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    clean = lambda e: ef.clean_events(e, "2018-09-01")
    make(spark, [(1, "a", "x", datetime(2018, 1, 1), 1.0), (2, "a", "y", datetime(2018, 1, 1), 1.0)]).write.mode("append").parquet(source)
    ef.update_features(spark, source, table, state, clean)
    make(spark, [(2, "A", "y", datetime(2018, 1, 1), 1.0), (3, "a", "x", datetime(2018, 2, 1), 2.0)]).write.mode("append").parquet(source)
    ef.update_features(spark, source, table, state, clean)
    current = ef.current_features(spark, table).select("entity", F.explode("types").alias("kind", "v"))
    got = {(r.entity, r.kind): (r.v.n, r.v.cents) for r in current.collect()}
    assert got == {("a", "x"): (2, 300), ("a", "y"): (1, 100)}
    wide = ef.spread(ef.feature_rows(ef.current_features(spark, table), "2018-09-01"), ["x", "z"]).head()
    assert (wide.count_x, wide.recency_x, wide.total_x, wide.count_z, wide.recency_z, wide.total_z) == (2, 212, 3.0, 0, None, 0.0)


def test_empty(spark, tmp_path):
    source = str(tmp_path / "none.parquet")
    make(spark, []).write.parquet(source)
    assert ef.entity_features(spark, source, "2018-09-01").count() == 0
