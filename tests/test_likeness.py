"""The index of known texts against scoring every pair, and its work on many."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from pyspark import TaskContext

from sparkloom.functions.likeness import Known, matched
from sparkloom.functions.text import token_set_ratio
from sparkloom.operators import relate


def words(rnd: random.Random, letters: str, most: int) -> str:
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, most)))


def test_matching_blocks():
    from difflib import SequenceMatcher

    rnd = random.Random(1)
    pairs = [tuple("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30))) for _ in range(2)) for _ in range(400)]
    codes = [np.array([[ord(c) for c in x.ljust(30)] for x in side], np.uint8) for side in zip(*pairs)]
    sizes = [np.array([len(x) for x in side]) for side in zip(*pairs)]
    assert matched(*codes, *sizes, chunk=64).tolist() == [sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for a, b in pairs]


@pytest.mark.parametrize("seed", range(12))
def test_best_known_texts(seed):
    rnd = random.Random(seed)
    letters, most = rnd.choice(["ab", "abcd", "abcdé9"]), rnd.choice([2, 4, 14])
    known = sorted({words(rnd, letters, most) + rnd.choice(["", " st", " ave", " ave n"]) for _ in range(rnd.choice([1, 4, 300]))})
    texts = list({words(rnd, letters, most) + rnd.choice(["", " St.", " avenue", " Z9"]) for _ in range(30)})
    got: dict[str, list] = {}
    for a, b, score in Known(known).best(texts, 3, chunk=8):
        got.setdefault(a, []).append((-score, b))
    assert got == {a: sorted((-token_set_ratio(a, b), b) for b in known)[:3] for a in texts}


def addresses(n: int) -> list[str]:
    rnd = random.Random(2)
    parts = ["ve", "gru", "quo", "dros", "rai", "wort", "pla", "zi", "neo", "fa", "kli", "tix"]
    return [f"{rnd.randint(1, 9999)} {''.join(rnd.choices(parts, k=4)).title()} {rnd.choice(['ST', 'AVE', 'WAY', 'Ave N'])}" for _ in range(n)]


def test_many_candidates_in_time(spark):
    known = addresses(20_000)
    right = spark.createDataFrame([(k,) for k in known], "t string")
    left = spark.createDataFrame([(k.title().replace("Ave", "Avenue"),) for k in known[:2_000]], "s string")
    began = time.monotonic()
    got = relate.top_candidates(left, right, "s", "t").collect()
    assert time.monotonic() - began < 60
    a = got[0].a
    assert [(r.b, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.a == a] == [(b, -s) for s, b in sorted((-token_set_ratio(a, b), b) for b in set(known))[:5]]


def test_best_of_many_in_time(spark):
    known = addresses(20_000)
    right = spark.createDataFrame([(k,) for k in known], "t string")
    left = spark.createDataFrame([(k.replace("ST", "St").replace("AVE", "Avenue"),) for k in known[:6_000]], "s string")
    began = time.monotonic()
    got = relate.fuzzy_matching(left, right, "s", "t").collect()
    assert time.monotonic() - began < 60
    for r in got[:3]:
        assert (-r.score, r.b) == min((-token_set_ratio(r.a, b), b) for b in set(known))


@pytest.mark.parametrize("n", [1, 3])
def test_best_known_addresses(n):
    rnd = random.Random(n)
    known = sorted({*addresses(3_000), "AVE", "Ave N", "ave n", "St.", "N", "12", "12 34", "-"})
    texts = [*(k.replace("AVE", "Avenue").replace("ST", "St") for k in rnd.sample(known, 60)), "n ave", "Way", "12 34 56", "9999 Nowhere", "ave n 12"]
    got: dict[str, list] = {}
    for a, b, score in Known(known).best(sorted(set(texts)), n, chunk=16):
        got.setdefault(a, []).append((-score, b))
    assert got == {a: sorted((-token_set_ratio(a, b), b) for b in known)[:n] for a in texts}


def test_texts_are_spread_evenly_over_tasks(spark):
    left = spark.createDataFrame([(f"t{i}",) for i in range(8_000)], "s string")
    right = spark.createDataFrame([("k",)], "t string")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the blocks come from one partition here, and go round the tasks evenly by chance
    try:
        got = relate.fuzzy_matching(left, right, "s", "t", 0, scorer=lambda a, b: TaskContext.get().partitionId()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    held: dict[int, int] = {}
    for r in got:
        held[r.score] = held.get(r.score, 0) + 1
    assert max(held.values()) < 1.3 * 8_000 / len(held)
    assert len(held) % spark.sparkContext.defaultParallelism == 0
