import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import encode, packing

needs_tokenizer = pytest.mark.skipif(not os.path.exists(encode.TOKENIZER), reason="no tokenizer file")

TEXTS = ["", None, " ", "\n\n  x", "Hello world's  end!!", "aaaa" * 300, "ab" * 700 + " 1234567", "naïve café 日本語 🇧🇷 ​ é", "<|endoftext|>", "tab\tand\r\nline\x00nul", "   a", "x" * 5000, "ééé" * 400]


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder(*encode.read_merges(encode.TOKENIZER))


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


def ids(encoder, texts):
    flat, offsets = encoder.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


@needs_tokenizer
def test_equals_the_public_library(encoder, public):
    assert ids(encoder, TEXTS) == [public(t) for t in TEXTS]
    assert ids(encoder, TEXTS[::-1]) == [public(t) for t in TEXTS[::-1]]  # from the cache


@needs_tokenizer
@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(encoder, public, texts):
    assert ids(encoder, texts) == [public(t) for t in texts]


@needs_tokenizer
def test_more_steps_than_one_query_takes(encoder, public, monkeypatch):
    monkeypatch.setattr(encode, "STEPS", 2)
    encoder.clear()
    assert ids(encoder, TEXTS) == [public(t) for t in TEXTS]


@needs_tokenizer
def test_one_word_of_megabytes(encoder, public):
    """A word without a break is encoded whole, in fewer steps a query, within the memory limit."""
    text = "ab" * 1_000_000 + "xyz"
    assert ids(encoder, [text]) == [public(text)]
    encoder.clear()


@needs_tokenizer
def test_table(spark, public):
    df = spark.createDataFrame([(i, t, [1], 7) for i, t in enumerate(TEXTS)] + [(None, "a", [2], 7)], "doc_id long, text string, ids array<int>, tokens int")
    got = {r.doc_id: r.ids for r in encode.encode_texts(df).collect()}
    assert got == {i: public(t) for i, t in enumerate(TEXTS)} | {None: public("a")}
    assert {r.doc_id: r.tokens for r in encode.token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert encode.encode_texts(df.limit(0)).count() == 0


def check(placed, items, capacity):
    fill, back = {}, {}
    for r in placed:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
        back.setdefault(r.id, []).append((r.piece, r.tokens))
    assert max(fill.values()) <= capacity
    assert {i: sum(t for _, t in p) for i, p in back.items()} == dict(items)
    for i, p in back.items():
        assert [n for n, _ in sorted(p)] == list(range(len(p)))
        assert len(p) == max(1, -(-dict(items)[i] // capacity))
    return len(fill)


def test_pack(spark):
    rng = np.random.default_rng(2)
    items = [(i, int(s)) for i, s in enumerate(rng.integers(0, 900, 1500))]
    df = spark.createDataFrame([*((i, s, "x") for i, s in items), (None, 5, "x"), (9999, None, "x"), (9998, -1, "x")], "doc_id long, tokens long, container string")
    budgets = spark.createDataFrame([("small", 256), ("big", 2048), ("none", 0), (None, 5)], "budget_name string, capacity_tokens int")
    one = packing.pack(df, budgets).collect()
    tree = packing.pack(df.repartition(7), budgets, per_task=100).collect()
    for name, capacity in (("small", 256), ("big", 2048)):
        least = -(-sum(s for _, s in items) // capacity)
        for rows in (one, tree):
            n = check([r for r in rows if r.budget == name], items, capacity)
            assert n <= least * 1.02 + 2
    again = packing.pack(df.repartition(3), budgets, per_task=100).collect()
    assert sorted(map(tuple, tree)) == sorted(map(tuple, again))


def test_pack_items_that_do_not_combine(spark):
    items = [(i, 60) for i in range(300)]
    df = spark.createDataFrame(items, "doc_id long, tokens long")
    budgets = spark.createDataFrame([("b", 100)], "budget_name string, capacity_tokens int")
    assert check(packing.pack(df, budgets, per_task=50).collect(), items, 100) == 300
    assert packing.pack(df.limit(0), budgets).count() == 0


def test_every_underfull_container_goes_on(spark):
    """Far more underfull containers than a task takes: each of them is packed again, none is left as it is for being too many."""
    items = [(i, 60) for i in range(600)] + [(1000 + i, 41) for i in range(10)] + [(2000, 1)]
    df = spark.createDataFrame(items, "doc_id long, tokens long")
    budgets = spark.createDataFrame([("b", 100)], "budget_name string, capacity_tokens int")
    assert check(packing.pack(df, budgets, per_task=40).collect(), items, 100) <= 610
    halves = [(i, 30 if i % 3 else 65) for i in range(900)]
    df = spark.createDataFrame(halves, "doc_id long, tokens long")
    least = -(-sum(s for _, s in halves) // 100)
    assert check(packing.pack(df, budgets, per_task=7).collect(), halves, 100) <= least * 1.1


def test_best_fit():
    place, fill = packing.best_fit(np.array([5, 4, 3, 2, 6]), 10)
    assert fill.tolist() == [10, 10] and place[4] == place[1] and place[0] == place[2] == place[3]


def test_report(spark):
    placed = spark.createDataFrame([("b", 10, "x", 1, 0, 7), ("b", 10, "x", 2, 0, 3), ("b", 10, "y", 3, 0, 5)], "budget string, capacity long, container string, id long, piece int, tokens long")
    r = packing.fill_report(placed).head()
    assert (r.containers, r.tokens, r.used, r.least_containers) == (2, 15, 0.75, 2)
