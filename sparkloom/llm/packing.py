"""Filling fixed-capacity containers: hierarchical residual packing.

Every task packs its items by best fit, largest first. Containers that are nearly full, or too full for any item of the task, are
emitted; underfull ones become items of the next round, in which fewer tasks pack them again by best fit. There are as many tasks as
the underfull containers of a budget need (``per_task`` each), so no round sends an unbounded group to one task; the tree ends where a
budget needs one task, or where a round of several tasks has merged less than ``least_gain`` of what it was given.

Only containers and their sizes travel between rounds. Who lies where is written down as pairs (container, container of the next
round), which are resolved from the top at the end and joined with the items once.

An item above the capacity is split into full containers and a rest; no other item is split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise

PER_TASK = 50_000
NEARLY = 0.995
LEAST_GAIN = 0.01
MOST_BUDGETS = 1000

_PLACED = "budget string, capacity long, id long, piece int, size long, child string, bin string, fill long, final boolean, head boolean"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, fill of each container), largest item first, ties in the order given.

    Open containers are stacked by their residual; a bit mask of the residuals in use finds the least one that is large
    enough, so an item costs the same however many containers are open.
    """
    place = np.empty(len(sizes), np.int64)
    fill: list[int] = []
    stacks: dict[int, list[int]] = {}
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            residual = size + (fitting & -fitting).bit_length() - 1
            stack = stacks[residual]
            at = stack.pop()
            if not stack:
                mask &= ~(1 << residual)
        else:
            at, residual = len(fill), capacity
            fill.append(0)
        place[i] = at
        fill[at] += size
        left = residual - size
        stacks.setdefault(left, []).append(at)
        mask |= 1 << left
    return place, np.array(fill, np.int64)


def _pack(level: int, nearly: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        budget, capacity, part = (k.as_py() for k in key)
        # the order of rows in a group is not defined: ties are broken by what the rows are
        table = table.sort_by([("child", "ascending")] if level else [("id", "ascending"), ("piece", "ascending")])
        sizes = table["size"].to_numpy()
        place, fill = best_fit(sizes, capacity)
        final = (fill >= nearly * capacity) | (fill + int(sizes.min()) > capacity)
        head = np.zeros(len(place), bool)
        head[np.unique(place, return_index=True)[1]] = True
        names = pa.array([f"{budget}-{level}-{part}-{i}" for i in range(len(fill))], pa.string())
        columns = {n: table[n].combine_chunks() for n in ("budget", "capacity", "id", "piece", "size", "child")}
        return pa.table(columns | {"bin": names.take(pa.array(place)), "fill": pa.array(fill[place], pa.int64()), "final": pa.array(final[place]), "head": pa.array(head)})

    return run


def _by_budget(values: dict[str, int], otherwise: int = 1) -> Column:
    """The value of a row's budget."""
    out = F.lit(otherwise)
    for budget, value in values.items():
        out = F.when(F.col("budget") == budget, value).otherwise(out)
    return out


def pack(items: DataFrame, budgets: DataFrame, id_col: str = "doc_id", size_col: str = "tokens", per_task: int = PER_TASK, nearly: float = NEARLY, least_gain: float = LEAST_GAIN) -> DataFrame:
    """budget, capacity, container, id, piece, tokens: where every item (or piece of one) lies, for each budget.

    ``items`` has unique integer ids and sizes; ``budgets`` has budget_name (unique) and capacity_tokens. Items of size 0 are placed like
    any other. Rows with a null id or a null or negative size, and budgets with a null or non-positive capacity, are left out.
    Pieces of an item are numbered from 0. The result does not depend on how the input is partitioned. ValueError above
    MOST_BUDGETS budgets: every item goes to every budget.
    """
    clean = materialise(items.select(F.col(id_col).cast("long").alias("id"), F.col(size_col).cast("long").alias("size")).filter("id is not null and size >= 0"), "items")
    parts = max(1, -(-clean.count() // per_task))
    chosen = budgets.select("budget_name", "capacity_tokens").filter("budget_name is not null and capacity_tokens > 0").distinct().limit(MOST_BUDGETS + 1).collect()
    if len(chosen) > MOST_BUDGETS:
        raise ValueError(f"more than {MOST_BUDGETS} budgets")
    each_budget = F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(c).cast("long").alias("capacity")) for b, c in sorted(map(tuple, chosen))])
    if not chosen:
        each_budget = F.array().cast("array<struct<budget: string, capacity: bigint>>")
    each = clean.select("id", "size", F.explode(each_budget).alias("b")).select("id", "size", "b.*")  # every item goes to every budget
    pieces = F.when(F.col("size") > F.col("capacity"), F.ceil(F.col("size") / F.col("capacity")).cast("int")).otherwise(1)
    split = each.select("budget", "capacity", "id", "size", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    tokens = F.least(F.col("capacity"), F.col("size") - F.col("piece") * F.col("capacity"))
    split = split.select("budget", "capacity", "id", "piece", tokens.alias("size"), F.lit(None).cast("string").alias("child"), F.pmod(F.xxhash64("id", "piece"), F.lit(parts)).alias("part"))
    # full pieces are containers of their own
    whole = split.filter("size = capacity").select("budget", "capacity", F.concat_ws("-", "budget", F.lit("full"), "id", "piece").alias("container"), "id", "piece", F.col("size").alias("tokens"))
    given = split.filter("size < capacity")
    before = {b: parts for b, _ in map(tuple, chosen)}
    rounds: list[DataFrame] = []
    waiting: dict[str, int] = {}
    while True:
        level = len(rounds)
        placed = given.groupBy("budget", "capacity", "part").applyInArrow(_pack(level, nearly), _PLACED)
        rounds.append(materialise(placed, f"round{level}"))
        left = {r.budget: r.n for r in rounds[-1].filter("head and not final").groupBy("budget").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per budget
        # a budget goes on while it was in several tasks and the last round of containers was worth it
        go = {b: n for b, n in left.items() if before.get(b, 1) > 1 and (level == 0 or n <= (1 - least_gain) * waiting[b])}
        if not go:
            break
        waiting, before = go, {b: -(-n // per_task) for b, n in go.items()}
        underfull = rounds[-1].filter(F.col("head") & ~F.col("final") & F.col("budget").isin(*go))
        part = F.pmod(F.xxhash64("bin", F.lit(level)), _by_budget(before))
        given = underfull.select("budget", "capacity", "id", "piece", F.col("fill").alias("size"), F.col("bin").alias("child"), part.alias("part"))
    root: DataFrame | None = None  # (container, the one that it ended in) of the containers that were packed again
    for placed in reversed(rounds[1:]):
        step = placed.select(F.col("child").alias("_child"), "bin")
        step = _follow(step, root)
        root = step.select(F.col("_child").alias("_bin"), F.col("bin").alias("_root"))
    out = _follow(rounds[0].select("budget", "capacity", "bin", "id", "piece", F.col("size").alias("tokens")), root)
    return whole.unionByName(out.withColumnRenamed("bin", "container"))


def _follow(placed: DataFrame, root: DataFrame | None) -> DataFrame:
    """Each row's container replaced by the one that it ended in."""
    if root is None:
        return placed
    return placed.join(root, F.col("bin") == F.col("_bin"), "left").withColumn("bin", F.coalesce("_root", "bin")).drop("_bin", "_root")


def fill_report(placed: DataFrame) -> DataFrame:
    """budget, capacity, containers, tokens, used (share of the space that is filled), least_containers (no packing can need fewer)."""
    one = placed.groupBy("budget", "capacity", "container").agg(F.sum("tokens").alias("tokens"))
    out = one.groupBy("budget", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return out.withColumn("used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6)).withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity")).cast("long"))
