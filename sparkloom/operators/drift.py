"""Schemas that drift between files: profiles, rename matching, one consistent table.

1. Every line becomes a variant; its top-level keys are exploded on the JVM and each (file, field) gets its
   counts and JSON types over all lines.
2. Each file is joined with the one before it in its series. Fields of both are compared by type; a file that only gained or only lost
   fields is done with that.
3. Value sketches, for the fields that only one of two files has: the values of the ``sketch`` keys with the smallest hashes among the
   records where the field is not null, a coordinated sample. The same keys fall into the samples of neighbouring years, so values can be
   compared record by record; a field filled in few lines has as many values as any other, up to all it has.
4. Those fields are nodes of a bipartite graph, weighted by value, type and name similarity; a maximum-weight matching gives the renames.
5. Matched names are united into canonical columns, each of one type.

What meets in one Python task is the sketches of one file and the one before, of the fields that differ.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import materialise

SKETCH = 256
CHANGES = "file_id long, series_id long, change string, old_field string, new_field string"
_NUMBER = re.compile(r"\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*(?=.{1,7}\s*\Z)[A-Za-z][\w/]*(?: [A-Za-z][\w/]*)?\s*\Z|\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*\Z")
_WORDS = re.compile(r"[a-z]+|-?\d+(?:\.\d+)?")


def fields_of(lines: DataFrame, record: str = "record") -> DataFrame:
    """One row per line and top-level key: field, kind (null, text, number, boolean, array, object), value as text.

    Lines that are null, not valid JSON or not an object give no rows.
    """
    parsed = lines.withColumn("_v", F.try_parse_json(F.col(record))).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    out = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    shape = F.schema_of_variant("value")
    kind = (
        F.when(shape == "VOID", "null")
        .when(shape == "STRING", "text")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .otherwise("number")
    )
    return out.withColumn("kind", kind).withColumn("text", F.col("value").cast("string")).withColumnRenamed("key", "field")


def number_in(text: str) -> float | None:
    """The number a value holds: alone, with a unit, or in an object beside nothing but a unit; else None."""
    match = _NUMBER.match(text)
    if match:
        return float(match.group(1) or match.group(2))
    if text.startswith("{"):
        try:
            values = list(json.loads(text).values())
        except (ValueError, AttributeError):
            return None
        numbers = [v for v in values if isinstance(v, int | float) and not isinstance(v, bool)]
        units = [v for v in values if isinstance(v, str) and len(v) <= 12 and not re.search(r"\d\s*$", v)]
        if len(numbers) == 1 and len(numbers) + len(units) == len(values) <= 2:
            return float(numbers[0])
    return None


def name_similarity(a: str, b: str) -> float:
    """0 to 1, without regard to case, separators and units in brackets."""

    def words(name: str) -> list[str]:
        name = re.sub(r"\(.*?\)", " ", name)
        return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]

    x, y = words(a), words(b)
    plain = re.sub(r"[^a-z0-9]", "", a.lower()) == re.sub(r"[^a-z0-9]", "", b.lower())
    if plain or "".join(x) == "".join(y):
        return 1.0
    shared = len({*x} & {*y}) / max(1, len({*x} | {*y}))
    return max(shared, SequenceMatcher(None, "".join(x), "".join(y), autojunk=False).ratio())


def value_similarity(old: dict, new: dict) -> tuple[float | None, bool]:
    """(similarity of the values of two fields, None where nothing can be said; whether it is strong evidence).

    Both map record keys to value texts. Numbers agree within a third, texts by equal words.
    """
    if not old or not new:
        return None, False
    keys = [k for k in old if k in new]
    a_numbers, b_numbers = {k: number_in(v) for k, v in old.items()}, {k: number_in(v) for k, v in new.items()}
    a_share = sum(v is not None for v in a_numbers.values()) / len(old)
    b_share = sum(v is not None for v in b_numbers.values()) / len(new)
    if a_share >= 0.6 and b_share >= 0.6:
        pairs = [(a_numbers[k], b_numbers[k]) for k in keys if a_numbers[k] is not None and b_numbers[k] is not None]
        live = [(x, y) for x, y in pairs if x or y]
        if len(live) >= 3:
            close = sum(x * y > 0 and abs(math.log(y / x)) <= 0.33 for x, y in live)
            return close / len(live), len(live) >= 5
        if len(pairs) >= 3:
            return 0.5, False  # zeros only
        quantiles = [sorted(v for v in side.values() if v is not None) for side in (a_numbers, b_numbers)]
        ends = [[q[round((len(q) - 1) * p)] for p in (0.1, 0.3, 0.5, 0.7, 0.9)] for q in quantiles if q]
        if len(ends) == 2:
            return sum(abs(x - y) <= 0.3 * max(abs(x), abs(y)) for x, y in zip(*ends)) / 5, False
        return None, False
    if (a_share >= 0.6) != (b_share >= 0.6):
        return 0.0, True
    words_a, words_b = ({k: Counter(_WORDS.findall(v.lower())) for k, v in side.items()} for side in (old, new))
    if len(keys) >= 3:
        likeness = [sum((words_a[k] & words_b[k]).values()) / max(1, sum((words_a[k] | words_b[k]).values())) for k in keys]
        aligned = sum(likeness) / len(likeness)
        if aligned >= 0.6 and len(keys) >= 5:
            return aligned, len({v for v in old.values()}) > 2
    else:
        aligned = 0.0
    values_a, values_b = ({" ".join(sorted(w)) for w in side.values()} for side in (words_a, words_b))
    overlap = len(values_a & values_b) / max(1, min(len(values_a), len(values_b)))
    repeated = len(values_a) <= 0.7 * len(old) or len(old) < 6
    value = max(aligned, overlap if repeated else 0.0)
    if value < 0.2 and len(keys) < 5 and min(len(old), len(new)) < 8:
        return None, False  # too few values to speak against it
    return value, False


def rename_weight(old_name: str, new_name: str, old: dict, new: dict) -> float:
    """Weight of a rename, 0 where it is none."""
    name = name_similarity(old_name, new_name)
    value, strong = value_similarity(old, new)
    if value is None:
        return name if name >= 0.75 else 0.0
    if strong:
        return 0.8 * value + 0.2 * name if value >= 0.6 else 0.0
    if value >= 0.45 and name >= 0.45 or value >= 0.2 and name >= 0.8:
        return 0.6 * value + 0.4 * name
    return 0.0


def best_matching(weights: list[list[float]]) -> list[int]:
    """Maximum-weight bipartite matching by shortest augmenting paths: the column of each row, or -1."""
    rows, columns = len(weights), len(weights[0]) if weights else 0
    if not rows or not columns:
        return [-1] * rows
    n = max(rows, columns)
    cost = [[-(weights[i][j] if i < rows and j < columns else 0.0) for j in range(n)] for i in range(n)]
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [math.inf] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], math.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [-1] * rows
    for j in range(1, n + 1):
        i = owner[j] - 1
        if i < rows and j - 1 < columns and weights[i][j - 1] > 0:
            out[i] = j - 1
    return out


def _matched(table: pa.Table) -> pa.Table:
    """Renames, and what is left removed or added, of one file from its rows (file_id, series_id, come, field, kind, sketch)."""
    rows = table.to_pylist()
    sides: tuple[dict, dict] = ({}, {})
    for r in rows:
        sides[r["come"]][r["field"]] = (r["kind"], {e["k"]: e["t"] for e in r["sketch"] or ()})
    old, new = sides
    gone, come = sorted(old), sorted(new)
    weights = [[rename_weight(a, b, old[a][1], new[b][1]) for b in come] for a in gone]
    match = {gone[i]: come[j] for i, j in enumerate(best_matching(weights)) if j >= 0}
    out = [("renamed", a, b) for a, b in match.items()]
    out += [("removed", a, "") for a in gone if a not in match]
    out += [("added", "", b) for b in come if b not in match.values()]
    out += [("retyped", a, b) for a, b in match.items() if old[a][0] and new[b][0] and old[a][0] != new[b][0]]
    change, before, after = zip(*out)
    ids = {n: pa.array([rows[0][n]] * len(out), pa.int64()) for n in ("file_id", "series_id")}
    return pa.table(ids | {"change": pa.array(change), "old_field": pa.array(before), "new_field": pa.array(after)})


def field_kinds(files: DataFrame) -> DataFrame:
    """file_id, series_id, data_year, field, present, filled, kind of every field of every file.

    kind is the JSON type of most values that are not null (ties: the name that comes first), null where all are.
    """
    cells = fields_of(files.select("file_id", "series_id", "data_year", "record"))
    group = ["file_id", "series_id", "data_year", "field"]
    kinds = cells.groupBy(*group, "kind").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("kind") != "null", F.struct("n", (-F.ascii("kind")).alias("order"), "kind")))
    return kinds.groupBy(*group).agg(F.sum("n").alias("present"), F.sum(F.when(F.col("kind") != "null", F.col("n")).otherwise(0)).alias("filled"), best["kind"].alias("kind"))


def field_sketches(files: DataFrame, key: str, sketch: int = SKETCH, only: DataFrame | None = None) -> DataFrame:
    """file_id, field, sketch (key and text of the sampled records) of every field, or of the (file_id, field) rows of ``only``.

    ``key`` names the field that identifies a record in all files of a series.
    """
    if only is not None:
        files = files.join(only.select("file_id").distinct(), "file_id", "left_semi")
    keyed = files.select("file_id", "record").withColumn("k", F.try_variant_get(F.try_parse_json("record"), F.lit(f"$['{key}']"), "string")).filter("k is not null")
    values = fields_of(keyed).filter("kind <> 'null'").select("file_id", "field", "k", "text")
    if only is not None:
        values = values.join(only, ["file_id", "field"], "left_semi")
    # the rank filter is pushed below the shuffle as a limit per field and task (WindowGroupLimit); lines of one key rank alike
    least = F.dense_rank().over(Window.partitionBy("file_id", "field").orderBy(F.xxhash64("k"), "k"))
    sampled = values.withColumn("_r", least).filter(F.col("_r") <= sketch)
    # one value per key: the first of repeated lines in text order
    one = sampled.groupBy("file_id", "field", "k").agg(F.min("text").alias("t"))
    return one.groupBy("file_id", "field").agg(F.collect_list(F.struct("k", "t")).alias("sketch"))


def profile_fields(files: DataFrame, key: str, sketch: int = SKETCH) -> DataFrame:
    """``field_kinds`` with the sketch of every field."""
    return field_kinds(files).join(field_sketches(files, key, sketch), ["file_id", "field"], "left")


def schema_changes(files: DataFrame, key: str = "OSEBuildingID", sketch: int = SKETCH, kinds: DataFrame | None = None) -> DataFrame:
    """file_id, series_id, change, old_field, new_field: every change of a file against the one before it in its series.

    ``files`` has file_id, series_id, data_year and record (a JSON line). The file before is the nearest earlier
    data_year that the series has, file_id deciding within a year. A field is in a file if a readable record has its
    key, even with null. change is added (old_field ''), removed (new_field ''), renamed, or retyped. Rows with a null in one of the three
    identifying columns take no part; a file without a readable line is a file without fields only if it has none at all and is left out.
    ``kinds`` may give ``field_kinds`` of the files where it is at hand.
    """
    known = files.na.drop("any", subset=["file_id", "series_id", "data_year"])
    kinds = materialise(field_kinds(known), "kinds") if kinds is None else kinds
    order = Window.partitionBy("series_id").orderBy("data_year", "file_id")  # one row per file
    before = kinds.select("series_id", "data_year", "file_id").distinct().withColumn("before", F.lag("file_id").over(order)).filter("before is not null").select("file_id", "series_id", "before")
    new = kinds.join(before, ["file_id", "series_id"]).select("file_id", "series_id", "before", "field", F.col("kind").alias("new_kind"), F.lit(True).alias("new"))
    old = kinds.select(F.col("file_id").alias("before"), "series_id", "field", F.col("kind").alias("old_kind"), F.lit(True).alias("old")).join(before, ["before", "series_id"])
    compared = materialise(new.join(old, ["file_id", "series_id", "before", "field"], "full"), "compared")
    retyped = compared.filter("new and old and new_kind <> old_kind").select("file_id", "series_id", F.lit("retyped").alias("change"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))
    single = compared.filter("new is null or old is null").select("file_id", "series_id", "before", "field", F.col("new").isNotNull().alias("come"), F.coalesce("new_kind", "old_kind").alias("kind"))
    sides = single.groupBy("file_id").agg(F.countDistinct("come").alias("sides"))
    single = single.join(sides, "file_id")
    lone = single.filter("sides = 1").select(
        "file_id", "series_id", F.when(F.col("come"), "added").otherwise("removed").alias("change"), F.when(F.col("come"), "").otherwise(F.col("field")).alias("old_field"), F.when(F.col("come"), F.col("field")).otherwise("").alias("new_field")
    )
    open_ones = single.filter("sides = 2").withColumn("holder", F.when(F.col("come"), F.col("file_id")).otherwise(F.col("before")))
    sketches = field_sketches(known, key, sketch, open_ones.select(F.col("holder").alias("file_id"), "field").distinct())
    rows = open_ones.join(sketches.withColumnRenamed("file_id", "holder"), ["holder", "field"], "left").select("file_id", "series_id", "come", "field", "kind", "sketch")
    return retyped.unionAll(lone).unionAll(rows.groupBy("file_id").applyInArrow(_matched, CHANGES))


def canonical_names(changes: DataFrame, profile: DataFrame) -> dict[str, str]:
    """Canonical name of every field name: names linked by renames, the one in most files stands for all.

    Collects one row per distinct name and rename, and of names that renames link the pairs found beside each other: the vocabulary of
    the schemas, not the data. A rename that contradicts more
    files than it has (both names beside each other in one file) links nothing.
    """
    spark = profile.sparkSession
    names = {r.field: r.n for r in profile.groupBy("field").agg(F.countDistinct("file_id").alias("n")).collect()}
    renames = changes.filter("change = 'renamed'").groupBy("old_field", "new_field").agg(F.count(F.lit(1)).alias("n")).collect()
    root = {name: name for name in names}

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in renames:
        root[find(r.new_field)] = find(r.old_field)
    linked = [(n, find(n)) for n in {x for r in renames for x in (r.old_field, r.new_field)}]
    groups_of = spark.createDataFrame(linked, "field string, g string")
    held = profile.select("file_id", "field").distinct().join(groups_of, "field")  # pairs within a group of linked names only
    pairs = held.select("file_id", "g", F.col("field").alias("a")).join(held.select("file_id", "g", F.col("field").alias("b")), ["file_id", "g"])
    beside = {(r.a, r.b): r.n for r in pairs.filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    root = {name: name for name in names}
    members = {name: [name] for name in names}
    for r in sorted(renames, key=lambda r: (-r.n, r.old_field, r.new_field)):
        a, b = find(r.old_field), find(r.new_field)
        if a != b and all(beside.get((min(x, y), max(x, y)), 0) <= r.n for x in members[a] for y in members[b]):
            root[b] = a
            members[a] += members.pop(b)
    best = {g: max(ms, key=lambda m: (names[m], m)) for g, ms in members.items()}
    return {name: best[find(name)] for name in names}


def column_types(kinds: DataFrame, names: dict[str, str]) -> dict[str, str]:
    """The one type of each canonical column: double or boolean where every field united in it holds nothing else, else string."""
    found: dict[str, set] = {}
    for r in kinds.filter("kind is not null").select("field", "kind").distinct().collect():  # the vocabulary of the schemas
        found.setdefault(names[r.field], set()).add(r.kind)
    return {c: {"number": "double", "boolean": "boolean"}.get(next(iter(ks)), "string") if len(ks) == 1 else "string" for c, ks in found.items()}


def unify(files: DataFrame, names: dict[str, str], types: dict[str, str] | None = None) -> DataFrame:
    """One consistent table: file_id, line_no, series_id, data_year and one column per canonical field.

    Each column takes the first of its names that the record has. ``types`` gives a column's type (``column_types``), string where it
    does not; a single value that does not fit a double or boolean column is null there. Lines that are no JSON object are
    in ``rejects`` instead. Exact copies of a line are kept (dedupe on the key if they are not wanted). Columns differ in more than case.
    """
    types = types or {}
    parsed = files.withColumn("_v", F.try_parse_json("record")).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    groups: dict[str, list[str]] = {}
    for name, best in sorted(names.items()):
        groups.setdefault(best, []).append(name)
    taken = {c.lower() for c in ("file_id", "line_no", "series_id", "data_year")}
    columns = []
    for best, members in sorted(groups.items()):
        label = best
        while label.lower() in taken:
            label += "_"
        taken.add(label.lower())
        paths = [f'$["{m}"]' if "'" in m else f"$['{m}']" for m in [best, *[m for m in members if m != best]]]
        columns.append(F.coalesce(*[F.try_variant_get("_v", F.lit(p), types.get(best, "string")) for p in paths]).alias(label))
    return parsed.select("file_id", "line_no", "series_id", "data_year", *columns)


def rejects(files: DataFrame) -> DataFrame:
    """The lines that ``unify`` leaves out: null, not valid JSON (repeated keys too), or not an object."""
    shape = F.schema_of_variant(F.try_parse_json("record"))
    return files.filter(F.coalesce(~shape.startswith("OBJECT"), F.lit(True)))
