"""Registered queries of the training-data problems and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import abuse, clusters, cooccurrence, dupes, encode, frequency, packing, tokens
from sparkloom.session import materialise
from sparkloom.sources import load

Query = Callable[[SparkSession, str], DataFrame]


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.tag_rows(load(spark, folder, "questions"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _tags(spark, folder)
    marked = frequency.mark_terms(frequency.term_frequencies(rows), frequency.count_records(rows))
    return marked.filter("mark is not null").select(F.col("term").alias("tag"), "mark")


def p2_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_frequencies(_tags(spark, folder)).withColumnRenamed("term", "tag")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    entries = materialise(cooccurrence.record_items(_tags(spark, folder)), "entries")
    pairs = cooccurrence.pair_association(entries, min_count=5, min_lift=3)
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    entries = materialise(cooccurrence.record_items(_tags(spark, folder)), "entries")
    pairs = cooccurrence.pair_association(entries)
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n", F.round("lift", 6).alias("lift"))


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of customers by recency (units of 80 days), log frequency and log monetary value; one row per customer."""
    raw = load(spark, folder, "olist_train_data").select("customer_id", "recency", "frequency", "monetary_value")
    one = raw.groupBy("customer_id").agg(F.min(F.struct("recency", "frequency", "monetary_value")).alias("r")).select("customer_id", "r.*")
    recency = F.when((F.col("recency") >= 0) & (F.col("recency") != 9999), F.col("recency") / 80.0)
    logs = [F.when(F.col(c) > 0, F.ln(F.col(c))) for c in ("frequency", "monetary_value")]
    return clusters.cluster(one, "customer_id", [recency, *logs])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = materialise(_customers(spark, folder).filter("cluster is not null").select("id", "cluster"), "clusters")
    pairs = load(spark, folder, "cluster_probe").select(F.least("left_customer_id", "right_customer_id").alias("a"), F.greatest("left_customer_id", "right_customer_id").alias("b")).distinct()
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a").join(found.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b")
    return both.filter("ca = cb").select(F.col("a").alias("customer_id_a"), F.col("b").alias("customer_id_b"))


def p5_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.describe(materialise(_customers(spark, folder), "clusters"))


def p5_leaves(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.describe_leaves(materialise(_customers(spark, folder), "clusters")).withColumn("radius", F.round("radius", 6))


QUESTION_FIELDS = {"Title": "text", "Body": "text"}


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = dupes.hidden_duplicates(load(spark, folder, "questions"), "Id", QUESTION_FIELDS)
    return found.select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))


def p6_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return dupes.collapse_duplicates(load(spark, folder, "questions"), "Id", QUESTION_FIELDS)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_texts(load(spark, folder, "documents"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(encode.token_counts(load(spark, folder, "documents")), load(spark, folder, "token_budgets"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).select(F.col("budget").alias("budget_name"), "container", F.col("id").alias("doc_id"), "piece", "tokens")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(_packed(spark, folder)).withColumnRenamed("budget", "budget_name")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    documents = load(spark, folder, "documents")
    return abuse.score_documents(documents, abuse.learn(documents, load(spark, folder, "doc_labels")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).filter("toxic").select("doc_id")


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("doc_id", F.round("score", 6).alias("score"))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates_by_source(load(spark, folder, "documents"), _scored(spark, folder))


_TAG_SQL = r"""
raw AS (
  SELECT Id, lower(replace(replace(replace(replace(replace(Tags, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS t
  FROM questions WHERE Id IS NOT NULL AND Tags IS NOT NULL
),
tokens AS (SELECT Id, unnest(regexp_extract_all(t, '[\p{L}\p{N}+#.\-_]+')) AS tag FROM raw),
entries AS (SELECT DISTINCT Id, tag FROM tokens),
supports AS (SELECT tag, count(*) AS n FROM entries GROUP BY tag),
total AS (SELECT count(DISTINCT Id) AS total FROM entries)
"""

_PAIR_SQL = (
    "WITH "
    + _TAG_SQL
    + """,
pairs AS (
  SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n
  FROM entries a JOIN entries b ON a.Id = b.Id AND a.tag < b.tag GROUP BY ALL
),
measured AS (
  SELECT tag_a, tag_b, p.n, a.n AS n_a, b.n AS n_b, total
  FROM pairs p JOIN supports a ON a.tag = tag_a JOIN supports b ON b.tag = tag_b CROSS JOIN total
)
"""
)


def _canonical_sql(field: str) -> tuple[str, str]:
    """(text outside list items, sorted list items) of a field, for texts with the entities and closed list items of the test tables."""

    def bare(text: str) -> str:
        """RE2 looks neither back nor ahead: signs that do not count go first, points that count are marked (twice, as matches do not overlap)."""
        out = f"regexp_replace({text}, '(^|[^\\p{{L}}+#])[+#]+', '\\1 ', 'g')"
        for _ in range(2):
            out = f"regexp_replace({out}, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1·\\2', 'g')"
        return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}+#·]+', '', 'g')"

    text = f"replace({field}, '·', ' ')"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    text = f"lower(nfc_normalize({text}))"
    item = "(?s)<li>(.*?)</li>"
    outside, inside = bare(f"regexp_replace({text}, '{item}', '<li>', 'g')"), bare("i")
    return outside, f"list_sort([{inside} for i in regexp_extract_all({text}, '{item}', 1)])"


_KEYS_SQL = """
WITH fields AS (SELECT DISTINCT Id, {'rest': %s, 'items': %s} AS a, {'rest': %s, 'items': %s} AS b FROM questions WHERE Id IS NOT NULL AND Title IS NOT NULL AND Body IS NOT NULL),
keys AS (SELECT Id, min({'x': least(a, b), 'y': greatest(a, b)}) AS k FROM fields GROUP BY Id),
firsts AS (SELECT Id, min(Id) OVER (PARTITION BY k) AS rep FROM keys)
""" % (*_canonical_sql("Title"), *_canonical_sql("Body"))


def queries() -> dict[str, Query]:
    return {"p5_found": p5_found, "p5_clusters": p5_clusters, "p5_leaves": p5_leaves, "p2_found": p2_found, "p2_frequencies": p2_frequencies, "p4_found": p4_found, "p4_pairs": p4_pairs, "p6_found": p6_found, "p6_collapsed": p6_collapsed, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_report": p8_report, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _KEYS_SQL + "SELECT rep AS id_a, Id AS id_b FROM firsts WHERE Id <> rep",
        "p6_collapsed": _KEYS_SQL + "SELECT rep AS id, count(*)::BIGINT AS copies FROM firsts GROUP BY rep",
        "p2_found": "WITH " + _TAG_SQL + " SELECT tag, CASE WHEN n < 5 THEN 'rare' ELSE 'common' END AS mark FROM supports CROSS JOIN total WHERE n < 5 OR n > total * 0.1",
        "p2_frequencies": "WITH " + _TAG_SQL + " SELECT tag, count(*)::BIGINT AS occurrences, count(DISTINCT Id)::BIGINT AS records FROM tokens GROUP BY tag",
        "p4_found": _PAIR_SQL + " SELECT tag_a, tag_b FROM measured WHERE n >= 5 AND n * total >= 3 * n_a * n_b",
        "p4_pairs": _PAIR_SQL + " SELECT tag_a, tag_b, n::BIGINT AS n, round(n * total / (n_a * n_b)::DOUBLE, 6) AS lift FROM measured",
    }
