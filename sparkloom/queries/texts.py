"""Text operators over the documents and questions tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import html, scalars, text
from sparkloom.registry import Registry
from sparkloom.sources import load

query = Registry()

_TOKENS = "SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '\\s+') if x <> ''] AS t FROM documents WHERE text IS NOT NULL"


def _tokens(spark, d):
    """doc_id, t: lower-case tokens by ASCII white space."""
    df = load(spark, d, "documents").filter("text is not null")
    return df.select("doc_id", F.filter(F.split(F.lower("text"), r"[\t\n\f\r ]+"), lambda t: t != "").alias("t"))


def _joined(name: str, expression: str, source: str = _TOKENS) -> str:
    return f"SELECT doc_id, array_to_string({expression}, ' ') AS {name} FROM ({source})"


@query("filter_digits", _joined("tokens", "[x for x in [regexp_replace(y, '[\\p{Nd}²³¹⁰⁴-⁹₀-₉]', '', 'g') for y in t] if regexp_replace(x, '[\\s\\p{Z}\\x0b\\x{85}\\x1c-\\x1f]', '', 'g') <> '']"))
def filter_digits(spark, d):
    return _tokens(spark, d).select("doc_id", F.array_join(text.drop_digits(F.col("t")), " ").alias("tokens"))


@query("filter_single_letters", _joined("tokens", f"[x for x in t if instr('{text.LETTERS}', x) = 0]"))
def filter_single_letters(spark, d):
    return _tokens(spark, d).select("doc_id", F.array_join(text.drop_single_letters(F.col("t"), compat=True), " ").alias("tokens"))


@query("filter_punctuation", _joined("tokens", r"[z for z in flatten([regexp_split_to_array(trim(regexp_replace(y, '[^0-9a-zA-Z]+', ' ', 'g')), ' +') for y in [x for x in t if NOT regexp_full_match(x, '\p{L}?')]]) if z <> '']"))
def filter_punctuation(spark, d):
    return _tokens(spark, d).select("doc_id", F.array_join(text.drop_punctuation(F.col("t")), " ").alias("tokens"))


@query("filter_repeated_characters", _joined("tokens", "[x for x in t if len([i for i in range(1, length(x) - 1) if x[i] = x[i + 1] AND x[i + 1] = x[i + 2]]) = 0]"))
def filter_repeated_characters(spark, d):
    return _tokens(spark, d).select("doc_id", F.array_join(text.drop_repeated_characters(F.col("t")), " ").alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in sorted(text.STOPWORDS["english"]))


@query("filter_stopwords", _joined("tokens", f"[x for x in t if x NOT IN ({_STOP}) AND length(x) > 1]"))
def filter_stopwords(spark, d):
    return _tokens(spark, d).select("doc_id", F.array_join(text.drop_stopwords(F.col("t"), min_length=1), " ").alias("tokens"))


@query("filter_tokens_by_length", _joined("tokens", "[x for x in t if (length(x) > 3 AND length(x) < 8) OR x IN ('of', 'the')]"))
def filter_tokens_by_length(spark, d):
    return _tokens(spark, d).select("doc_id", F.array_join(text.keep_lengths(F.col("t"), 3, 8, ["of", "the"]), " ").alias("tokens"))


@query("get_domain_based_tokens", f"SELECT doc_id, len([x for x in t if x IN ('station', 'building', 'the')])::INT AS domain, len([x for x in t if x NOT IN ('station', 'building', 'the')])::INT AS other FROM ({_TOKENS})")
def get_domain_based_tokens(spark, d):
    inside, other = text.split_domain(F.col("t"), ["station", "building", "the"])
    return _tokens(spark, d).select("doc_id", F.size(inside).alias("domain"), F.size(other).alias("other"))


@query("filter_questions_by_token_count", f"SELECT doc_id, len(t)::INT AS n FROM ({_TOKENS}) WHERE len(t) > 5 AND len(t) < 50")
def filter_questions_by_token_count(spark, d):
    return _tokens(spark, d).select("doc_id", F.size("t").alias("n")).filter("n > 5 and n < 50")


@query("extract_n_grams", f"SELECT gram, count(*) AS n FROM (SELECT unnest([t[i] || ' ' || t[i + 1] for i in generate_series(1, len(t) - 1)]) AS gram FROM ({_TOKENS}) WHERE len(t) > 1) GROUP BY 1")
def extract_n_grams(spark, d):
    grams = F.transform(text.n_grams(F.col("t"), 2), lambda g: F.array_join(g, " "))
    return _tokens(spark, d).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_duplicates",
    f"""WITH w AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM ({_TOKENS})), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM w),
    k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS tokens FROM c WHERE n = 1 GROUP BY 1) SELECT doc_id, coalesce(tokens, '') AS tokens FROM ({_TOKENS}) LEFT JOIN k USING (doc_id)""",
)
def filter_duplicates(spark, d):
    return _tokens(spark, d).select("doc_id", F.array_join(text.drop_duplicate_tokens(F.col("t"), keep=False), " ").alias("tokens"))


_TITLES = "SELECT DISTINCT Id, string_split(lower(Title), ' ') AS t FROM questions WHERE Title IS NOT NULL"


def _titles(spark, d):
    return load(spark, d, "questions").filter("Title is not null").select("Id", F.split(F.lower("Title"), " ").alias("t")).distinct()


@query(
    "filter_words_by_similarity",
    f"""WITH q AS (SELECT row_number() OVER () AS k, Id, t FROM ({_TITLES})), w AS (SELECT k, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM q),
    n AS (SELECT DISTINCT a.k, a.i FROM w a JOIN w b ON a.k = b.k AND a.i <> b.i AND 1 - levenshtein(a.w, b.w) / greatest(length(a.w), length(b.w), 1)::DOUBLE > 0.8),
    s AS (SELECT k, string_agg(w, ' ' ORDER BY i) AS tokens FROM w ANTI JOIN n USING (k, i) GROUP BY 1) SELECT Id, coalesce(tokens, '') AS tokens FROM q LEFT JOIN s USING (k)""",
)
def filter_words_by_similarity(spark, d):
    tokens = F.col("t")
    return _titles(spark, d).select("Id", F.array_join(text.drop_similar_words(tokens, 0.8), " ").alias("tokens"))


@query(
    "filter_most_common_tokens",
    f"""WITH q AS (SELECT row_number() OVER () AS k, Id, t FROM ({_TITLES})), w AS (SELECT k, len(t) AS size, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM q),
    r AS (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, w) AS r FROM w GROUP BY k, w), s AS (SELECT k, string_agg(w, ' ' ORDER BY i) AS tokens FROM w JOIN r USING (k, w) WHERE r > 2 OR size <= 10 GROUP BY 1)
    SELECT Id, coalesce(tokens, '') AS tokens FROM q LEFT JOIN s USING (k)""",
)
def filter_most_common_tokens(spark, d):
    tokens = F.col("t")
    return _titles(spark, d).select("Id", F.array_join(text.drop_most_common(tokens, 2), " ").alias("tokens"))


@query("mean_token_length", f"SELECT doc_id, round(list_sum([length(x) for x in t])::DOUBLE / nullif(len(t), 0), 6) AS mean_length FROM ({_TOKENS})")
def mean_token_length(spark, d):
    return _tokens(spark, d).select("doc_id", F.round(text.mean_length(F.col("t")), 6).alias("mean_length"))


@query(
    "compute_domain_words_window",
    f"""WITH p AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM ({_TOKENS})), k AS (SELECT doc_id, i FROM p WHERE w IN ('the', 'and')),
    r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM k),
    s AS (SELECT doc_id, round(sum(i * (2 * r - n + 1)) / any_value(n * (n - 1) / 2), 6) AS span FROM r WHERE n > 1 GROUP BY 1)
    SELECT doc_id, span FROM ({_TOKENS}) LEFT JOIN s USING (doc_id)""",
)
def compute_domain_words_window(spark, d):
    return _tokens(spark, d).select("doc_id", F.round(text.window_of(F.col("t"), ["the", "and"]), 6).alias("span"))


# the stages one after another, each over the list of the one before
_NORMAL = [
    r"[regexp_replace(x, '[\p{Nd}²³¹⁰⁴-⁹₀-₉]', '', 'g') for x in t if x NOT IN ('c++', 'c#')]",
    r"[x for x in t if regexp_replace(x, '[\s\p{Z}\x0b\x{85}\x1c-\x1f]', '', 'g') <> '' AND NOT regexp_full_match(x, '\p{L}?')]",
    r"[z for z in flatten([regexp_split_to_array(trim(regexp_replace(x, '[^0-9a-zA-Z]+', ' ', 'g')), ' +') for x in t]) if z <> '']",
    "[x for x in t if len([i for i in range(1, length(x) - 1) if x[i] = x[i + 1] AND x[i + 1] = x[i + 2]]) = 0]",
    rf"[x for x in t if NOT regexp_full_match(x, '\p{{L}}?') AND x NOT IN ({_STOP})]",
]
_NORMAL_SQL = f"SELECT doc_id, t AS whole, t FROM ({_TOKENS})"
for _stage in _NORMAL:
    _NORMAL_SQL = f"SELECT doc_id, whole, {_stage} AS t FROM ({_NORMAL_SQL})"


@query("text_normalizer", f"SELECT doc_id, array_to_string(list_concat(t, [x for x in whole if x IN ('c++', 'c#')]), ' ') AS tokens FROM ({_NORMAL_SQL})")
def text_normalizer(spark, d):
    return _tokens(spark, d).select("doc_id", F.array_join(text.normalize(F.col("t"), domain=["c++", "c#"]), " ").alias("tokens"))


@query("tokenize")
def tokenize(spark, d):
    return load(spark, d, "documents").filter("text is not null").select("doc_id", F.size(text.tokenize(F.col("text"), lower=True)).alias("n"), F.size(text.tokenize_words(F.col("text"))).alias("words"))


@query("stemmerize")
def stemmerize(spark, d):
    return _tokens(spark, d).select("doc_id", F.array_join(text.stems(F.col("t")), " ").alias("tokens"))


@query(
    "filter_html_tags",
    """SELECT Id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(Body, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '</?[a-zA-Z][^<>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS body FROM questions""",
)
def filter_html_tags(spark, d):
    return load(spark, d, "questions").select("Id", html.strip_html(F.col("Body")).alias("body"))


_TAGS = "[x for x in string_split(regexp_replace(Tags, '^<|>$', '', 'g'), '><') if x <> '']"


@query("tag_parsing", f"SELECT Id, array_to_string({_TAGS}, ' ') AS tags, len({_TAGS})::INT AS n FROM questions WHERE Tags IS NOT NULL")
def tag_parsing(spark, d):
    tags = text.parse_tags(F.col("Tags"))
    return load(spark, d, "questions").filter("Tags is not null").select("Id", F.array_join(tags, " ").alias("tags"), F.size(tags).alias("n"))


@query("keep_allowed_tags", f"SELECT * FROM (SELECT Id, array_to_string([x for x in {_TAGS} if x IN ('python', 'java', 'sql')], ' ') AS tags FROM questions WHERE Tags IS NOT NULL) WHERE tags <> ''")
def keep_allowed_tags(spark, d):
    tags = text.keep_allowed(text.parse_tags(F.col("Tags")), ["python", "java", "sql"])
    return load(spark, d, "questions").filter("Tags is not null").select("Id", F.array_join(tags, " ").alias("tags")).filter("tags <> ''")


@query("text_lengths", "SELECT Id, length(Title)::INT AS title, length(Body)::INT AS body, length(Answer)::INT AS answer FROM questions")
def text_lengths(spark, d):
    return load(spark, d, "questions").select("Id", F.length("Title").alias("title"), F.length("Body").alias("body"), F.length("Answer").alias("answer"))


@query("property_use_count", "SELECT OSEBuildingID, len(string_split(ListOfAllPropertyUseTypes, ', '))::INT AS uses FROM benchmarking_2015 WHERE ListOfAllPropertyUseTypes IS NOT NULL")
def property_use_count(spark, d):
    return load(spark, d, "benchmarking_2015").filter("ListOfAllPropertyUseTypes is not null").select("OSEBuildingID", F.size(F.split("ListOfAllPropertyUseTypes", ", ")).alias("uses"))


_PLAIN = f"translate(text, '{''.join(scalars.accent_map())}', '{''.join(scalars.accent_map().values())}')"
for _a, _b in scalars.LIGATURES:
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b}')"


@query("normalize_encoding", f"SELECT doc_id, {_PLAIN} AS text FROM documents")
def normalize_encoding(spark, d):
    return load(spark, d, "documents").select("doc_id", scalars.strip_accents(F.col("text")).alias("text"))


@query("replace_characters", "SELECT doc_id, translate(text, 'aeiou', '43102') AS text FROM documents")
def replace_characters(spark, d):
    return load(spark, d, "documents").select("doc_id", scalars.replace_words(F.col("text"), dict(zip("aeiou", "43102"))).alias("text"))


@query("read_int_cleaner", r"SELECT o_orderkey, regexp_replace(regexp_replace(reverse(o_orderkey::VARCHAR), '(\d{3})', '\1 ', 'g'), ' $', '') AS back FROM orders")
def read_int_cleaner(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.reverse(scalars.group_thousands(F.col("o_orderkey"))).alias("back"))


@query(
    "build_target_representative_lexicon",
    """WITH q AS (SELECT Id, min({'a': Tags, 'b': Title}) AS v FROM questions WHERE Id IS NOT NULL AND Tags IS NOT NULL AND Title IS NOT NULL GROUP BY 1), c AS (SELECT target, token, count(*) AS n FROM (SELECT v.a AS target, unnest(string_split(lower(v.b), ' ')) AS token FROM q) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, token) AS r, count(*) OVER (PARTITION BY target) AS k, sum(n) OVER (PARTITION BY target) AS total FROM c)
    SELECT arg_min(target, (-total, target)) AS target, token, arg_min(n, (-total, target)) AS n FROM r WHERE r <= greatest(ceil(k * 0.25), 1) GROUP BY token""",
)
def build_target_representative_lexicon(spark, d):
    df = load(spark, d, "questions").filter("Id is not null and Tags is not null and Title is not null").groupBy("Id").agg(F.min(F.struct("Tags", "Title")).alias("r")).select("r.*")
    return text.lexicon_by_target(df.select("Tags", F.split(F.lower("Title"), " ").alias("t")), "Tags", "t")


@query("location_fields", """SELECT OSEBuildingID, (regexp_extract(Location, '[''"]latitude[''"]: [''"]?(-?[0-9.]+)', 1))::DOUBLE AS latitude, nullif(regexp_extract(Location, 'zip[^0-9]+([0-9]+)', 1), '') AS zip FROM benchmarking_2015 WHERE Location IS NOT NULL""")
def location_fields(spark, d):
    parsed = scalars.parse_address(F.col("Location"))
    return load(spark, d, "benchmarking_2015").filter("Location is not null").select("OSEBuildingID", parsed["latitude"].alias("latitude"), parsed["zip"].alias("zip"))


queries, oracle_sql = query.queries, query.oracle_sql
