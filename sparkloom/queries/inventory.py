"""Sources, sinks and further rows of the inventory. Files that a query reads back are written by it below the shared folder."""

from __future__ import annotations

import io
import zipfile

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import geometry, scalars, text
from sparkloom.operators import clean, evaluate, geo, ml, profile, quantiles, relate, reshape, segment, supervised
from sparkloom.registry import Registry
from sparkloom.session import scratch_path
from sparkloom.sources import concat_files, find_csv, load, read_csv, read_json_columns, write_csv, write_parquet
from sparkloom.sources import archives, models
from sparkloom.sources.files import read_addresses

query = Registry()

_NATION = "n_nationkey int, n_name string, n_regionkey int"
_PARTS = "p_partkey bigint, p_name string, p_size int"


def _save(spark, path: str, data: bytes) -> None:
    """Bytes as a file of any file system that Spark writes."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()


# sources and sinks


@query("csv_reader", "SELECT p_partkey, p_name, p_size FROM part")
def csv_reader(spark, d):
    path = scratch_path(spark, "csv")
    write_csv(load(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return read_csv(spark, path, _PARTS)


@query("csv_sink", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_sink(spark, d):
    path = scratch_path(spark, "csv")
    write_csv(load(spark, d, "nation"), path, sep=";")
    return read_csv(spark, path, _NATION, sep=";")


@query("multi_file_scan_by_keyword", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def multi_file_scan_by_keyword(spark, d):
    folder = scratch_path(spark, "keyword")
    for r in range(4):
        write_csv(load(spark, d, "nation").filter(F.col("n_regionkey") == r), f"{folder}/region_{r}_export.csv")
    return read_csv(spark, find_csv("region_2", folder), _NATION)


@query("concat_samples", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS p_size FROM part WHERE p_partkey % 3 < 2")
def concat_samples(spark, d):
    folder = scratch_path(spark, "samples")
    part = load(spark, d, "part").select("p_partkey", "p_name", "p_size")
    for i in range(3):
        write_csv(part.filter(F.col("p_partkey") % 3 == i).drop(*["p_size"][i:]), f"{folder}/{i}_sample.csv")
    out = concat_files(spark, folder, first=2)
    return out.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size"))


@query("get_location_addresses_db_from_ban", "SELECT c_custkey::VARCHAR AS numero, NULL::VARCHAR AS suffixe, c_name AS nom_voie, c_acctbal AS lon, c_acctbal / 2 AS lat FROM customer WHERE c_nationkey = 7")
def get_location_addresses_db_from_ban(spark, d):
    path = scratch_path(spark, "addresses")
    c = load(spark, d, "customer")
    rows = c.select(F.concat(F.lit("town "), F.col("c_nationkey").cast("string")).alias("nom_commune"), F.col("c_custkey").cast("string").alias("numero"), F.lit(None).cast("string").alias("suffixe"), F.col("c_name").alias("nom_voie"), F.col("c_acctbal").alias("lon"), (F.col("c_acctbal") / 2).alias("lat"))
    rows.write.option("header", True).option("sep", ";").option("compression", "gzip").csv(path)
    out = read_addresses(spark, path, "town 7")
    return out.select(F.col("numero").cast("string").alias("numero"), F.col("suffixe").cast("string").alias("suffixe"), "nom_voie", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))


@query("json_metadata_scan", "SELECT name, description, data_type_name FROM benchmarking_metadata WHERE file_id = (SELECT min(file_id) FROM benchmarking_metadata)")
def json_metadata_scan(spark, d):
    path = scratch_path(spark, "metadata")
    rows = load(spark, d, "benchmarking_metadata")
    one = rows.join(F.broadcast(rows.agg(F.min("file_id").alias("file_id"))), "file_id")  # one row
    # a data dictionary is one document, of as many entries as a file has columns
    document = one.agg(F.to_json(F.struct(F.collect_list(F.struct("name", "description", "data_type_name")).alias("columns")), {"ignoreNullFields": "false"}).alias("value"))
    document.coalesce(1).write.text(path)
    return read_json_columns(spark, path).select("name", "description", "data_type_name")


@query("csv_scan_with_converters", "SELECT o_orderkey, o_orderpriority AS first, 2::INT AS n FROM orders")
def csv_scan_with_converters(spark, d):
    path = scratch_path(spark, "lists")
    rows = load(spark, d, "orders").select("o_orderkey", F.concat(F.lit("['"), F.col("o_orderpriority"), F.lit("', '"), F.col("o_orderstatus"), F.lit("']")).alias("tags"))
    write_csv(rows, path)
    tags = models.list_from_text(F.col("tags"))
    return read_csv(spark, path, "o_orderkey bigint, tags string").select("o_orderkey", tags[0].alias("first"), F.size(tags).alias("n"))


def _zipped(spark, d) -> str:
    folder = scratch_path(spark, "uploads")
    rows = load(spark, d, "nation").orderBy("n_nationkey").collect()  # the 25 nations
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for i, sep in enumerate((",", ";")):
            lines = [sep.join(("n_nationkey", "n_name", "n_regionkey"))] + [sep.join(map(str, r)) for r in rows if r.n_regionkey % 2 == i]
            archive.writestr(f"town{i}.csv", "\n".join(lines).encode("utf-8-sig" if i else "cp1252"))
    _save(spark, f"{folder}/towns.zip", buffer.getvalue())
    return folder


@query("unzip_cities_files", "SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'town0.csv' ELSE 'town1.csv' END AS member, count(*) AS lines FROM nation GROUP BY 1")
def unzip_cities_files(spark, d):
    return archives.read_uploads(spark, _zipped(spark, d)).groupBy("member").agg(F.count(F.lit(1)).alias("lines"))


@query("get_map", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def get_map(spark, d):
    f = archives.read_uploads(spark, _zipped(spark, d)).select("fields")
    return f.select(F.col("fields")["n_nationkey"].cast("int").alias("n_nationkey"), F.col("fields")["n_name"].alias("n_name"), F.col("fields")["n_regionkey"].cast("int").alias("n_regionkey"))


@query("detect_file_encoding", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'utf-8' WHEN doc_id % 4 = 1 THEN 'utf-8-sig' WHEN doc_id % 4 = 2 THEN 'utf-16' ELSE 'cp1252' END AS encoding FROM documents WHERE text IS NOT NULL")
def detect_file_encoding(spark, d):
    def find(batches):
        for b in batches:
            yield b.assign(encoding=[detect(x) for x in b["data"]])[["doc_id", "encoding"]]

    detect = archives.detect_encoding
    way = F.col("doc_id") % 4
    plain = F.encode("text", "UTF-8")
    odd = F.concat(F.unhex(F.lit("E9")), F.encode(F.regexp_replace("text", r"[^\x00-\x7f]", ""), "US-ASCII"))  # an e acute as cp1252 has it
    data = F.when(way == 0, plain).when(way == 1, F.concat(F.unhex(F.lit("EFBBBF")), plain)).when(way == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(odd)
    df = load(spark, d, "documents").filter("text is not null").select("doc_id", data.alias("data"))
    return df.mapInPandas(find, "doc_id long, encoding string")


def _round_trip(spark, d):
    path = scratch_path(spark, "table")
    write_parquet(load(spark, d, "supplier"), path)
    return spark.read.parquet(path)


_SUPPLIERS = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
query("pickle_data", _SUPPLIERS)(_round_trip)
query("pickle_writer", _SUPPLIERS)(_round_trip)
query("pickle_loader", _SUPPLIERS)(_round_trip)


def _model_trip(spark, d):
    df = VectorAssembler(inputCols=["o_totalprice"], outputCol="v").transform(load(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    model = MinMaxScaler(inputCol="v", outputCol="scaled").fit(df)
    again = models.load_model(models.save_model(model, scratch_path(spark, "models"), "scaler"), spark)
    return again.transform(df).select("o_orderkey", F.round(vector_to_array("scaled")[0], 8).alias("scaled"))


_SCALED = "SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 8) AS scaled FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)"
query("save_model", _SCALED)(_model_trip)
query("load_model", _SCALED)(_model_trip)


def _buildings(spark, d):
    df = load(spark, d, "benchmarking_2016").filter("Latitude is not null and Longitude is not null and OSEBuildingID is not null")
    return df.groupBy(F.col("OSEBuildingID").alias("id")).agg(F.min(F.struct(F.col("Longitude").alias("x"), F.col("Latitude").alias("y"))).alias("p")).select("id", "p.*")


_BUILDINGS = "SELECT OSEBuildingID AS id, v.x AS x, v.y AS y FROM (SELECT OSEBuildingID, min({'x': Longitude, 'y': Latitude}) AS v FROM benchmarking_2016 WHERE Latitude IS NOT NULL AND Longitude IS NOT NULL AND OSEBuildingID IS NOT NULL GROUP BY 1)"


def _layers(spark, d):
    df = _buildings(spark, d).select("id", F.array(geometry.point(F.col("x"), F.col("y"))).alias("outline"))
    paths = models.write_layers({"city": {"even": df.filter("id % 2 = 0"), "odd": df.filter("id % 2 = 1")}}, scratch_path(spark, "layers"))
    return spark.read.parquet(*paths).select("id", "outline")


_WKT = f"SELECT id, 'POINT (' || x::VARCHAR || ' ' || y::VARCHAR || ')' AS outline FROM ({_BUILDINGS})"
query("write_shapefiles_from_layers", _WKT)(_layers)
query("convert_geodataframe_to_shapefile", _WKT)(_layers)


@query("labels_from_paths", "SELECT n_name AS label, 1::BIGINT AS files FROM nation WHERE n_nationkey < 5")
def labels_from_paths(spark, d):
    folder = scratch_path(spark, "images")
    for r in load(spark, d, "nation").filter("n_nationkey < 5").collect():
        _save(spark, f"{folder}/n0{r.n_nationkey}-{r.n_name}/picture.jpg", b"x")
    return archives.labels_from_paths(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("files"))


# cleaning and profiling


@query("get_index_from_features", "SELECT 'l_tax' AS feature, 7::INT AS position UNION ALL SELECT 'l_orderkey', 0")
def get_index_from_features(spark, d):
    names = ["l_tax", "l_orderkey"]
    return spark.createDataFrame(list(zip(names, clean.column_positions(load(spark, d, "lineitem"), names))), "feature string, position int")


@query("get_data_loss", "SELECT round(100 - count(*) FILTER (l_quantity > 10) * 100.0 / count(*), 1)::DOUBLE AS loss FROM lineitem")
def get_data_loss(spark, d):
    lines = load(spark, d, "lineitem")
    return spark.createDataFrame([(clean.data_loss(lines, lines.filter("l_quantity > 10")),)], "loss double")


@query("univariate_analysis", "SELECT 'c' AS measure, round(avg(o_totalprice), 4) AS a, round(median(o_totalprice), 4) AS b FROM orders UNION ALL SELECT 'd', round(var_samp(o_totalprice), 2), round(stddev_samp(o_totalprice), 4) FROM orders UNION ALL SELECT 's', round(skewness(o_totalprice), 6), round(kurtosis(o_totalprice), 6) FROM orders")
def univariate_analysis(spark, d):
    orders, out = load(spark, d, "orders"), None
    for measure, (a, b, n, m) in {"c": ("mean", "median", 4, 4), "d": ("var", "std", 2, 4), "s": ("skew", "kurtosis", 6, 6)}.items():
        one = profile.univariate(orders, "o_totalprice", measure).select(F.lit(measure).alias("measure"), F.round(a, n).alias("a"), F.round(b, m).alias("b"))
        out = one if out is None else out.unionAll(one)
    return out


@query("percentage_diff", "SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_tax - l_discount) * 100.0 / nullif((l_tax + l_discount) / 2, 0), 2) AS difference FROM lineitem")
def percentage_diff(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", profile.percentage_difference(F.col("l_tax"), F.col("l_discount")).alias("difference"))


@query("groupby_plot", "SELECT lang AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def groupby_plot(spark, d):
    return profile.value_counts(load(spark, d, "documents"), "lang")


@query("plot_facet_grid", """WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 12 AS w FROM orders)
    SELECT o_orderstatus, least(floor((o_totalprice - lo) / w) + 1, 12)::INT AS bin, count(*) AS n FROM orders, e GROUP BY 1, 2""")
def plot_facet_grid(spark, d):
    return profile.histogram(load(spark, d, "orders"), "o_totalprice", 12, by="o_orderstatus").drop("density")


@query("null_fill", "SELECT doc_id, coalesce(n_chars, 0) AS n_chars FROM documents WHERE NOT (lang IS NULL AND source IS NULL)")
def null_fill(spark, d):
    return load(spark, d, "documents").na.drop("all", subset=["lang", "source"]).na.fill(0, ["n_chars"]).select("doc_id", "n_chars")


@query("quantile_table", "SELECT name, round(q[1], 4) AS q1, round(q[2], 4) AS median, round(q[3], 4) AS q3 FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, quantile_cont({c}, [0.25, 0.5, 0.75]) AS q FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")) + ")")
def quantile_table(spark, d):
    long = quantiles.columns_long(load(spark, d, "lineitem"), {c: F.col(c) for c in ("l_quantity", "l_extendedprice", "l_tax")})
    q = F.col("q")
    return quantiles.quantiles(long, "name", "x", [0.25, 0.5, 0.75]).select(F.col("key").alias("name"), F.round(q[0], 4).alias("q1"), F.round(q[1], 4).alias("median"), F.round(q[2], 4).alias("q3"))


@query("grouped_multi_aggregate", "SELECT l_returnflag, round(avg(l_quantity), 1) AS quantity, round(avg(l_tax), 4) AS tax, round(avg(l_extendedprice), 0) AS price, count(*) AS n FROM lineitem GROUP BY 1")
def grouped_multi_aggregate(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 1).alias("quantity"), F.round(F.avg("l_tax"), 4).alias("tax"), F.round(F.avg("l_extendedprice"), 0).alias("price"), F.count(F.lit(1)).alias("n"))


@query("describe_transposed", "WITH g AS (SELECT l_linestatus AS k, round(avg(l_quantity), 4) AS q, round(avg(l_tax), 6) AS t FROM lineitem GROUP BY 1) SELECT 'q' AS variable, max(q) FILTER (k = 'F') AS \"F\", max(q) FILTER (k = 'O') AS \"O\" FROM g UNION ALL SELECT 't', max(t) FILTER (k = 'F'), max(t) FILTER (k = 'O') FROM g")
def describe_transposed(spark, d):
    means = load(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("k")).agg(F.round(F.avg("l_quantity"), 4).alias("q"), F.round(F.avg("l_tax"), 6).alias("t"))
    return reshape.transpose(means, "k", ["F", "O"])


@query("get_centroids", "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS c_acctbal, round(avg(c_nationkey), 6) AS c_nationkey FROM customer GROUP BY 1")
def get_centroids(spark, d):
    return profile.group_means(load(spark, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]).select("c_mktsegment", F.round("c_acctbal", 6).alias("c_acctbal"), F.round("c_nationkey", 6).alias("c_nationkey"))


@query("print_score_results", "SELECT 'mse' AS score, round(avg((l_extendedprice - l_quantity * 1000) ^ 2), 3) AS value FROM lineitem UNION ALL SELECT 'rmse', round(sqrt(avg((l_extendedprice - l_quantity * 1000) ^ 2)), 3) FROM lineitem")
def print_score_results(spark, d):
    df = load(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1000).alias("p"))
    return evaluate.regression_scores(df, "l_extendedprice", "p").drop("r2").unpivot([], ["mse", "rmse"], "score", "value")


# segments, orders, labels

_LATE = "(SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) - 60 AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _late(spark, d):
    df = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", (F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) - 60).alias("v"))


@query("over_under_matched_split", f"SELECT l_orderkey, l_linenumber, l_partkey, greatest(v, 0)::INT AS over, least(v, 0)::INT AS under, (v = 0)::INT AS matched FROM {_LATE}")
def over_under_matched_split(spark, d):
    v = F.col("v")
    return _late(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", *scalars.over_under(v), (v == 0).cast("int").alias("matched"))


@query("late_flag", f"SELECT CASE WHEN v >= 0 THEN 0 ELSE 1 END::INT AS late, count(*) AS n FROM {_LATE} GROUP BY 1")
def late_flag(spark, d):
    return _late(spark, d).groupBy(scalars.late_flag(F.col("v")).alias("late")).agg(F.count(F.lit(1)).alias("n"))


@query("list_length_per_customer_and_order", """WITH j AS (SELECT o_custkey, o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey), s AS (SELECT o_custkey, o_orderkey, count(*) AS lines FROM j GROUP BY 1, 2)
    SELECT j.o_custkey, s.lines, count(*) AS n FROM j JOIN s ON j.o_custkey = s.o_custkey GROUP BY 1, 2""")
def list_length_per_customer_and_order(spark, d):
    rows = load(spark, d, "orders").join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "l_linenumber")
    return segment.list_lengths(rows, "o_custkey", "o_orderkey", "l_linenumber", "lines").groupBy("o_custkey", "lines").agg(F.count(F.lit(1)).alias("n"))


@query("positive_shift_filter", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey + 1 > 0 AND c_acctbal > 0")
def positive_shift_filter(spark, d):
    return segment.positive_rows(load(spark, d, "customer"), ["c_nationkey", "c_acctbal"], ("c_nationkey",)).select("c_custkey", "c_nationkey", "c_acctbal")


@query("median_zero_columns", "SELECT c AS column FROM (SELECT 'big' AS c, median(CASE WHEN l_quantity > 40 THEN l_quantity ELSE 0 END) AS m FROM lineitem UNION ALL SELECT 'l_tax', median(l_tax) FROM lineitem) WHERE m = 0")
def median_zero_columns(spark, d):
    df = load(spark, d, "lineitem").select("l_tax", F.when(F.col("l_quantity") > 40, F.col("l_quantity")).otherwise(0.0).alias("big"))
    return spark.createDataFrame([(c,) for c in segment.median_zero_columns(df, ["big", "l_tax"])], "column string")


@query("cluster_label_map", "SELECT o_orderkey, CASE WHEN c_nationkey < 20 THEN c_nationkey % 6 END::INT AS cluster FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def cluster_label_map(spark, d):
    labels = load(spark, d, "customer").filter("c_nationkey < 20").select("c_custkey", (F.col("c_nationkey") % 6).alias("label"))
    return segment.label_rows(load(spark, d, "orders"), "o_custkey", labels, "c_custkey", "label").select("o_orderkey", "cluster")


@query("get_count_by_detected_entities", "SELECT unnest(string_split(p_type, ' ')) AS label, count(*) AS n FROM part GROUP BY 1")
def get_count_by_detected_entities(spark, d):
    return segment.entity_counts(load(spark, d, "part").select(F.split("p_type", " ").alias("labels")), "labels")


@query("identity_tokenizer", "SELECT p_partkey, len(string_split(p_type, ' '))::INT AS n FROM part")
def identity_tokenizer(spark, d):
    return load(spark, d, "part").select("p_partkey", F.size(text.identity_tokens(F.split("p_type", " "))).alias("n"))


@query("list_concat", "SELECT Id, title, body, title + body AS n FROM (SELECT DISTINCT Id, len(string_split(Title, ' '))::INT AS title, len(string_split(Body, ' '))::INT AS body FROM questions WHERE Title IS NOT NULL AND Body IS NOT NULL)")
def list_concat(spark, d):
    t, b = F.split("Title", " "), F.split("Body", " ")
    return load(spark, d, "questions").filter("Title is not null and Body is not null").select("Id", F.size(t).alias("title"), F.size(b).alias("body"), F.size(F.concat(t, b)).alias("n")).distinct()


@query("main_energy_type", """SELECT OSEBuildingID, CASE WHEN greatest(e, g, s) IS NULL OR greatest(e, g, s) <= 0 THEN NULL WHEN e = greatest(e, g, s) THEN 'electricity' WHEN g = greatest(e, g, s) THEN 'gas' ELSE 'steam' END AS main, (YearBuilt < 2000)::INT AS old
    FROM (SELECT OSEBuildingID, YearBuilt, "Electricity(kBtu)" AS e, "NaturalGas(kBtu)" AS g, "SteamUse(kBtu)" AS s FROM benchmarking_2016)""")
def main_energy_type(spark, d):
    shares = {"electricity": F.col("`Electricity(kBtu)`"), "gas": F.col("`NaturalGas(kBtu)`"), "steam": F.col("`SteamUse(kBtu)`")}
    return load(spark, d, "benchmarking_2016").select("OSEBuildingID", scalars.largest_of(shares).alias("main"), (F.col("YearBuilt") < 2000).cast("int").alias("old"))


@query("clean_string", r"SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^0-9a-z]+', ' ', 'g')) AS key FROM customer")
def clean_string(spark, d):
    return load(spark, d, "customer").select("c_custkey", relate.street_key(F.col("c_name")).alias("key"))


@query("apply_polling_stations_redistricting", """WITH a AS (SELECT c_custkey, c_nationkey AS street, c_custkey % 100 AS number FROM customer),
    r AS (SELECT n_nationkey AS street, n_nationkey * 10 + i AS station, i * 50 + 1 AS lo, CASE WHEN i = 1 THEN 2000 ELSE 50 END AS hi, n_regionkey = 0 AS even FROM nation, (SELECT unnest([0, 1]) AS i) WHERE n_nationkey % 2 = 0)
    SELECT c_custkey, coalesce(min(station), -1)::INT AS station FROM a LEFT JOIN r ON a.street = r.street AND number BETWEEN lo AND hi AND (NOT even OR number % 2 = 0) GROUP BY 1""")
def apply_polling_stations_redistricting(spark, d):
    addresses = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("street"), (F.col("c_custkey") % 100).cast("int").alias("number"), F.lit(-1).alias("station"))
    half = F.explode(F.array(F.lit(0), F.lit(1)))
    n = load(spark, d, "nation").filter("n_nationkey % 2 = 0").select("n_nationkey", "n_regionkey", half.alias("i"))
    ranges = n.select(F.col("n_nationkey").alias("street"), (F.col("n_nationkey") * 10 + F.col("i")).alias("polling_station_id"), (F.col("i") * 50 + 1).alias("number_start"), F.when(F.col("i") == 1, 9999).otherwise(50).alias("number_stop"), F.when(F.col("n_regionkey") == 0, "Yes").otherwise("No").alias("even_numbers_only"), F.lit("No").alias("odd_numbers_only"))
    return relate.redistrict(addresses, ranges).select("c_custkey", "station")


# models


@query("get_max_components", "SELECT least(4, (SELECT count(*) FROM orders) - 1)::INT AS components")
def get_max_components(spark, d):
    return spark.createDataFrame([(ml.max_components(4, load(spark, d, "orders").count()),)], "components int")


@query("assign_topics", "SELECT vec_id, list_position(embedding, list_max(embedding))::INT AS topic FROM embeddings")
def assign_topics(spark, d):
    return load(spark, d, "embeddings").select("vec_id", ml.topic_of(F.col("embedding")).alias("topic"))


_F1 = """WITH x AS (SELECT unnest([v > 0 for v in embedding]) AS y, unnest([v > 0.5 for v in list_reverse(embedding)]) AS p FROM embeddings)
SELECT round(2.0 * count(*) FILTER (y AND p) / (count(*) FILTER (y) + count(*) FILTER (p)), 8)::DOUBLE AS f1 FROM x"""


def _micro_f1(spark, d):
    df = load(spark, d, "embeddings").select(F.transform("embedding", lambda v: (v > 0).cast("int")).alias("y"), F.transform(F.reverse("embedding"), lambda v: F.when(v > 0.5, 0.9).otherwise(0.5)).alias("p"))
    return evaluate.micro_f1(df, "y", "p").select(F.round("f1", 8).alias("f1"))


query("keras_f1_score", _F1)(_micro_f1)
query("f1_score", _F1)(_micro_f1)


@query("model_name", "SELECT 'KMeans' AS name")
def model_name(spark, d):
    return spark.createDataFrame([(evaluate.model_name(KMeans()),)], "name string")


@query("compare_n_predicted_results", "SELECT o_orderkey, o_orderpriority AS text, o_orderstatus AS y, CASE WHEN o_totalprice > 100000 THEN 'O' ELSE 'F' END AS p FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 10")
def compare_n_predicted_results(spark, d):
    df = load(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("y"), F.when(F.col("o_totalprice") > 100000, "O").otherwise("F").alias("p"))
    return supervised.show_predictions(df, "y", "p", "text", "o_orderkey")


def _rfm_vectors(spark, d):
    df = load(spark, d, "olist_train_data").filter("recency between 0 and 9998 and monetary_value > 0 and frequency > 0")
    one = df.groupBy("customer_id").agg(F.min(F.struct("recency", "frequency", "monetary_value")).alias("r")).select("customer_id", "r.*")
    return one.select("customer_id", F.col("recency").cast("double").alias("recency"), F.ln("frequency").alias("frequency"), F.ln("monetary_value").alias("monetary"))


@query("get_optimal_kmeans_feature_set")
def get_optimal_kmeans_feature_set(spark, d):
    rounds = ml.search_features(_rfm_vectors(spark, d).cache(), ["recency", "frequency", "monetary"], range(2, 4), start=2)
    return spark.createDataFrame([(" ".join(r["features"]), r["k"], r["silhouette"]) for r in rounds], "features string, k int, silhouette double")


@query("kmeans_stability")
def kmeans_stability(spark, d):
    runs = ml.stability(ml.assemble(_rfm_vectors(spark, d), ["recency", "frequency", "monetary"]).cache(), 3, range(3))
    return spark.createDataFrame(runs[:1], "seed int, silhouette double")


@query("get_n_clusters", "SELECT i::INT AS id, CASE WHEN i < 4 THEN 0 WHEN i < 7 THEN 1 ELSE 2 END::INT AS cluster FROM range(10) t(i)")
def get_n_clusters(spark, d):
    import numpy as np

    labels = ml.ward(np.array([[i + 100.0 * ((i > 3) + (i > 6))] for i in range(10)]), 3)
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "id int, cluster int")


# geometry


@query("transform_geocoded_df_to_geopandas_df", f"SELECT id, x, y, 4326::INT AS srid FROM ({_BUILDINGS})")
def transform_geocoded_df_to_geopandas_df(spark, d):
    return geo.with_points(_buildings(spark, d)).select("id", "point.x", "point.y", "srid")


@query("add_crs_to_gdf", f"SELECT 2154::INT AS srid, count(*) AS n FROM ({_BUILDINGS})")
def add_crs_to_gdf(spark, d):
    return geo.with_points(_buildings(spark, d), srid=2154).groupBy("srid").agg(F.count(F.lit(1)).alias("n"))


_FEET = "WITH p AS (SELECT id, radians(y) AS f, radians(x + 124 - 3) AS l FROM ({b})) SELECT id, round(degrees(f), 7) AS y, round(degrees(l) + 3, 7) AS x FROM p"


def _back(spark, d):
    df = _buildings(spark, d)
    x, y = scalars.lambert93(F.col("y"), F.col("x") + 124)
    lat, lon = scalars.from_lambert93(F.col("a"), F.col("b"))
    return df.select("id", x.alias("a"), y.alias("b")).select("id", F.round(lat, 7).alias("y"), F.round(lon, 7).alias("x"))


query("reverse_layers_geodetic_system_conversion_from_geometry", _FEET.format(b=_BUILDINGS))(_back)


@query("convert_geodetic_system_from_geometry", f"SELECT count(*) AS n, sum((abs(x) < 180)::INT)::BIGINT AS inside FROM ({_BUILDINGS})")
def convert_geodetic_system_from_geometry(spark, d):
    df = _buildings(spark, d).select(F.array(geometry.point(F.col("x") + 124, F.col("y"))).alias("g"))
    x, y = scalars.lambert93(F.col("g")[0]["y"], F.col("g")[0]["x"])
    near = x.between(-500000, 1500000) & y.between(5500000, 7500000)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(near.cast("long")).alias("inside"))


def _vincenty_sql() -> str:
    """Twelve rounds of the iteration, each a subquery over the one before; the fixed values are those of ``scalars.vincenty``."""
    start = f"SELECT id, atan((1 - 1 / 298.257223563) * tan(radians(y))) AS u1, atan((1 - 1 / 298.257223563) * tan(radians(46.6))) AS u2, radians(-121.2 - x) AS l, radians(-121.2 - x) AS lam FROM ({_BUILDINGS})"
    parts = """SELECT *, ss, cs, sa, 1 - sa * sa AS c2a, cs - coalesce(2 * sin(u1) * sin(u2) / nullif(1 - sa * sa, 0), 0) AS cm FROM (SELECT *, coalesce(cos(u1) * cos(u2) * sin(lam) / nullif(ss, 0), 0) AS sa
    FROM (SELECT *, sqrt((cos(u2) * sin(lam)) ^ 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ^ 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM ({})))""".replace("SELECT *, ss, cs, sa,", "SELECT *,")
    f = "(1 / 298.257223563)"
    for _ in range(12):
        c = f"({f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)))"
        start = f"SELECT id, u1, u2, l, l + (1 - {c}) * {f} * sa * (atan2(ss, cs) + {c} * ss * (cm + {c} * cs * (2 * cm * cm - 1))) AS lam FROM ({parts.format(start)})"
    a, b = "6378137.0::DOUBLE", f"(6378137.0::DOUBLE * (1 - {f}))"
    u = f"SELECT *, c2a * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS u FROM ({parts.format(start)})"
    k = f"SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small FROM ({u})"
    return f"SELECT id, round({b} * big * (atan2(ss, cs) - small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 3) AS metres FROM ({k})"


@query("geodesic_distance_on_ellipsoid", _vincenty_sql())
def geodesic_distance_on_ellipsoid(spark, d):
    return _buildings(spark, d).select("id", F.round(scalars.vincenty(F.col("y"), F.col("x"), F.lit(46.6), F.lit(-121.2)), 3).alias("metres"))


def _cells(spark, d):
    """The unit squares of a grid that hold buildings, with the smallest building id and a station (null in every third)."""
    df = _buildings(spark, d).groupBy(F.floor(F.col("x") * 50).alias("cx"), F.floor(F.col("y") * 50).alias("cy")).agg(F.min("id").alias("cell"))
    at = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    ring = F.array(*[geometry.point(F.col("cx") + i, F.col("cy") + j) for i, j in at])
    return df.select("cell", F.when(F.col("cell") % 3 > 0, F.col("cell") % 4).alias("station"), ring.alias("outline"))


_CELLS = f"(SELECT min(id) AS cell, CASE WHEN min(id) % 3 > 0 THEN min(id) % 4 END AS station, cx, cy FROM (SELECT id, floor(x * 50) AS cx, floor(y * 50) AS cy FROM ({_BUILDINGS})) GROUP BY cx, cy)"


@query("dissolve_polygons_by_place_uid", f"SELECT station, count(*)::DOUBLE AS area FROM {_CELLS} WHERE station IS NOT NULL GROUP BY 1")
def dissolve_polygons_by_place_uid(spark, d):
    rings = geo.dissolve(_cells(spark, d), "station", "outline")
    return rings.groupBy("station").agg(F.round(F.sum(geometry.area(F.col("ring"))), 6).alias("area"))


_LIMITS = f"""WITH c AS (SELECT * FROM {_CELLS}), u AS (SELECT * FROM c WHERE station IS NULL), k AS (SELECT * FROM c WHERE station IS NOT NULL),
s AS (SELECT u.cell, k.station, count(*)::DOUBLE AS length FROM u JOIN k ON abs(u.cx - k.cx) + abs(u.cy - k.cy) = 1 GROUP BY 1, 2), b AS (SELECT cell, arg_min(station, (-length, station)) AS station, max(length) AS length FROM s GROUP BY 1)
SELECT u.cell, b.station, b.length FROM u LEFT JOIN b USING (cell)"""


def _limits(spark, d):
    c = _cells(spark, d)
    return geo.largest_common_limit(c.filter("station is null").drop("station"), c.filter("station is not null"), "cell", "station", "outline")


query("find_largest_common_limit", _LIMITS)(_limits)


@query("common_limits_by_place_uid_tester", f"SELECT CASE WHEN station IS NULL THEN 'passed' ELSE 'failed' END AS part, count(*) AS n FROM ({_LIMITS}) GROUP BY 1")
def common_limits_by_place_uid_tester(spark, d):
    parts = geo.split_by_key(_limits(spark, d), "station")
    return parts["passed"].select(F.lit("passed").alias("part")).unionAll(parts["failed"].select(F.lit("failed"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("geometry_type_condition", f"SELECT CASE WHEN cell % 3 = 0 THEN 'POLYGON' WHEN cell % 3 = 1 THEN 'LINESTRING' ELSE 'POINT' END AS kind, count(*) AS n FROM {_CELLS} GROUP BY 1")
def geometry_type_condition(spark, d):
    cut = F.when(F.col("cell") % 3 == 0, F.lit(5)).when(F.col("cell") % 3 == 1, F.lit(2)).otherwise(F.lit(1))
    return _cells(spark, d).select(geometry.kind(F.slice("outline", F.lit(1), cut)).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_HOLE = f"SELECT cell, 1.0::DOUBLE AS area FROM {_CELLS}"


def _filled(spark, d):
    inner = F.transform("outline", lambda p: F.struct(((p["x"] * 2 + F.col("outline")[2]["x"]) / 3).alias("x"), ((p["y"] * 2 + F.col("outline")[2]["y"]) / 3).alias("y")))
    return _cells(spark, d).select("cell", geometry.area(geometry.exterior(F.array("outline", inner))).alias("area"))


query("rebuild_polygon_from_exterior_coordinates", _HOLE)(_filled)
query("fill_holes_within_polygons_interiors", _HOLE)(_filled)


@query("get_geometric_difference_from_binaries", f"SELECT encode(cx::BIGINT || ' ' || cy::BIGINT)::VARCHAR AS b FROM {_CELLS} WHERE cell % 2 = 0")
def get_geometric_difference_from_binaries(spark, d):
    c = _cells(spark, d).select("cell", F.encode(F.concat_ws(" ", F.col("outline")[0]["x"].cast("long"), F.col("outline")[0]["y"].cast("long")), "UTF-8").alias("b"))
    left = reshape.difference(c, c.filter("cell % 2 = 1"), "b")
    return left.select(F.decode("b", "UTF-8").alias("b"))


queries, oracle_sql = query.queries, query.oracle_sql
