"""Per-entity feature table from an event stream.

A Structured Streaming query over the event files keeps two checkpointed states in RocksDB: the event ids
seen so far, so that an event delivered again counts once, and per entity and event type a counter, the
latest timestamp and a sum. Each micro-batch emits the running values of the types it changed. They are gathered into one
row per changed entity and merged with the feature table, which after every batch holds one full row for every entity.

The table is bucketed by entity, so that the merge reads it in place: only the changed rows are exchanged. A batch writes a
version of its own next to the one before; a version counts once it is complete, and the one before the last is then deleted.
A batch that is run again starts from the same version and writes the same rows.

Scale and skew: Spark aggregates each micro-batch map-side before the shuffle on (entity, type), so an entity with
a third of all events sends at most one row per type and task. The row of an entity holds one entry per event
type, which bounds it by the number of types. Nothing is collected to the driver. Lost executors: states
and versions live under the shared folder. Shuffle files of a batch are freed when the next one begins.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_ENTITY = ("", "n/a")
ROWS = "entity string, types map<string,struct<n:bigint,last:timestamp_ntz,cents:bigint>>"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every store sets megabytes aside that it never fills
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.minBatchesToRetain": "1",
}


def clean_events(events: DataFrame, until: str, entity: str = "customer_id", kind: str = "event_type", at: str = "order_purchase_date", amount: str = "monetary_value", event: str = "event_id") -> DataFrame:
    """(event, entity, kind, at, cents) of the events that count.

    Entities are trimmed of blanks and tabs and lower-cased. Events without an entity (null, blank, n/a), kind, date
    or id, or dated ``until`` or later (a wrong clock), do not count. Null and NaN amounts are 0; amounts become whole cents.
    """
    name = F.lower(F.regexp_replace(F.col(entity), r"^[ \t]+|[ \t]+$", ""))
    money = F.coalesce(F.expr(f"try_cast(round(nanvl(`{amount}`, 0D) * 100) as bigint)"), F.lit(0))
    picked = events.select(F.col(event).alias("event"), name.alias("entity"), F.col(kind).alias("kind"), F.col(at).cast("timestamp_ntz").alias("at"), money.alias("cents"))
    return picked.filter(F.col("event").isNotNull() & ~F.col("entity").isin(*NO_ENTITY) & F.col("kind").isNotNull() & (F.col("at") < F.lit(until).cast("timestamp_ntz")))


def _path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _source(spark: SparkSession, path: str) -> tuple[str, int]:
    """(path as the file stream takes it, bytes below it). A single file must be given to a stream as a pattern."""
    target, system = _path(spark, path)
    pattern = f"{path[:-1]}[{path[-1]}]" if system.getFileStatus(target).isFile() else path
    return pattern, system.getContentSummary(target).getLength()


def _versions(spark: SparkSession, table: str) -> list[tuple[int, int, str]]:
    """(batch, buckets, path) of every complete version of a feature table, oldest first."""
    target, system = _path(spark, table)
    if not system.exists(target):
        return []
    out = []
    for status in system.listStatus(target):
        name = status.getPath().getName()
        found = re.fullmatch(r"v(\d+)-(\d+)", name)
        if found and system.exists(_path(spark, f"{table}/{name}/_SUCCESS")[0]):
            out.append((int(found[1]), int(found[2]), f"{table}/{name}"))
    return sorted(out)


def _drop(spark: SparkSession, path: str) -> None:
    target, system = _path(spark, path)
    system.delete(target, True)


def _name(path: str) -> str:
    return "features_" + hashlib.md5(path.encode()).hexdigest()


def upsert_features(changed: DataFrame, table: str, batch: int) -> None:
    """Merge changed (entity, kind, n, last, cents) values into the table: the next version holds every entity's full row.

    The version before is read by buckets, as many as there are shuffle partitions, so it is neither exchanged nor collected.
    """
    spark = changed.sparkSession
    gc.collect()  # here and in the JVM: lets go of the batch before, and with it of its shuffle files
    spark.sparkContext._jvm.System.gc()
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{table}/v{batch:09d}-{buckets}"
    before = [v for v in _versions(spark, table) if v[0] < batch]
    fresh = changed.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("n", "last", "cents")))).alias("types"))
    if before:
        _, n, old = before[-1]
        spark.sql(f"DROP TABLE IF EXISTS {_name(old)}")
        spark.sql(f"CREATE TABLE {_name(old)} ({ROWS}) USING parquet CLUSTERED BY (entity) INTO {n} BUCKETS LOCATION '{old}'")
        stored = spark.table(_name(old)).withColumnRenamed("types", "stored")
        kept = F.map_filter("stored", lambda k, _: ~F.map_contains_key("types", k))
        merged = F.when(F.col("stored").isNull(), F.col("types")).when(F.col("types").isNull(), F.col("stored")).otherwise(F.map_concat(kept, "types"))
        fresh = fresh.join(stored.hint("shuffle_hash"), "entity", "full").select("entity", merged.alias("types"))
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    _drop(spark, path)  # of an attempt that failed
    fresh.write.format("parquet").option("path", path).bucketBy(buckets, "entity").saveAsTable(_name(path))
    for _, _, old in before:
        spark.sql(f"DROP TABLE IF EXISTS {_name(old)}")
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")  # of the catalog; the files stay
    for _, _, old in before[:-1]:
        _drop(spark, old)


def update_features(spark: SparkSession, source: str, table: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame], batches: int = 3) -> None:
    """Bring the feature table up to date with the event files of ``source``.

    Files that the checkpoint already knows are not read again, so the call may be repeated as files arrive.
    ``batches`` is the number of micro-batches that the files present are taken in.
    """
    stream_spark = spark.newSession()  # the state store setting stays out of the caller's session
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes"):
        stream_spark.conf.set(key, spark.conf.get(key))
    for key, value in STATE.items():
        stream_spark.conf.set(key, value)
    path, size = _source(spark, source)
    events = stream_spark.readStream.schema(spark.read.parquet(source).schema).option("maxBytesPerTrigger", max(1, -(-size // batches))).parquet(path)
    once = clean(events).dropDuplicates(["event"])
    running = once.groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"), F.sum("cents").alias("cents"))
    upsert = lambda changed, batch: upsert_features(changed, table, batch)
    query = running.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    for _, _, old in _versions(spark, table)[:-1]:
        _drop(spark, old)


def current_features(spark: SparkSession, table: str) -> DataFrame:
    """entity, types (kind -> n, last, cents): the newest complete version of the table, one row per entity; no rows before the first batch."""
    versions = _versions(spark, table)
    return spark.read.schema(ROWS).parquet(versions[-1][2]) if versions else spark.createDataFrame([], ROWS)


def feature_rows(current: DataFrame, as_of: str) -> DataFrame:
    """One row per entity: totals, and of each event type its count, recency in days at ``as_of`` and total.

    Types that an entity never had are missing from its map; ``spread`` turns them into columns.
    """
    day = F.lit(as_of).cast("timestamp_ntz").cast("date")
    values = F.map_values("types")

    def total(name: str) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v[name])

    entry = F.transform_values("types", lambda _, v: F.struct(v["n"].alias("count"), v["last"].alias("last"), F.datediff(day, v["last"].cast("date")).alias("recency"), v["cents"].alias("cents")))
    return current.select("entity", total("n").alias("events"), F.array_max(F.transform(values, lambda v: v["last"])).alias("last"), total("cents").alias("cents"), entry.alias("types"))


def spread(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """The map as columns count_<type>, recency_<type>, total_<type>: 0, null and 0 where an entity never had the type."""
    columns = []
    for kind in kinds:
        value = F.col("types")[kind]
        columns += [F.coalesce(value["count"], F.lit(0)).alias(f"count_{kind}"), value["recency"].alias(f"recency_{kind}"), (F.coalesce(value["cents"], F.lit(0)) / 100).alias(f"total_{kind}")]
    return rows.select("entity", *columns)


def entity_features(spark: SparkSession, source: str, until: str, batches: int = 3, **names: str) -> DataFrame:
    """The whole way over the event files of ``source``: stream, upsert, one row per entity.

    An empty source gives no rows. Recency is counted at ``until``.
    """
    table, checkpoint = scratch_path(spark, "features"), scratch_path(spark, "features-state")
    update_features(spark, source, table, checkpoint, lambda e: clean_events(e, until, **names), batches)
    return feature_rows(current_features(spark, table), until)
