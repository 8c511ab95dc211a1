"""An audit trail that is stored exactly once: a batch that is written again, or broken off, changes nothing.

Below the trail's path lie three tables, each with one folder a batch:

* ``records``: the events with their hashes, by day;
* ``ends``: the end of each chain that the batch went on with, from which the next batch goes on;
* ``done``: one row, written last, which makes the batch count.

Readers see the records of batches that are done. What a broken batch left behind is never seen, and is
replaced when a batch of that name is written again. An event is known by its place, (chain, seq, event_id). A trail has one writer at a time.
"""

from __future__ import annotations

import json
import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idcordon.config import RETENTION_DAYS
from idcordon.functions.sql import name
from idcordon.operators.audit import chain_events, last_hashes


def _there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _folder(path: str, table: str, batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError("a batch is named by letters, digits, '_', '.' and '-'")
    return f"{path.rstrip('/')}/{table}/batch=b-{batch}"  # the letter keeps the name a string


def _done(spark: SparkSession, path: str) -> DataFrame | None:
    """(batch, schema) of each batch that counts; None if there is none yet."""
    done = f"{path.rstrip('/')}/done"
    if not _there(spark, done):
        return None
    rows = spark.read.schema("schema string, batch string").parquet(done)
    return None if rows.isEmpty() else rows


def _committed(spark: SparkSession, path: str, table: str, but: str | None = None) -> DataFrame | None:
    """A table's rows of batches that count; ``but``: a batch that is being written, whose folder may be going."""
    done = _done(spark, path)
    if done is None:
        return None
    fields = {}
    for r in done.select("schema").distinct().collect():  # as many as the records had schemas
        fields |= {f.name: f for f in T.StructType.fromJson(json.loads(r.schema)).fields}
    kinds = {"records": list(fields.values()), "ends": [fields["chain_id"], *_END]}[table]
    rows = spark.read.schema(T.StructType([*kinds, T.StructField("batch", T.StringType())])).parquet(f"{path.rstrip('/')}/{table}")
    if but is not None:
        rows = rows.where(F.col("batch") != f"b-{but}")
    return rows.join(done, "batch", "left_semi").drop("batch")


_END = [T.StructField("last_hash", T.StringType()), T.StructField("last_seq", T.LongType()), T.StructField("last_event_id", T.StringType())]


def read_trail(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """The records of all batches that are done; the name of their batch is left out."""
    found = _committed(spark, path, "records", but)
    if found is None:
        raise ValueError(f"no batch is done in {path}")
    return found


def _same(columns: list[str]) -> Column:
    return F.expr(" AND ".join(f"a.{name(c)} <=> b.{name(c)}" for c in columns))


def chain_ends(spark: SparkSession, path: str, but: str | None = None) -> DataFrame | None:
    """The end of each chain over all batches that are done."""
    ends = _committed(spark, path, "ends", but)
    if ends is None:
        return None
    end = F.max(F.struct("last_seq", "last_event_id", "last_hash")).alias("end")
    return ends.groupBy("chain_id").agg(end).select("chain_id", "end.*")


def write_batch(events: DataFrame, path: str, batch: str, salt: str, files_per_day: int = 8) -> T.StructType:
    """Write a batch's records and ends and give the records' schema; the batch doesn't count before ``commit``.

    Events that the trail holds are left out, and so are repeats of an event inside the batch. The others go on from the
    ends of their chains. An event whose place comes before its chain's end, or that has no seq, is stored with null
    hashes, so that it is neither lost nor forged into the chain.
    """
    spark = events.sparkSession
    place = ["chain_id", "seq", "event_id"]
    ends = chain_ends(spark, path, but=batch)
    if ends is None:
        fresh, behind, resume = events.where("seq IS NOT NULL"), events.where("seq IS NULL"), None
    else:
        placed = events.alias("a").join(ends.alias("b"), _same(["chain_id"]), "left").select("a.*", "last_seq", "last_event_id")
        # Places are compared as pairs; a null id comes first.
        after = "seq IS NOT NULL AND (last_seq IS NULL OR struct(seq, event_id) > struct(last_seq, last_event_id))"
        fresh = placed.where(after).drop("last_seq", "last_event_id")
        behind = placed.where(f"NOT ({after})").drop("last_seq", "last_event_id")
        resume = ends.alias("a").join(events.select("chain_id").distinct().alias("b"), _same(["chain_id"]), "left_semi")
        # The day is part of what is compared, so that only the days of such events are read.
        known = read_trail(spark, path, but=batch).select(*place, "event_date")
        behind = behind.alias("a").join(known.alias("b"), _same([*place, "event_date"]), "left_anti")
    linked = chain_events(fresh, salt, resume=resume).where("event_hash IS NOT NULL")
    none = F.lit(None).cast("string")
    others = behind.dropDuplicates(place).withColumns({"prev_event_hash": none, "event_hash": none})
    part = F.pmod(F.xxhash64("event_id"), F.lit(files_per_day))
    records = _folder(path, "records", batch)
    (
        linked.unionByName(others)
        .repartition("event_date", part)
        .write.mode("overwrite")
        .partitionBy("event_date")
        .parquet(records)
    )
    written = spark.read.schema(linked.schema).parquet(records)
    last_hashes(written).write.mode("overwrite").parquet(_folder(path, "ends", batch))
    return linked.schema


def drop_expired(spark: SparkSession, path: str, today: str, days: int = RETENTION_DAYS) -> int:
    """Remove the folders of days that are no longer kept on ``today`` (a date); how many.

    Whole folders go and nothing is rewritten. The ends of chains stay, so that chains go on; the first record
    that is left of a chain has nothing before it.
    """
    first = date.fromisoformat(today) - timedelta(days=days)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    days_of = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/records/batch=*/event_date=*")
    files = days_of.getFileSystem(conf)
    gone = 0
    for status in files.globStatus(days_of) or []:
        day = status.getPath().getName().partition("=")[2]
        if re.fullmatch(r"\d{4}-\d\d-\d\d", day) and date.fromisoformat(day) < first:
            files.delete(status.getPath(), True)
            gone += 1
    return gone


def commit(spark: SparkSession, path: str, batch: str, schema: T.StructType) -> None:
    """From now on the batch counts. One row, with the records' schema, in one file: it is there or not."""
    row = spark.range(1).select(F.lit(schema.json()).alias("schema"))
    row.coalesce(1).write.mode("overwrite").parquet(_folder(path, "done", batch))


def append_once(events: DataFrame, path: str, batch: str, salt: str, files_per_day: int = 8) -> bool:
    """Add a batch of audit events to the trail, unless that batch is done; whether it was added.

    ``events``: see ``audit_events``; with chain_id, seq, event_id and event_date.
    """
    spark = events.sparkSession
    done = _done(spark, path)
    if done is not None and not done.where(F.col("batch") == f"b-{batch}").isEmpty():
        return False
    commit(spark, path, batch, write_batch(events, path, batch, salt, files_per_day))
    return True


def append_stream(events: DataFrame, path: str, salt: str, checkpoint: str) -> None:
    """Append all that has arrived of a stream of audit events, micro-batch by micro-batch, each exactly once.

    A micro-batch that runs again after a failure has the same number and rows.
    """
    query = (
        events.writeStream.foreachBatch(lambda rows, n: append_once(rows, path, f"stream-{n}", salt) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
