"""Writers. A write that fails stops the job; nothing is swallowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags of regulated records and the type that is always routed.
REGULATED_TAGS = ("RBI_MD_IT_2023", "SEBI_CSCRF_2024")
AUDITED_TYPE = "audited_resource"


def append_audit(events: DataFrame, path: str, fmt: str = "parquet", files_per_day: int = 8) -> None:
    """Append events, one folder per day, so that retention can drop whole days.

    Rows are dealt by day and a hash of their id first, so a day gets so many files at most,
    and a day that holds most events is still written by several tasks.
    """
    part = F.pmod(F.xxhash64("event_id"), F.lit(files_per_day))
    events.repartition("event_date", part).write.mode("append").partitionBy("event_date").format(fmt).save(path)


def is_regulated(frameworks: str = "regulatory_frameworks", kind: str | None = None) -> Column:
    """True for records under a regulated framework or of the audited type."""
    tagged = F.arrays_overlap(F.col(frameworks), F.array(*[F.lit(t) for t in REGULATED_TAGS]))
    regulated = F.coalesce(tagged, F.lit(False))
    return regulated | (F.col(kind).eqNullSafe(AUDITED_TYPE)) if kind else regulated


def route_regulated(
    df: DataFrame, frameworks: str = "regulatory_frameworks", kind: str | None = None
) -> DataFrame:
    """Records that go to the regulated store."""
    return df.where(is_regulated(frameworks, kind))


def write_routed(
    df: DataFrame, path: str, frameworks: str = "regulatory_frameworks", kind: str | None = None, files: int = 8
) -> None:
    """Write records to folders ``store=regulated`` and ``store=general`` of one table, in one pass over them.

    Rows are dealt to ``files`` tasks a store by a hash of all their columns that can be hashed. A store that is read is picked by its folder.
    """
    store = F.when(is_regulated(frameworks, kind), "regulated").otherwise("general")
    simple = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    part = F.pmod(F.xxhash64(*simple), F.lit(files))
    df.withColumn("store", store).repartition("store", part).write.mode("overwrite").partitionBy("store").parquet(path)


def read_routed(spark: SparkSession, path: str, store: str = "regulated") -> DataFrame:
    return spark.read.parquet(path).where(F.col("store") == store).drop("store")
