"""The corpus pipeline: documents in, a mixed training set out.

Each stage takes what its predecessor kept. ``run`` writes each stage's rows as a table in the
shared folder and reads them again, so that a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idcordon.llm import decontam, mix, quality, rindex, setjoin
from idcordon.sources.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.kept(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingles one stays; documents without words all stay."""
    return setjoin.one_of_each(docs)


#: Bytes of a repeat that the pipeline cuts: 99 of 100 passages of 51 words are longer.
REPEAT_BYTES = 250


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long repeats are cut out of the texts; documents of which nothing is left go."""
    cut = rindex.without_repeats(docs, rindex.RepeatOptions(length=REPEAT_BYTES, anchor=REPEAT_BYTES // 2))
    rest = cut.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    kind = dict(docs.dtypes)["n_chars"]
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return rest.withColumn("n_chars", n_chars).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with ``size`` and ``taken``: their words, and how many the mix takes, repeats counted."""
    plan = mix.mix(docs, extra=True)
    return mix.taken(plan).where("taken > 0").select(*docs.columns, "size", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: Classifier, set join, suffix sorting and alignment can't be put in SQL; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
