"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from idcordon.config import ScanOptions  # noqa: E402
from idcordon.operators import audit, report  # noqa: E402
from idcordon.operators.redact import apply_action_mode  # noqa: E402
from idcordon.plans import oracle, registry  # noqa: E402
from idcordon.sources.shared import drop_shared  # noqa: E402
from idcordon.plans.views import PARTITIONS, dealt  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "card_documents", "scan_spans", "resolve_overlaps", "text_report", "detections_rollup",
    "framework_rollup", "validate_aadhaar", "validate_gstin", "validate_any", "extract_text",
    "policy_reason_codes", "two_stage_gate", "tool_gate", "control_coverage", "chain_events",
    "verify_links", "turn_block_state", "turn_block_stream",
)


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, resolve, redact and report all documents."""
    options = ScanOptions(action_mode="MASK")
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return apply_action_mode(report.text_report(docs, "text", options), "text", options)


def audit_build_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the chains and verify links and hashes."""
    trail = registry.stored_trail(spark, sf_dir)
    linked = audit.verify_links(audit.verify_hashes(trail, oracle.SALT))
    return linked.where("broken OR altered")


def run(spark: SparkSession, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("idcordon-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config(PARTITIONS, CPUS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: registry.QUERIES[name] for name in HEADLINE}
    queries["scan_documents"] = scan_documents
    queries["audit_build_verify"] = audit_build_verify
    run(spark, scan_documents, SF_DIR)  # warm-up of the JVM
    times = {name: run(spark, query, SF_DIR) for name, query in queries.items()}
    drop_shared(spark)
    size = spark.read.parquet(f"{SF_DIR}/documents.parquet").agg(
        F.count("*"), F.sum(F.octet_length("text"))
    ).first()
    seconds = times["scan_documents"]
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "scan_texts_per_sec": round(size[0] / seconds),
                "scan_mb_per_sec": round(size[1] / seconds / 1e6, 1),
            }
        )
    )


if __name__ == "__main__":
    main()
