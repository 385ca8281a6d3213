"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.  ``parse`` is
the text work; the other queries read the landed parsed records, as a run does.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from caseloom.operators.parse import parse_records  # noqa: E402
from workload import queries as q  # noqa: E402
from workload.answers import responses  # noqa: E402

HEADLINE = (
    "p1_segment_blocks", "f3_f4_j3_country", "f5_f6_numbers", "f9_f10_f15_text", "j1_validate_tokens", "j2_sector_lookup",
    "v1_a8_wide", "v2_a9_a11_long", "v3_b4_consistency", "v4_g1_g4_qa_summary", "x2_missingness_profile",
    "x5_authority_match", "x10_frequency_rollup", "x12_factor_pairs", "x15_degrees", "x16_most_similar",
    "x17_conflict_matrix", "d1_d5_header", "d3_decisions_once",
)


def write(df) -> float:
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    text = q.scratch(spark, "responses")
    responses(spark, sf_dir).write.parquet(text)
    seconds["parse"] = write(parse_records(spark.read.parquet(text)))
    q.parsed(spark, sf_dir)
    for name in HEADLINE:
        start = time.time()
        df = q.QUERIES[name](spark, sf_dir)
        planned = time.time() - start
        seconds[name] = round(planned + write(df), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
