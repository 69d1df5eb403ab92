"""Headline queries at one scale factor; prints one JSON line.

``BENCH_SF_DIR`` (default the driver's sf0.1) and ``BENCH_CPUS`` (default 8) set the data and the
cores. Every query runs to a sink that reads all rows and columns and throws them away. One run on
the smallest data warms the JVM up first. Each query then runs on the smallest data, too, so that the
seconds it takes whatever the input (``fixed``) and those for each MB of text (``per_mb``) can be told apart.
"""

from __future__ import annotations

import json
import os
import time

from seamline.session import local_session
from verification.queries import queries

HEADLINE = [
    "occurrences", "overview", "density", "unique_counts", "summary", "module_details", "detail_lines",
    "occurrence_json", "version_delta", "vec_exec", "vec_global", "vec_interface", "vec_constructor",
    "vec_assembly", "custom_detectors_and_rules", "failures", "vec_generate", "vec_reflect", "vec_test", "tokens", "loc_per_module", "packages",
    "source_files", "custom_detector", "line_column", "module_list", "top_modules", "dependents_lookup",
]


def run(spark, query, sf_dir: str) -> float:
    start = time.time()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = time.time() - start
    spark.catalog.clearCache()
    return seconds


def text_mb(spark, sf_dir: str) -> float:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(octet_length(text)) / 1e6").first()[0]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, shuffle_partitions=max(cores, 8), memory="16g")
    all_queries = queries()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    fixed: dict[str, float] = {}
    if os.path.isdir(small):
        run(spark, all_queries["occurrences"], small)
        fixed = {name: round(run(spark, all_queries[name], small), 3) for name in HEADLINE}
    times = {name: round(run(spark, all_queries[name], sf_dir), 3) for name in HEADLINE}
    more = text_mb(spark, sf_dir) - text_mb(spark, small) if fixed else 0
    per_mb = {name: round((times[name] - fixed[name]) / more, 4) for name in HEADLINE} if more > 0 else {}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "fixed": fixed, "per_mb": per_mb, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
