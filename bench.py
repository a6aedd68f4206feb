"""Times headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all), BENCH_QUERIES (comma list, or ``all``),
BENCH_LIMIT (seconds for a query, 300) and BENCH_TOTAL (seconds for all, 1500). What is over a limit is listed as failed.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import threading
import time

from wavelake.catalog import load_catalog
from wavelake.session import build_session

HEADLINE = [
    "job_quality_report",
    "agg8_metric_table",
    "agg13_si_sdr_definitions",
    "agg18_per_file_pivot",
    "flt1_metadata_checks",
    "flt9_meets_targets",
    "jn2_match_all_stages",
    "jn7_verify_output",
    "jn11_mask_from_regions",
    "jn12_place_segments",
    "jn18_draw_by_index",
    "agg1_usage_counts",
    "agg20_inventory_hash",
    "srt4_pick_distinct_categories",
    "srt9_best_lag",
    "sig4_plan_noise_chunks",
    "sig7_detect_active_regions",
    "sig8_mix_at_snr",
    "sig14_bandlimit",
    "sig24_spectrum",
    "sig30_fuse_learned",
    "win5_merge_gaps",
    "win9_collision_free_names",
    "win11_epoch_order",
    "stf1_impulse_flags",
    "stf2_erb_mean_norm",
    "stf4_nlms_cancel",
    "sca16_split_sections",
    "job2_dataset_summary",
    "job3_build_manifests",
    "job5_evaluate_systems",
    "job1_generate_dataset",
    "job4_evaluate_stages",
    "job6_clean_batch",
    "sig9_composite_noise",
    "sig12_reconstruct_check",
    "sig20_align_and_gain_match",
    "sig32_clean_chain",
]


def report(times: dict[str, float], failed: dict[str, str], folder: str) -> str:
    result = {
        "metric": "headline_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    return json.dumps(result | ({"failed": failed} if failed else {}))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = os.environ.get("BENCH_QUERIES", "")
    each, whole = (float(os.environ.get(name, default)) for name, default in (("BENCH_LIMIT", "300"), ("BENCH_TOTAL", "1500")))
    times: dict[str, float] = {}
    failed: dict[str, str] = {}

    def stop(why: str) -> None:
        """Prints what is there and ends, also where the driver is stuck in a plan."""
        failed["stopped"] = why
        print(report(times, failed, folder), flush=True)
        os._exit(0)

    signal.signal(signal.SIGTERM, lambda *_: stop("terminated"))
    last = threading.Timer(whole, stop, [f"after {whole:g} s"])
    last.daemon = True
    last.start()
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_catalog()[0]
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    # Starts the JVM code paths and the Python workers, so the first query is not charged for them.
    spark.range(1000).repartition(int(cpus)).mapInPandas(lambda parts: parts, "id BIGINT").count()
    queries["agg11_levels"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in names:
        began = time.perf_counter()
        limit = threading.Timer(each, spark.sparkContext.cancelAllJobs)
        limit.start()
        try:
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
        except Exception as error:  # noqa: BLE001 - one query must not hide the others
            failed[name] = f"{type(error).__name__} after {time.perf_counter() - began:.0f} s"
        finally:
            limit.cancel()
        print(name, times.get(name, failed.get(name)), file=sys.stderr, flush=True)
    last.cancel()
    print(report(times, failed, folder))
    spark.stop()


if __name__ == "__main__":
    main()
