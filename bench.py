"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Arguments pick other queries;
``all`` runs the whole catalogue.
"""

from __future__ import annotations

import json
import os
import sys
import time

from kifulake.plans import adapters
from kifulake.plans.catalog import QUERIES
from kifulake.session import build_session

HEADLINE = (
    "bucket_histogram", "band_sample", "epoch_expand", "segment_games", "fixed_holdout_set", "strided_sample_scan",
    "superbatch_assign", "wrm_loss_general", "importance_weighted_loss", "ablation_delta", "holdout_report",
    "bucket_histogram_per_file", "active_count_stats", "cumulative_snapshots", "weight_saturation", "tensor_diff",
    "pair_norm_breakdown", "ablate_rows_random", "run_best", "bench_summary", "progress_score", "progress_gradient",
    "adam_step", "canonical_dead_edge", "edge_pair_breakdown", "edge_invariant_check", "decode_positions",
    "attack_edges", "kp_progress_features", "effect_bucket_features", "psv_scan", "stream_active_histogram",
    "half_features", "edge_feature_index", "edge_feature_index_dedup", "attacker_counts", "sfen_move_lists", "training_view",
    "progress_bucket_survey", "batch_score_positions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if list(names) == ["all"]:
        names = tuple(QUERIES)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the engine with one whole query, so that no timed one carries its start-up
    QUERIES["bucket_histogram"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    if not sys.argv[1:]:  # the boards that many queries make first, by themselves
        start = time.perf_counter()
        adapters.v_board(spark, sf_dir).write.format("noop").mode("overwrite").save()
        print(f"board synthesis alone {time.perf_counter() - start:.3f}", file=sys.stderr, flush=True)
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
