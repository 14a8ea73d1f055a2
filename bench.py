"""Times headline queries and prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from leadvane.catalog import QUERIES
from leadvane.session import local_session

# Each query is timed once after one small warm-up query; the featurised leads are built by the first scored query.
HEADLINE = (
    "A5_label_source_counts", "L7_label_variants", "W1_repeat_flag", "J2_name_enrichment", "G2_v2_features", "G3_fixed_design",
    "M2_win_probability", "E1_auc", "E3_model_summary", "E4_calibration_by_decile", "E5_auc_by_month", "T3_tie_averaged_capture", "A12_value_scale",
    "A17_bottom_decile_ghosted", "V3_upload_values", "V4_transform_comparison", "E6_bootstrap_auc_interval", "E7_paired_auc_difference",
    "E9_headline_by_model", "E11_collinear_pairs", "E13_rolling_origin_auc", "E15_calibration_decay", "E16_subsampling_curve",
    "E17_customer_sized_holdout", "E8_coefficient_bootstrap", "E19_leakage_screen", "M7_penalty_sweep", "M11_batch_scoring", "J8_similar_pairs",
    "F2_text_class", "F16_redacted_texts", "C7_synthesised_events", "Q14_column_profile", "T7_stratified_sample", "R1_streamed_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    QUERIES["P5_canonical_stage"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
