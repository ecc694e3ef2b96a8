"""Headline queries on one machine: prints one JSON line. Each query runs once, results are counted by Spark's noop sink."""

from __future__ import annotations

import json
import os
import time

from leafmill import registry
from leafmill.session import local_session

HEADLINE = (
    "corpus_summary exact_dedup script_counts email_acronym_anchors repeated_lines running_values contains_join anchor_overlap three_level_gate chunk_text "
    "pack_batches overlap_bind box_pairs nearest_boxes layout_order union_area inversion_count union_length set_reconciliation render_contract carry_forward risk_rank_budget metric_summary"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "8g"))
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
