"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from turnmill.plans import registry
from turnmill.session import build_session, staging

HEADLINE = (
    "pack_summary", "encode_pretrain", "vocab_build", "pack_range_plan", "pack_soft", "pack_soft_blended",
    "length_grouped", "length_grouped_modality", "padding_efficiency", "global_prefix_sum", "turn_pairing",
    "chatml_merge", "template_catalog", "region_join", "circular_eval", "dpo_losses", "gae", "reward_normalize",
    "vision_tokens", "token_accounting", "instruction_fanout", "fmt_react", "region_filter", "preset_corpora", "encode_sft_vocab",
    "stream_encode", "stream_pack",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("turnmill-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    times = {}
    registry.QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        start = time.perf_counter()
        with staging(spark):
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
