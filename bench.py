"""Time the headline queries on `$BENCH_SF_DIR` with `$BENCH_CPUS` cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spreadlens.plans.queries import QUERIES  # noqa: E402
from spreadlens.session import build_session  # noqa: E402

HEADLINE = (
    "latest", "trajectories", "likes_in_window", "template_clusters", "replication_curve", "listen", "folded_templates",
    "near_duplicate_pairs", "hash_embed", "match_templates", "cosine_topk", "retrieve_exemplars", "sound_clusters",
    "author_baselines", "loo_medians", "register_adoption_monthly", "normalise_text", "named_features", "captions",
    "budget_admission", "route_messages", "latency_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query, so the first headline does not pay for the JVM's start.
    QUERIES["author_baselines"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    scale = float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"))
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
