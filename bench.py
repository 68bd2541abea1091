"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent), os.environ.get("PYTHONPATH", "")])

HEADLINE = (
    "boundary_f1_by_tolerance", "rle_runs", "token_stats", "token_perplexity", "clip_labels", "clip_windows_sliding", "narration_boundaries", "change_topk_boundaries",
    "video_residual", "random_boundary_f1", "bpe_first_merge", "nearest_code", "lpt_shards", "macro_f1", "token_label_nmi", "heldout_video_split",
)


def main() -> None:
    from strandline.plans.catalogue import QUERIES
    from strandline.session import session

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()  # the session's own start doesn't count
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
