"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is timed end to end (plan + full execution) with a no-op write
sink, so every row is produced without collecting to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from admitflow.plans import catalog  # noqa: E402
from admitflow.session import build_session  # noqa: E402

HEADLINE = [
    "tfidf",                 # flagship: note TF-IDF job (M6)
    "clean_labels",          # label curation (A1 A2 J1)
    "scaled_rows",           # sequence scaler fit + standardise (A4 J7 X15)
    "mean_pool",             # vector mean pool (A3)
    "note_stats",            # dense note statistics (A6)
    "assemble",              # sample assembly (M8)
    "related_notes_contains",  # substring theta join, hash form (J4)
    "padding_masks",         # batches + masks (W5 X20)
    "collate",               # padded batches (M9)
    "kfold",                 # exact + hash folds (W3)
    "roc_auc",               # exact AUC with ties (A11)
    "attention_pool",        # softmax pooling (A16)
    "pooled_embeddings",     # token mean pool (A13)
    "fit_and_score",         # weighted model fit + batch scoring (M2 M3)
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        catalog.REGISTRY[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(d.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
