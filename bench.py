"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
tables and the cores.  Every query runs to the end, into a sink that keeps
nothing.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textmill.plans.registered import QUERIES  # noqa: E402
from textmill.session import local_session  # noqa: E402

HEADLINE = [
    "quality_report", "label_conflicts", "duplicate_links", "dedup_exact", "dedup_normalized",
    "near_duplicates", "preprocess_documents", "preprocess_pages", "normalize_labels",
    "detect_mislabel", "clean_corpus", "clean_combined", "train_test_split", "stratified_folds",
    "classification_report", "shuffle_tokens", "augment_dataset", "term_counts",
    "word_vocabulary", "word_tfidf", "naive_bayes", "learning_curve", "score_documents",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["label_counts"](spark, d).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        t = time.time()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", d)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
