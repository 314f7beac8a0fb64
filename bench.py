"""Times of the headline queries: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

import contextlib
import json
import os
import re
import statistics
import sys
import time

from corpusloom import catalogue
from corpusloom.session import build

HEADLINE = ("text_blocks", "fixed_chunks", "greedy_chunks", "postings_index", "bm25_fallback", "bm25_phrase", "vector_topk", "neighbors", "ann_topk", "hybrid_rrf", "concept_promotion", "section_tree", "eval_metrics", "unicode_smuggling", "sentences_denoised", "stream_windows")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", cpus, **{"spark.sql.shuffle.partitions": cpus})
    run = lambda f: f(spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(catalogue.QUERIES["bm25_fallback"])  # compiles code and touches memory
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            began = time.perf_counter()
            run(catalogue.QUERIES[name])
            took.append(time.perf_counter() - began)
            if took[0] > 20:
                break
        times[name] = round(statistics.median(took), 3)
    extra = {}
    with contextlib.suppress(KeyError):
        near = {(r.query_id, r.doc_id) for r in catalogue.QUERIES["vector_topk"](spark, sf_dir).collect()}
        found = {(r.query_id, r.doc_id) for r in catalogue.QUERIES["ann_topk"](spark, sf_dir).collect()}
        extra["ann_recall_at_10"] = round(len(near & found) / max(1, len(near)), 4)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "sum of median wall seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf[1]) if sf else None, "cpus": int(cpus), **extra}))


if __name__ == "__main__":
    sys.exit(main())
