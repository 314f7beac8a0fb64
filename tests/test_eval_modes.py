"""Every mode is evaluated."""

from corpusloom import catalogue
from corpusloom.queries.retrieval import MODES

SF = "/root/testdata/sf0.001"


def test_every_mode_is_evaluated(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.mode: r for r in catalogue.QUERIES["eval_modes"](spark, SF).collect()}
    assert set(got) == set(MODES) | {"vector"} and {r.n_queries for r in got.values()} == {len(items)}
    assert got["lexical"] == catalogue.QUERIES["eval_metrics"](spark, SF).first()
    for mode in ("naive_chunk", "parent_document", "raw_file"):
        hits = {i: [] for i in items}
        for r in MODES[mode](spark, SF).orderBy("rank").collect():
            d = r.doc_id if mode == "raw_file" else int((r.parent_id if mode == "parent_document" else r.doc_id).split("-")[0])
            hits[r.query_id].append(items[r.query_id] in (docs[d] or ""))
        n = len(items)
        assert abs(got[mode].hit_at_k - sum(map(any, hits.values())) / n) < 1e-6
        assert abs(got[mode].mrr - sum(1 / (h.index(True) + 1) for h in hits.values() if any(h)) / n) < 1e-6
        assert abs(got[mode].citation_precision - sum(sum(h) / len(h) for h in hits.values() if h) / n) < 1e-6
