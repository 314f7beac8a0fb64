import corpus_pipeline as P

from corpusloom.llm._shared import shared_folder

from . import test_neardup, test_packing, test_substring
from .conftest import words


def test_stages_are_those_of_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf)
        assert docs.columns == list(P.COLUMNS)
        after = {r.doc_id: r.text for r in docs.collect()}
        kept.append(len(after))
        if name == "quality rules":
            assert all(len(words(t)) >= 20 for t in after.values())
        elif name == "near duplicates":
            assert set(after) == {r[0] for r in test_neardup.brute(list(before.items())) if r[3]}
        elif name == "repeated passages":
            want = {d: (before[d] if not n else t) for d, _, n, _, t in test_substring.brute(list(before.items()))}
            assert after == want
        else:
            items = [words(r.text, True) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            whole = lambda t: any(" ".join(i) in " ".join(words(t, True)) for i in items)  # noqa: B023, E731
            assert not any(whole(t) for t in after.values())
            assert len(after) > 0.9 * len(before)
    assert kept == sorted(kept, reverse=True) and kept[-1] > 100
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    test_packing.check(P.run(spark, sf).collect(), rows, 2048)


def test_empty_table_passes_through(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
        docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert shared_folder(spark)


def test_stages_begin_with_memory_given_back(spark):
    """A full collection in the executors (here the driver's JVM) before each stage."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        before = full()
        stage(spark, docs, "/root/testdata/sf0.001")
        assert full() > before
