"""What the findings of round 3 were about: titles, bounded search, cells."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import catalogue
from corpusloom.operators import lexical, vectors
from corpusloom.operators.best import Best

PAGES = ["<h1>A&amp;&amp</h1>", "<h2>B</h2><p>x</p>", "<p>no heading", "<h1 class='x'> C <b>d</b>\n\t e </h1><h1>F</h1>", "<h1></h1><h1>G</h1>", "<h1>&amp;lt; &lt; &#39;&#x27;&quot;</h1>", "<h1>open", None]


def test_titles_are_those_of_the_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["html_titles"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        assert got == set(c.execute(catalogue.ORACLE["html_titles"]).fetchall()) and (0, "A&&amp") in got and (1, "") in got


@pytest.mark.parametrize("mode", ["and", "or", "fallback", "plain"])
@pytest.mark.parametrize("cells", [1, 1 << 18])
def test_search_in_place_gives_what_postings_give(spark, monkeypatch, mode, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["red", "fox", "the", "semi", "dry", "wine", "a", "a"], n)) for n in rng.integers(0, 12, 60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, None), (61, "red fox"), (62, "red fox")], "doc_id int, text string").repartition(3)
    q = spark.createDataFrame([("q1", "red fox"), ("q2", "the semi-dry wine"), ("q3", "a-a red red"), ("q4", "nothing fox"), ("q5", "?"), ("q6", "the a")], "query_id string, query string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "rank", "score", "norm_score").collect()))
    assert rows(lexical.search(docs, q, 4, mode)) == rows(lexical.search(docs, q, 4, mode, index=lexical.postings(docs)))
    u = lexical.units(q, {"or": F.split("query", " ")})
    every = sorted(map(tuple, lexical._searched(docs.select("doc_id", F.split("text", " ").alias("words")), u, 4).collect()))
    assert every == sorted(map(tuple, lexical._searched(docs.select("doc_id", F.split("text", " ").alias("words")), u, 4, block=1).collect()))


def test_a_task_passes_on_no_more_than_its_best(spark):
    """Hits were shuffled as query by document before."""
    docs = spark.createDataFrame([(i, "red") for i in range(500)], "doc_id long, text string").coalesce(1)
    u = lexical.units(spark.createDataFrame([(1, "red"), (2, "red red")], "query_id long, query string"), {"or": F.split("query", " ")})
    got = lexical._searched(docs.select("doc_id", F.split("text", " ").alias("words")), u, 5)
    assert sorted((r["query_id"], r["doc_id"]) for r in got.collect()) == [(q, d) for q in (1, 2) for d in range(5)]
    v = docs.select("doc_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    hits = vectors._scan(type("S", (), {"value": (np.array([7]), np.array([[1.0, 2.0]]))}), 3, True, True, __import__("pyarrow").int64())
    assert [b.num_rows for b in hits(iter([x for x in v.toArrow().to_batches(50)]))] == [3]


def test_best_is_brute_force():
    rng = np.random.default_rng(5)
    s, ids = rng.integers(0, 6, (7, 400)) / 2.0, rng.permutation(400)
    s[rng.random(s.shape) < 0.3] = -np.inf
    s[6] = -np.inf
    best = Best(7, 5)
    for lo in range(0, 400, 90):
        of = np.array([0, 2, 4, 6])
        best.add(s[of, lo : lo + 90], ids[lo : lo + 90], of)
        best.add(s[[1, 3, 5], lo : lo + 90], ids[lo : lo + 90], np.array([1, 3, 5]))
    want = [(i, -x, d) for i in range(7) for x, d in sorted((-v, d) for v, d in zip(s[i], ids) if v > -np.inf)[:5]]
    assert list(zip(best.query, best.score, best.ids)) == want


def test_probing_all_cells_is_exact_and_cells_grow(spark):
    rng = np.random.default_rng(9)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 4)))]
    v = spark.createDataFrame([*rows, (600, rows[0][1]), (601, [0.0] * 4)], "doc_id long, embedding array<float>").repartition(3)
    q = v.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    centres = vectors.fit_cells(v, 9)
    found = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "rank", "score").collect()))
    for own in (True, False):
        got = vectors.approximate_topk(vectors.index(v, centres), q, centres, 5, probes=9, own=own, block=10)
        assert found(got) == found(vectors.topk(v, q, 5, own=own))
    assert len(vectors.fit_cells(v)) == 12 < len(vectors.fit_cells(v.unionByName(v.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(v.withColumn("doc_id", F.col("doc_id") + 2000))))
