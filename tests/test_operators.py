"""Operators on hand-made inputs."""

import io
import re
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import checks, chunking, descriptors, evaluation, graph, incremental, lexical, sections
from corpusloom.plans import export, pack
from corpusloom.sources import blocks as B
from corpusloom.sources import markup, scan
from corpusloom.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_slugs(spark):
    for given, want in {"Fiscal  Year!": "fiscal_year", "__a--b__": "a_b", "Élan vital": "élan_vital", "---": "", "A_ _B": "a_b"}.items():
        assert one(spark, given, T.slug) == want
    assert one(spark, "year_fiscal_year", T.dedup_key) == "fiscal_year"
    assert [one(spark, x, T.long_enough) for x in ("abc", "abcd", "20_24", "2024a")] == [False, True, False, True]


def test_own_name(spark):
    rows = [("Acme Corp", "Acme Holdings 2020", True), ("Acme Display", "Acme Inc", False), ("Inc", "Acme", False), ("Acme", "", False)]
    df = spark.createDataFrame(rows, "p string, t string, want boolean")
    assert df.filter(T.is_own_name(F.col("p"), F.col("t")) != F.col("want")).count() == 0


def test_sentences(spark):
    text = "First one. Second one! ok\nTable | 1 2 3 | cell text\nIntro ...... 12\n\n12345 67"
    assert one(spark, text, T.sentences) == descriptors.split_sentences(text) == ["First one.", "Second one!", "ok", "Table", "cell text"]


def test_links(spark):
    text = "[a](x/one.md#top 'title') and [[two|label]]\n[ref]: dir/three.md?q=1\n[m](mailto:x@y.z)"
    assert one(spark, text, T.links) == ["x/one.md", "mailto:x@y.z", "dir/three.md?q=1", "two"]
    assert one(spark, "dir/three.md?q=1", T.base_name) == "three.md"
    assert [one(spark, x, T.is_external) for x in ("http://a", "mailto:a", "a/b.md", "b.md")] == [True, True, False, False]


def test_query_terms(spark):
    assert one(spark, "what is the fiscal-year (2020)?", T.query_terms) == ["fiscal-year", "2020"]
    assert one(spark, "the of", T.query_terms) == ["the", "of"]


def fts(docs, match):
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    c.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", docs)
    return [(r[0], round(-r[1], 6)) for r in c.execute("SELECT rowid, rank FROM f WHERE f MATCH ? ORDER BY rank, rowid LIMIT 5", (match,))]


def test_bm25_is_that_of_fts5(spark):
    import random

    rng = random.Random(4)
    vocabulary = ["élan", "vital", "fiscal", "year", "revenue", "net", "income", "the"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 40)))) for i in range(1, 60)] + [(60, "rare-word stands here"), (61, "rare other word")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = {1: ("fiscal year", '"fiscal" "year"'), 2: ("rare-word", '"rare-word"'), 3: ("net net income", '"net" "net" "income"'), 4: ("elan", '"elan"'), 5: ("rare fiscal nothing", '"rare" OR "fiscal" OR "nothing"')}
    q = spark.createDataFrame([(k, v[0]) for k, v in asked.items()], "query_id long, query string")
    for index in (None, lexical.postings(df)):
        got = {}
        for r in lexical.search(df, q, 5, index=index).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
        for k, (_, match) in asked.items():
            want = fts(docs, match)
            assert [s for _, s in got[k]] == pytest.approx([s for _, s in want], abs=2e-6), k
            if want[-1][1] > 1e-3:  # else scores are equal up to rounding
                assert {d for d, _ in got[k]} == {d for d, _ in want}
    with pytest.raises(ValueError, match="mode"):
        lexical.search(df, q, mode="fuzzy")


def test_fusion_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    assert [r.doc_id for r in lexical.fuse(a, b, 3).orderBy("rank").collect()] == [11, 10, 12]


def test_markdown(spark):
    text = "intro line\n\n# One\npara a\nstill a\n\npara b\n### Deep\nx\n### Again\n## Two\n```\n# code\n"
    rows = B.markdown(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("block_ord").collect()
    assert [(r.type, r.text) for r in rows][:5] == [("paragraph", "intro line"), ("heading", "One"), ("paragraph", "para a still a"), ("paragraph", "para b"), ("heading", "Deep")]
    paths = {r.text: r.section_path for r in rows}
    assert paths["intro line"] == [] and paths["Deep"] == ["One", "Deep"] and paths["Again"] == ["One", "Deep", "Again"] and paths["Two"] == ["One", "Two"] and paths["code"] == ["code"]


def test_packing_of_blocks_holds_its_bounds():
    import random

    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.choice([1, 5, 20, 100, 130, 300]) for _ in range(rng.randrange(1, 25))]
        blocks = [{"text": " ".join(f"b{i}w{j}" for j in range(n)), "type": rng.choice(["paragraph", "table"]), "page": i + 1} for i, n in enumerate(sizes)]
        out = chunking.pack_blocks(blocks, 100, 0.15)
        assert all(0 < c["token_count"] == chunking.count_tokens(c["content"]) <= 100 for c in out)
        tokens = lambda rows, k: set(re.findall(r"[a-z]+|\d+", " ".join(r[k] for r in rows)))
        assert tokens(out, "content") == tokens(blocks, "text")
    a, b = {"text": " ".join("a" * 90), "page": 1}, {"text": " ".join("b" * 30), "page": 2}
    assert [c["page"] for c in chunking.pack_blocks([a, b], 100)] == [1, 2]
    assert chunking.pack_blocks([], 10) == [] == chunking.pack_blocks([{"text": ""}, {"text": None}], 10)


def test_recursive_pieces():
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(200)) for i in range(4))
    out = chunking.split_recursive(text, 300, 50)
    assert all(len(x) <= 351 for x in out) and out[1].startswith(out[0][-50:])
    assert chunking.split_recursive("", 10) == [] and chunking.split_recursive("short") == ["short"]


def test_tree_and_spans(spark):
    rows = [("s", 0, ["B"], 3), ("s", 1, ["A"], 5), ("s", 2, ["B", "x"], 9), ("s", 3, ["B", "x", "y"], None), ("s", 4, [], 1)]
    items = spark.createDataFrame(rows, "source_id string, ord int, section_path array<string>, page int")
    t = sections.tree(items)
    assert {r.node_id: r.title for r in t.collect()} == {"s_s00": "B", "s_s01": "A", "s_s00-00": "x", "s_s00-00-00": "y"}
    assert {r.node_id: (r.first_page, r.last_page) for r in sections.page_spans(t, items).collect()}["s_s00"] == (3, 9)
    assert {r.ord: r.node_id for r in sections.attach(items, t).collect()}[4] == "s_root"
    assert [n["node_id"] for n in sections.nested([r.asDict() for r in t.collect()])] == ["s_s00", "s_s01"]
    assert sections.tree(items.limit(0)).count() == 0


def test_gist_and_keyphrases():
    text = "Solar power plants convert light. Solar power plants need light and space. Cats sleep. Solar light feeds solar power plants every day."
    assert "Solar" in descriptors.gist(text) and descriptors.gist("") == "" and descriptors.gist(None) == ""
    found = descriptors.keyphrases(text)
    assert found == descriptors.keyphrases(text) and any("solar" in p.lower() for p in found[:3]) and len(found) <= 6
    assert descriptors.keyphrases("too short") == []
    star = np.zeros((4, 4))
    star[0, 1:] = star[1:, 0] = 1
    assert descriptors.pagerank(star).argmax() == 0


def test_promotion(spark):
    rows = [("d1", "s1", 0, "Fiscal Year"), ("d1", "s1", 1, "Year Fiscal"), ("d2", "s2", 0, "fiscal year"), ("d2", "s3", 0, "Fiscal Year"), ("d1", "s4", 0, "abc"), ("d2", "s2", 1, "abc"), ("d1", "s1", 2, "lonely words")]
    con = graph.contributions(spark.createDataFrame(rows, "source_id string, node_id string, ord int, phrase string"))
    got = graph.promote(con, 6, 2, 0.6).collect()
    assert [(r.concept_id, r.label, r.n_docs, r.n_sections) for r in got] == [("c_fiscal_year", "Fiscal Year", 2, 3)]
    assert graph.mentions(con, graph.promote(con, 6, 2, 0.6)).count() == 3
    assert graph.promote(con, 6, 2, 0.4).count() == 0


def test_louvain():
    two = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0")]
    got = graph.louvain([f"{g}{i}" for g in "ab" for i in range(4)] + ["alone"], two)
    assert {got[f"a{i}"] for i in range(4)} == {0} and {got[f"b{i}"] for i in range(4)} == {1} and got["alone"] == 2
    assert graph.louvain([], []) == {} and graph.louvain(["x"], [("x", "x")]) == {"x": 0}


def test_components(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("x", "y")], "source string, target string")
    assert {r.root for r in graph.components(e).collect()} == {"n00", "x"}


def test_references(spark):
    chunks = spark.createDataFrame([("s1", "[a](b.md) [a](dir/b.md) [self](a.md) [no](zzz.md) [u](http://x/b.md)")], "source_id string, content string")
    sources = spark.createDataFrame([("s1", 0, "a.md"), ("s2", 1, "b.md"), ("s3", 2, "other/b.md")], "source_id string, ord int, path string")
    assert [(r.source, r.target) for r in graph.references(chunks, sources).collect()] == [("s1", "s3")]


def test_metrics(spark):
    res = spark.createDataFrame([("m", 1, 1, "a", None, 10), ("m", 1, 2, "b", "Intro", 20), ("m", 1, 3, "b", None, 30), ("m", 2, 1, "z", None, 5)], "mode string, query_id int, rank int, file string, section string, token_count int")
    gold = spark.createDataFrame([(1, "b", "intro"), (3, None, None)], "query_id int, file string, section string")
    asked = spark.createDataFrame([("m", 1), ("m", 2), ("m", 3)], "mode string, query_id int")
    got = {r.query_id: r for r in evaluation.per_query(evaluation.relevant(res, gold), asked).collect()}
    assert (got[1].hit, got[1].reciprocal_rank, round(got[1].citation_precision, 3), got[1].tokens) == (1, 0.5, 0.667, 60)
    assert (got[2].hit, got[3].hit, got[3].tokens) == (0, 0, 0)


def test_zip_guard_and_office():
    def zipped(**files):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in files.items():
                z.writestr(name.replace("__", "/"), data)
        return b.getvalue()

    assert "expands" in markup.bomb(zipped(a="0" * 10_000_000)) and markup.bomb(b"no archive") is None
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>secret</w:t></w:r><w:r><w:rPr><w:color w:val="FFFFFF"/></w:rPr><w:t>pale</w:t></w:r><w:r><w:rPr><w:color w:val="FFFFFF"/><w:highlight w:val="black"/></w:rPr><w:t>fine</w:t></w:r></w:p></w:body></w:document>'
    rows, warned = markup.read_file("docx", zipped(**{"word__document.xml": body}))
    assert rows[0] == ("heading", "Title", None, ["Title"]) and rows[1][3] == ["Title"]
    assert warned == [("hidden_text", "1 vanish run(s)"), ("hidden_text", "1 white run(s)")]
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    slide = lambda t: f'<x {a}><a:p><a:r><a:rPr sz="100"/><a:t>{t}</a:t></a:r></a:p></x>'
    rows, warned = markup.read_file("pptx", zipped(**{"ppt__slides__slide10.xml": slide("tenth"), "ppt__slides__slide2.xml": slide("abc")}))
    assert [(r[1], r[2]) for r in rows] == [("abc", 1), ("tenth", 2)] and warned == [("hidden_text", "1 tiny run(s)")]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows, warned = markup.read_file("xlsx", zipped(**{"xl__sharedStrings.xml": f'<sst {s}><si><r><rPr><color rgb="FFFFFFFF"/></rPr><t>hid</t></r></si></sst>', "xl__worksheets__sheet1.xml": f'<worksheet {s}><row><c t="s"><v>0</v></c><c><v>7</v></c></row></worksheet>'}))
    assert rows == [("table", "| hid | 7 |", 1, [])] and warned == [("hidden_text", "1 white run(s)")]
    assert markup.read_file("docx", b"junk")[1][0][0] == "parse_error" and markup.read_file("pdf", b"%PDF")[1][0][0] == "import_error"


def test_html():
    rows = markup.html_blocks("<head><title>t</title></head><h1>A &amp; B</h1><p>one <b>two</b></p><script>x</script><h2>C</h2><p>three")
    assert [(r[0], r[1], r[3]) for r in rows] == [("heading", "A & B", ["A & B"]), ("paragraph", "one two", ["A & B"]), ("heading", "C", ["A & B", "C"]), ("paragraph", "three", ["A & B", "C"])]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "sub").mkdir()
    (root / "node_modules").mkdir()
    files = {"b.md": "# Solar power\nSolar power plants convert sunlight. Solar power plants are large. See [a](a.txt).\n## Costs\nSolar power plants cost money every year.", "a.txt": "Solar power plants feed the grid.\n\nWind farms too, and solar power plants.​", "sub/t.csv": "name,age\n" + "\n".join(f"n{i},{i}" for i in range(60)), "sub/z.html": "<h1>Solar</h1><p>Solar power plants again</p>", "node_modules/x.md": "# no", ".hidden.md": "# no", "skip.txt": "no", "bad.docx": "junk", "e.txt": ""}
    for name, text in files.items():
        (root / name).write_text(text)
    (root / ".gitignore").write_text("skip.txt\n")
    return root


def test_listing_order_and_rules(spark, corpus):
    names = [r.path for r in scan.listing(spark, str(corpus)).orderBy("ord").collect()]
    assert names == ["a.txt", "b.md", "bad.docx", "e.txt", "sub/t.csv", "sub/z.html"]
    assert "skip.txt" in [r.path for r in scan.listing(spark, str(corpus), gitignore=False).collect()]
    assert [r.path for r in scan.listing(spark, str(corpus), include=["*.md", "*.csv"], exclude=["sub/*"]).collect()] == ["b.md"]


def test_pack_end_to_end(spark, corpus, tmp_path):
    out = str(tmp_path / "pack")
    p = pack.build(spark, str(corpus), out, scan.Config(min_docs=2, df_cap=1.0))
    state = {r.path: (r.status, r.reason) for r in p["sources"].collect()}
    assert state["b.md"] == ("success", None) and state["bad.docx"][0] == "failed" and state["e.txt"] == ("failed", "produced 0 chunks")
    assert {r.type for r in p["warnings"].collect()} == {"parse_error", "empty_file", "unicode_smuggling"}
    tables = p["tables"].orderBy("block_id").collect()
    assert [(t.row_range.start, t.row_range.end) for t in tables] == [(1, 50), (51, 60)]
    assert checks.validate(pack.read(spark, out)).count() == 0
    assert p["edges"].filter("relation = 'references'").count() == 1 and p["edges"].filter("relation = 'mentions'").count() > 1
    q = spark.createDataFrame([(1, "solar sunlight"), (2, "wind farms")], "query_id long, query string")
    for mode in ("lexical", "vector", "hybrid"):
        hits = pack.search(spark, out, q, mode, 3).collect()
        assert {h.path for h in hits if h.query_id == 2 and h["rank"] == 1} == {"a.txt"}
    assert {h.path for h in pack.search(spark, out, q, "lexical", 3, source="B.M").collect()} <= {"b.md"}
    with pytest.raises(ValueError, match="mode"):
        pack.search(spark, out, q, "other")
    assert "longest chunk" in export.audit_report(p, "x") and "Communities" in export.graph_report(p) and '"nodes"' in export.map_json(p)
    export.files(p["chunks"].select("chunk_id", "content"), "chunk_id", "content", str(tmp_path / "chunks"))
    assert len(list((tmp_path / "chunks").glob("*.md"))) == p["chunks"].count()


def test_validation_reports(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    p = {"sources": t([("s1", "a")], "source_id string, path string"), "chunks": t([("c1", "s1", 5000), ("c2", "zz", 1)], "chunk_id string, source_id string, token_count int"), "tables": t([("yy",)], "source_id string"), "nodes": t([("s1", "document", "s1")], "id string, kind string, doc string"), "edges": t([("s1", "gone")], "source string, target string")}
    assert sorted((r.check, r.key) for r in checks.validate(p).collect()) == [("chunk_source", "zz"), ("edge_target", "gone"), ("table_source", "yy"), ("tokens", "c1")]
    with pytest.raises(ValueError, match="chunks"):
        checks.validate({"sources": p["sources"], "tables": p["tables"]})


def test_config(tmp_path):
    (tmp_path / "corpusloom.toml").write_text('[pack]\nname = "n"\nchunk_max_tokens = 0\nfast_pdf = 1\n[graph]\ndf_cap = 0.3\nmin_docs = true\n')
    with pytest.warns(UserWarning):
        c = scan.load_config(tmp_path)
    assert (c.name, c.chunk_max_tokens, c.fast_pdf, c.df_cap, c.min_docs) == ("n", 800, False, 0.3, 2)
    assert scan.load_config(tmp_path / "none") == scan.Config()


def test_cache_and_feedback(spark, tmp_path):
    assert incremental.read_cache(spark, str(tmp_path / "no"), "key string").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("junk")
    assert incremental.read_cache(spark, str(tmp_path / "bad"), "key string").count() == 0
    for rows in ([("c1", "q", 1, 0.0)], [("c1", "q", -1, 1.0), ("c2", "q", 2, 2.0)]):
        incremental.append_feedback(spark, str(tmp_path / "f"), rows)
    got = {r.chunk_id: (r.n_up, r.n_down, r.n_saved) for r in incremental.feedback_summary(spark.read.parquet(str(tmp_path / "f"))).collect()}
    assert got == {"c1": (1, 1, 0), "c2": (0, 0, 1)}
    with pytest.raises(ValueError, match="rating"):
        incremental.append_feedback(spark, str(tmp_path / "f"), [("c", "q", 5, 0.0)])


def test_streams_equal_batches(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    batch.repartition(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in" / "*"))
    got = ingest.run_now(ingest.windowed(stream), "windows", "complete")
    assert sorted(map(str, got.select("start", "event_type", "n").collect())) == sorted(map(str, ingest.windowed(batch).select("start", "event_type", "n").collect()))


def test_ingest_takes_each_content_once(spark, tmp_path):
    folder, table, state = tmp_path / "docs", str(tmp_path / "table"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "1.txt").write_text("same"), (folder / "2.txt").write_text("same"), (folder / "3.txt").write_text("other")
    ingest.ingest(spark, str(folder), table, state)
    assert spark.read.parquet(table).count() == 2
    (folder / "4.txt").write_text("new"), (folder / "5.txt").write_text("other")
    ingest.ingest(spark, str(folder), table, state)
    assert sorted(r.text for r in spark.read.parquet(table).collect()) == ["new", "other", "same"]


def test_communities_of_large_graphs_are_components(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("alone",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    for most in (10, 1):
        got = {r.id: r.community for r in graph.communities(nodes, edges, most).collect()}
        assert got["a"] == got["b"] == got["c"] != got["alone"]


def test_projection(spark):
    from corpusloom.operators import vectors

    v = spark.createDataFrame([(i, [float(i), 1.0, float(i % 3)]) for i in range(1, 20)], "doc_id long, embedding array<double>")
    got = vectors.project(v).collect()
    assert len(got) == 19 and all(10 <= r.x <= 90 and 10 <= r.y <= 90 for r in got)
