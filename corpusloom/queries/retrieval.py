"""Lexical, vector and hybrid search, baselines and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import chunking, evaluation, lexical, vectors
from .common import TOKENS, WORDS, query, table

#: The queries: the first words of every benchmark item.
_Q = "SELECT item_id AS query_id, array_to_string(regexp_extract_all(text, '[^ \\n]+')[1:{n}], ' ') AS query FROM benchmark"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def asked(spark, sf, n: int = 6):
    words = F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 1, n), " ").alias("query"))


def _bm25(docs: str, units: str, grams: str = "t AS (SELECT doc_id, unnest(w) AS unit FROM d)") -> str:
    """hits: query_id, kind, doc_id, score, n_matched, n_units.  ``docs`` has doc_id, text; ``units`` has query_id, kind, unit."""
    return rf"""d AS (SELECT doc_id, {WORDS('text')} AS w FROM ({docs})), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), dl AS (SELECT doc_id, len(w) AS dl FROM d), {grams},
un AS (SELECT query_id, kind, unit, count(*) AS copies FROM ({units}) GROUP BY ALL), nu AS (SELECT query_id, kind, sum(copies) AS n_units FROM un GROUP BY ALL),
tf AS (SELECT unit, doc_id, count(*) AS tf FROM t WHERE unit IN (SELECT unit FROM un) GROUP BY ALL), df AS (SELECT unit, count(*) AS df FROM tf GROUP BY unit),
s AS (SELECT unit, doc_id, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM tf JOIN df USING (unit) JOIN dl USING (doc_id), st),
hits AS (SELECT query_id, kind, doc_id, sum(s * copies) AS score, sum(copies) AS n_matched, any_value(n_units) AS n_units FROM un JOIN s USING (unit) JOIN nu USING (query_id, kind) GROUP BY query_id, kind, doc_id)"""


def _ranked(hits: str, k: int = 5) -> str:
    return f"""r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ({hits})),
b AS (SELECT * FROM r WHERE rank <= {k}), out AS (SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END, 6) AS norm_score FROM b WINDOW w AS (PARTITION BY query_id))"""


_CLEAN = rf"SELECT query_id, list_filter(regexp_split_to_array(regexp_replace(query, '[^a-zA-Z0-9\-\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM ({_Q.format(n=6)})"
_AND = f"SELECT query_id, 'and' AS kind, unnest(CASE WHEN len(list_filter(w, lambda x: NOT list_contains({_STOP}, lower(x)))) > 0 THEN list_filter(w, lambda x: NOT list_contains({_STOP}, lower(x))) ELSE w END) AS word FROM ({_CLEAN})"
_OR = f"SELECT query_id, 'or' AS kind, unnest(w) AS word FROM ({_CLEAN})"
_UNIT = lambda q: f"SELECT query_id, kind, array_to_string({WORDS('word')}, ' ') AS unit FROM ({q}) WHERE len({WORDS('word')}) > 0"
_DOCS = "SELECT doc_id, text FROM documents"


@query(f"WITH {_bm25(_DOCS, _UNIT(_AND))}, {_ranked('SELECT * FROM hits WHERE n_matched = n_units')} SELECT * FROM out")
def bm25_and(spark, sf):
    return lexical.search(table(spark, sf, "documents"), asked(spark, sf), 5, "and")


@query(f"WITH {_bm25(_DOCS, _UNIT(_OR))}, {_ranked('SELECT * FROM hits')} SELECT * FROM out")
def bm25_or(spark, sf):
    return lexical.search(table(spark, sf, "documents"), asked(spark, sf), 5, "or")


_FALL = "SELECT * FROM (SELECT *, min(kind) OVER (PARTITION BY query_id) AS best FROM hits WHERE kind = 'or' OR n_matched = n_units) WHERE kind = best"
_FALLBACK = f"{_bm25(_DOCS, _UNIT(_AND + ' UNION ALL ' + _OR))}, {_ranked(_FALL)}"


@query(f"WITH {_FALLBACK} SELECT * FROM out")
def bm25_fallback(spark, sf):
    return lexical.search(table(spark, sf, "documents"), asked(spark, sf), 5)


_PAIR = "t AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS unit FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT))) AS i FROM d))"


@query(rf"WITH {_bm25(_DOCS, '''SELECT item_id AS query_id, 'or' AS kind, w[1] || ' ' || w[2] AS unit FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark) WHERE len(w) > 1''', _PAIR)}, {_ranked('SELECT * FROM hits')} SELECT * FROM out")
def bm25_phrase(spark, sf):
    """A hyphenated word of a query is a phrase: its parts must stand next to each other."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    q = table(spark, sf, "benchmark").filter(F.size(w) > 1).select(F.col("item_id").alias("query_id"), F.concat_ws("-", F.element_at(w, 1), F.element_at(w, 2)).alias("query"))
    return lexical.search(table(spark, sf, "documents"), q, 5, "or")


@query(f"SELECT unit AS term, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, unit, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS('text')}) AS unit FROM documents) GROUP BY ALL) GROUP BY unit")
def postings_index(spark, sf):
    p = lexical.postings(table(spark, sf, "documents"))
    return p.groupBy("term").agg(F.count("*").alias("n_postings"), F.sum(F.size("positions")).alias("tf"))


@query(f"SELECT count(*) AS n_docs, round(avg(len({WORDS('text')})), 6) AS avgdl FROM documents")
def bm25_statistics(spark, sf):
    return lexical.statistics(table(spark, sf, "documents")).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) AS sq, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings")
def normalize_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 5).alias("sq"), F.round(F.element_at(V.normalize(F.col("embedding")), 1), 6).alias("first"))


def _knn(k: int, own: bool) -> str:
    cut = "" if own else "WHERE q.vec_id <> v.vec_id"
    return f"""SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
(SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_inner_product(q.e, v.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e)), 6) AS score FROM x q JOIN x v ON q.vec_id % 20 = 0 {cut})) WHERE rank <= {k}"""


_X = "WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _asked_vectors(spark, sf):
    return _vectors(spark, sf).filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


@query(f"{_X} {_knn(10, True)}")
def vector_topk(spark, sf):
    return vectors.topk(_vectors(spark, sf), _asked_vectors(spark, sf), 10)


@query(f"{_X} {_knn(5, False)}")
def neighbors(spark, sf):
    return vectors.topk(_vectors(spark, sf), _asked_vectors(spark, sf), 5, own=False)


@query()
def ann_topk(spark, sf):
    """An inverted-file index of all rows; the queries are the rows whose id is divisible by 20."""
    v = _vectors(spark, sf)
    centres = vectors.fit_cells(v)
    return vectors.approximate_topk(vectors.index(v, centres), _asked_vectors(spark, sf), centres, 10, probes=vectors.probes_for(v, centres))


@query("WITH x AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) / sqrt(list_inner_product(e, e)) AS v FROM x), c AS (SELECT label, i, sum(v) AS v FROM u GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM c GROUP BY label), k AS (SELECT label, count(*) AS n_rows FROM x GROUP BY label) SELECT label, n_rows, i AS position, round(v / n, 6) AS value FROM c JOIN n USING (label) JOIN k USING (label)")
def label_centroids(spark, sf):
    c = vectors.centroids(_vectors(spark, sf), "label", 64)
    return c.select("label", F.col("n").alias("n_rows"), F.posexplode("embedding").alias("p", "v")).select("label", "n_rows", (F.col("p") + 1).alias("position"), F.round("v", 6).alias("value"))


_CENT = "WITH x AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) / sqrt(list_inner_product(e, e)) AS v FROM x), c AS (SELECT label, i, sum(v) AS v FROM u GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM c GROUP BY label), d AS (SELECT label, i, v / n AS v FROM c JOIN n USING (label))"


@query(f"{_CENT} SELECT 'label_' || a.label AS a, 'label_' || b.label AS b, round(sum(a.v * b.v), 6) AS score FROM d a JOIN d b ON a.i = b.i AND 'label_' || a.label < 'label_' || b.label GROUP BY a.label, b.label HAVING round(sum(a.v * b.v), 6) >= 0")
def similar_to_edges(spark, sf):
    c = vectors.centroids(_vectors(spark, sf), "label", 64).withColumn("node_id", F.concat(F.lit("label_"), F.col("label").cast("string"))).withColumn("doc", F.col("node_id"))
    return vectors.similar_pairs(c, 0.0)


_EMB = lambda src, key: f"SELECT {key} AS id, CAST('0x' || substr(md5(word), 1, 6) AS BIGINT) % 64 AS slot, count(*) AS n FROM (SELECT {key}, unnest({WORDS('text')}) AS word FROM ({src})) GROUP BY ALL"
def _hybrid_sql(pool: int) -> str:
    """fr: the fused ranks of the best ``pool`` hits of each arm."""
    return f"""{_bm25(_DOCS, _UNIT(_AND + ' UNION ALL ' + _OR))}, {_ranked(_FALL, pool)},
de AS ({_EMB(_DOCS, 'doc_id')}), qe AS ({_EMB('SELECT query_id, query AS text FROM (' + _Q.format(n=6) + ')', 'query_id')}),
dn AS (SELECT id, sqrt(sum(n * n)) AS l FROM de GROUP BY id), qn AS (SELECT id, sqrt(sum(n * n)) AS l FROM qe GROUP BY id),
co AS (SELECT q.query_id, x.doc_id, round(coalesce(any_value(y.s), 0.0), 6) AS score FROM ({_Q.format(n=6)}) q CROSS JOIN documents x LEFT JOIN (SELECT qe.id AS query_id, de.id AS doc_id, sum(qe.n * de.n) / (any_value(qn.l) * any_value(dn.l)) AS s FROM qe JOIN de USING (slot) JOIN qn ON qn.id = qe.id JOIN dn ON dn.id = de.id GROUP BY ALL) y ON y.query_id = q.query_id AND y.doc_id = x.doc_id GROUP BY ALL),
ve AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM co QUALIFY rank <= {pool}),
fu AS (SELECT coalesce(o.query_id, v.query_id) AS query_id, coalesce(o.doc_id, v.doc_id) AS doc_id, o.rank AS lex_rank, v.rank AS vec_rank, round(coalesce(1 / (60 + o.rank), 0.0) + coalesce(1 / (60 + v.rank), 0.0), 9) AS score FROM out o FULL JOIN ve v ON o.query_id = v.query_id AND o.doc_id = v.doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lex_rank NULLS LAST, vec_rank NULLS LAST) AS rank FROM fu)"""


_HYBRID = _hybrid_sql(10)


def _hybrid(spark, sf, k: int = 5):
    docs, q = table(spark, sf, "documents"), asked(spark, sf)
    lex = lexical.search(docs, q, 2 * k)
    vec = vectors.topk(vectors.embed(docs), vectors.embed(q, "query_id", "query").withColumnRenamed("doc_id", "query_id"), 2 * k)
    return lexical.fuse(lex, vec, k)


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, CAST(lex_rank AS INTEGER) AS lex_rank, CAST(vec_rank AS INTEGER) AS vec_rank, score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 5")
def hybrid_rrf(spark, sf):
    return _hybrid(spark, sf)


def _filtered(spark, sf, wide: int, pool: int):
    docs, q = table(spark, sf, "documents"), asked(spark, sf)
    lex = lexical.search(docs, q, pool)
    vec = vectors.topk(vectors.embed(docs), vectors.embed(q, "query_id", "query").withColumnRenamed("doc_id", "query_id"), pool)
    hits = lexical.fuse(lex, vec, wide).join(docs.select("doc_id", "source", F.col("lang").alias("section")), "doc_id")
    return lexical.filtered(hits, 5, "RC1", "E", None, ("source",)).select("query_id", "doc_id", "score", "place")


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS place FROM fr JOIN documents USING (doc_id) WHERE rank <= 10 AND contains(lower(source), 'rc1') AND contains(lower(lang), 'e') QUALIFY place <= 5")
def filtered_search(spark, sf):
    """Filters by substring come after the top k are fetched: ten hits, as the SQL of this query says; ``filtered_search_wide`` fetches as many as a search with filters should."""
    return _filtered(spark, sf, 10, 10)


@query(f"WITH {_hybrid_sql(40)} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS place FROM fr JOIN documents USING (doc_id) WHERE rank <= 20 AND contains(lower(source), 'rc1') AND contains(lower(lang), 'e') QUALIFY place <= 5")
def filtered_search_wide(spark, sf):
    """As ``pack.search`` with a filter: 4 * k = 20 fused hits for k = 5, of twice as many in each arm."""
    return _filtered(spark, sf, 20, 40)


@query(f"WITH {_FALLBACK} SELECT query_id, doc_id, lag(doc_id) OVER (PARTITION BY query_id ORDER BY rank) AS previous FROM out")
def hit_chain(spark, sf):
    return bm25_fallback(spark, sf).select("query_id", "doc_id", F.lag("doc_id").over(W.partitionBy("query_id").orderBy("rank")).alias("previous"))


_RAW = rf"SELECT query_id, 'or' AS kind, unnest(list_filter(regexp_split_to_array(replace(query, '\"', ' '), '\s+'), lambda x: x <> '')) AS word FROM ({_Q.format(n=6)})".replace('\\"', '"')


@query(f"WITH {_bm25(_DOCS, _UNIT(_RAW))}, {_ranked('SELECT * FROM hits', 3)} SELECT * FROM out")
def raw_file_search(spark, sf):
    """The baseline over whole documents: any word, nothing dropped."""
    return lexical.search(table(spark, sf, "documents"), asked(spark, sf), 3, "plain")


#: Ids of chunks: the document's id and the chunk's number as text, so that a text of any length has its own.
_NAIVE = "SELECT doc_id || '-' || (s // 4000) AS doc_id, substr(text, CAST(s AS BIGINT) + 1, 4000) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(length(text) AS BIGINT), 4000)) AS s FROM documents)"


def _part(*cols: str):
    return F.concat_ws("-", *[F.col(c).cast("string") for c in cols])


def _naive(spark, sf):
    c = chunking.fixed(table(spark, sf, "documents"))
    return c.select(_part("doc_id", "chunk_ord").alias("doc_id"), F.col("content").alias("text"))


@query(f"WITH {_bm25(_NAIVE, _UNIT(_RAW))}, {_ranked('SELECT * FROM hits', 3)} SELECT * FROM out")
def naive_chunk_search(spark, sf):
    return lexical.search(_naive(spark, sf), asked(spark, sf), 3, "plain")


def _dense_sql(docs: str, k: int) -> str:
    return f"""WITH q AS ({_Q.format(n=6)}), de AS ({_EMB(docs, 'doc_id')}), qe AS ({_EMB('SELECT query_id, query AS text FROM q', 'query_id')}),
dn AS (SELECT id, sqrt(sum(n * n)) AS l FROM de GROUP BY id), qn AS (SELECT id, sqrt(sum(n * n)) AS l FROM qe GROUP BY id),
y AS (SELECT qe.id AS query_id, de.id AS doc_id, round(sum(qe.n * de.n) / (any_value(qn.l) * any_value(dn.l)), 6) AS score FROM qe JOIN de USING (slot) JOIN qn ON qn.id = qe.id JOIN dn ON dn.id = de.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM y)"""


@query(f"{_dense_sql(_NAIVE, 3)} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def naive_vector_search(spark, sf):
    q = vectors.embed(asked(spark, sf), "query_id", "query").withColumnRenamed("doc_id", "query_id")
    return vectors.topk(vectors.embed(_naive(spark, sf)), q, 3)


_CHILD = """SELECT doc_id || '-' || p || '-' || (s // 400) AS doc_id, substr(parent, CAST(s AS BIGINT) + 1, 400) AS text FROM (SELECT doc_id, p, parent, unnest(range(0, CAST(length(parent) AS BIGINT), 400)) AS s FROM (SELECT doc_id, s // 2000 AS p, substr(text, CAST(s AS BIGINT) + 1, 2000) AS parent FROM (SELECT doc_id, text, unnest(range(0, CAST(length(text) AS BIGINT), 2000)) AS s FROM documents)))"""


@query(f"{_dense_sql(_CHILD, 3)}, b AS (SELECT query_id, regexp_replace(doc_id, '-[0-9]+$', '') AS parent_id, max(score) AS score FROM r GROUP BY ALL) SELECT query_id, parent_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS INTEGER) AS rank FROM b QUALIFY rank <= 3")
def parent_document_search(spark, sf):
    """Children are matched; each parent counts once, by its best child."""
    c = chunking.parent_child(table(spark, sf, "documents"))
    kids = c.select(_part("doc_id", "parent_ord", "child_ord").alias("doc_id"), F.col("content").alias("text"))
    q = vectors.embed(asked(spark, sf), "query_id", "query").withColumnRenamed("doc_id", "query_id")
    hits = vectors.topk(vectors.embed(kids), q, 3 * 5)  # a parent has five children at most, so its best are among these
    best = hits.groupBy("query_id", F.regexp_replace("doc_id", "-[0-9]+$", "").alias("parent_id")).agg(F.max("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "parent_id")
    return best.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")


@query()
def recursive_vector_search(spark, sf):
    c = chunking.recursive(table(spark, sf, "documents")).select(_part("doc_id", "chunk_ord").alias("doc_id"), F.col("content").alias("text"))
    return vectors.topk(vectors.embed(c), vectors.embed(asked(spark, sf), "query_id", "query").withColumnRenamed("doc_id", "query_id"), 3)


def _gold(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return evaluation.holders(d, b).select(F.col("item_id").alias("query_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file"), F.lit(None).cast("string").alias("section"))


_GOLD = "SELECT item_id AS query_id, 'doc_' || doc_id AS file, CAST(NULL AS VARCHAR) AS section FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


@query(
    f"""WITH {_FALLBACK}, gold AS ({_GOLD}), res AS (SELECT 'lexical' AS mode, query_id, rank, 'doc_' || o.doc_id AS file, {TOKENS('text')} AS token_count FROM out o JOIN documents USING (doc_id) WHERE rank <= 3),
j AS (SELECT res.*, EXISTS (SELECT 1 FROM gold g WHERE g.query_id = res.query_id AND g.file = res.file) AS rel FROM res),
m AS (SELECT b.item_id AS query_id, coalesce(max(CAST(rel AS INTEGER)), 0) AS hit, coalesce(1 / min(CASE WHEN rel THEN rank END), 0.0) AS rr, coalesce(avg(CAST(rel AS DOUBLE)), 0.0) AS cp, coalesce(sum(token_count), 0) AS tokens FROM benchmark b LEFT JOIN j ON j.query_id = b.item_id GROUP BY b.item_id)
SELECT 'lexical' AS mode, count(*) AS n_queries, round(avg(hit), 6) AS hit_at_k, round(avg(rr), 6) AS mrr, round(avg(cp), 6) AS citation_precision, round(avg(tokens), 6) AS avg_tokens, round(avg(tokens) / 1e6 * 0.25, 9) AS avg_cost FROM m"""
)
def eval_metrics(spark, sf):
    """Gold: the documents that hold the item's passage.  One mode, as the SQL says; ``eval_modes`` has all."""
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    file = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    gold = _gold(spark, sf)
    hits = lexical.search(d, asked(spark, sf), 3).join(d.select("doc_id", T.token_count(F.col("text")).alias("token_count")), "doc_id")
    res = hits.select(F.lit("lexical").alias("mode"), "query_id", "rank", file.alias("file"), F.lit(None).cast("string").alias("section"), "token_count")
    return evaluation.summary(evaluation.per_query(evaluation.relevant(res, gold), b.select(F.lit("lexical").alias("mode"), F.col("item_id").alias("query_id"))))



@query()
def projection_2d(spark, sf):
    return vectors.project(_vectors(spark, sf))


#: Search functions (spark, sf_dir) by the name of the mode that evaluation compares.
MODES = {"raw_file": raw_file_search, "naive_chunk": naive_chunk_search, "naive_vector": naive_vector_search, "recursive_vector": recursive_vector_search, "parent_document": parent_document_search, "lexical": bm25_fallback, "hybrid": hybrid_rrf}


def _vector(spark, sf):
    q = vectors.embed(asked(spark, sf), "query_id", "query").withColumnRenamed("doc_id", "query_id")
    return vectors.topk(vectors.embed(table(spark, sf, "documents")), q, 3)


def _found_texts(spark, sf, mode: str):
    """id (as the mode's hits have it), file, text."""
    d = table(spark, sf, "documents")
    file = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file")
    if mode in ("naive_chunk", "naive_vector"):
        return _naive(spark, sf).select(F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.regexp_replace("doc_id", "-[0-9]+$", "")).alias("file"), "text")
    if mode == "recursive_vector":
        return chunking.recursive(d).select(_part("doc_id", "chunk_ord").alias("id"), file, F.col("content").alias("text"))
    if mode == "parent_document":
        return chunking.fixed(d, 2000).select(_part("doc_id", "chunk_ord").alias("id"), file, F.col("content").alias("text"))
    return d.select(F.col("doc_id").alias("id"), file, "text")


@query()
def eval_modes(spark, sf):
    """The metrics of every mode: ``MODES``, the vector mode, and hybrid search for three hits; chunks and parents count for their documents."""
    ways = MODES | {"vector": _vector, "hybrid": lambda s, d: _hybrid(s, d, 3)}
    results = None
    for mode, search in ways.items():
        hits = search(spark, sf).withColumnRenamed("parent_id" if mode == "parent_document" else "doc_id", "id").filter("rank <= 3").select("query_id", "rank", "id")
        found = hits.join(_found_texts(spark, sf, mode), "id")
        found = found.select(F.lit(mode).alias("mode"), "query_id", "rank", "file", F.lit(None).cast("string").alias("section"), T.token_count(F.col("text")).alias("token_count"))
        results = found if results is None else results.unionByName(found)
    every = table(spark, sf, "benchmark").select(F.explode(F.array(*map(F.lit, ways))).alias("mode"), F.col("item_id").alias("query_id"))
    return evaluation.summary(evaluation.per_query(evaluation.relevant(results, _gold(spark, sf)), every))
