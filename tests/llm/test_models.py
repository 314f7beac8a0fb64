import math
import random
import shutil
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from corpusloom.llm import kneser_ney as K
from corpusloom.llm import langid as L
from corpusloom.llm import perplexity as X

from .conftest import words


def discounts(values):
    n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    if not n[0] or not n[1] or not n[2]:
        return [0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3)]


class Brute:
    def __init__(self, texts):
        self.pairs, self.uni = Counter(), Counter()
        for t in texts:
            w = words(t, lower=True) + ["</s>"]
            self.uni.update(w)
            self.pairs.update(zip(["<s>"] + w, w))
        self.cont, self.follow = Counter(w for _, w in self.pairs), defaultdict(list)
        for (h, _), c in self.pairs.items():
            self.follow[h].append(c)
        self.d2, self.d1 = discounts(self.pairs.values()), discounts(self.cont.values())

    def low(self, w):
        if not self.pairs:
            return 1.0
        c, off = self.cont[w], self.d1
        rest = sum(off[min(x, 3)] for x in self.cont.values())
        return (c - off[min(c, 3)] + rest / (len(self.cont) + 1)) / len(self.pairs)

    def p(self, h, w):
        if h not in self.follow:
            return self.low(w)
        total, c = sum(self.follow[h]), self.pairs[h, w]
        return (c - self.d2[min(c, 3)]) / total + sum(self.d2[min(x, 3)] for x in self.follow[h]) / total * self.low(w)

    def score(self, text):
        w = words(text, lower=True) + ["</s>"]
        n, v = sum(self.uni.values()), len(self.uni)
        base = sum(math.log10((self.uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        return len(w), sum(self.uni[x] > 0 for x in w), n, base, sum(math.log10(self.p(h, x)) for h, x in zip(["<s>"] + w, w))


def test_model_is_that_of_brute_force(docs, rows):
    train = [r[1] for r in rows if r[0] is not None and r[0] % 3]
    b = Brute(train)
    for shard_bytes in (24 << 20, 1 << 12):
        got = K.score(docs, K.train(docs.filter("doc_id % 3 <> 0"), shard_bytes=shard_bytes)).collect()
        want = sorted(((r[0], *b.score(r[1])) for r in rows), key=lambda r: str(r[:4]))
        got = sorted(map(tuple, got), key=lambda r: str(r[:4]))
        assert [g[:4] for g in got] == [w[:4] for w in want]
        for g, w in zip(got, want):
            assert g[4:] == pytest.approx(w[4:], rel=1e-6)


def test_probabilities_sum_to_one(rows):
    b = Brute([r[1] for r in rows[:40]])
    for h in ("<s>", "one", "never seen"):
        assert sum(b.p(h, w) for w in b.uni) + b.p(h, "unknown") == pytest.approx(1.0)


def test_model_of_nothing(docs, empty):
    got = K.score(docs, K.train(empty)).collect()
    assert all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert K.score(empty, K.train(docs)).count() == 0


def test_crowded_contexts_are_spread(spark):
    data = [(i, " ".join(f"the w{(i * 31 + j) % 500}" for j in range(80))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    m = K.train(df, shard_bytes=1 << 12)
    assert len(m.crowded) and m.crowded[:, 1].max() > 15  # a context of half the pairs has more parts than others
    b = Brute([t for _, t in data])
    for r in K.score(df, m).collect():
        assert r.score == pytest.approx(b.score(data[r.doc_id][1])[-1], rel=1e-6)


def test_a_lost_shard_is_an_error(spark, docs):
    m = K.train(docs, shard_bytes=1 << 12)
    shutil.rmtree(f"{m.path}/{min(x for x in m.saved if x.startswith('pairs'))}")
    with pytest.raises(Exception, match="FileNotFoundError"):
        K.score(docs, m).collect()


def test_perplexity_is_that_of_brute_force(spark, docs, rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    labels = spark.createDataFrame([(i, 1) for i in ids if i > 9] + [(ids[0], 0), (50, 1)], "doc_id long, quality int")
    got = X.classify(docs, labels, min_calibration=5).collect()
    ok = [i for i in ids if i > 9]
    total = sum(len((r[1] or "").encode()) for r in rows if r[0] in ok)
    rate = min(0.5, (8 << 20) / total)
    drawn = {r.doc_id for r in spark.createDataFrame([(i,) for i in ok], "doc_id long").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20))).collect()}
    b = Brute([r[1] for r in rows if r[0] in drawn])
    assert len(got) == len(rows)
    by = {(r[0], r[1]): b.score(r[1]) for r in rows}
    want = sorted([(r[0], by[r[0], r[1]][0], by[r[0], r[1]][-1]) for r in rows], key=lambda r: str(r[:2]))
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.log10_prob) for r in got), key=lambda r: str(r[:2])), want):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-5, abs=1e-5)
    for r in got:
        assert r.kept == (r.n_tokens > 1 and (r.threshold is None or r.perplexity <= r.threshold))
    assert any(r.threshold is not None for r in got)


def test_all_trusted_text_counts(spark):
    """36 MB of it: half trains, and every document of the other half sets the threshold."""
    rng = random.Random(7)
    vocabulary = [f"{i}-" + "x" * 2000 for i in range(50)]
    data = [(i, " ".join(rng.choices(vocabulary, range(1, 51), k=150)), "en") for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in X.classify(df, spark.range(120).selectExpr("id AS doc_id", "1 AS quality"), quantile=0.9, min_calibration=10).collect()}
    drawn = {r.id for r in spark.range(120).filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (1 << 19)).collect()}
    b = Brute([t for i, t, _ in data if i in drawn])
    assert all(got[i].log10_prob == pytest.approx(b.score(t)[-1], abs=1e-5) for i, t, _ in data)
    held = sorted(got[i].perplexity for i in set(got) - drawn)
    assert {r.threshold for r in got.values()} == {held[math.ceil(round(0.9 * len(held), 6)) - 1]}


def test_perplexity_edges(spark, docs, empty, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = X.classify(docs, none).collect()
    assert len(got) == len(rows) and all(r.threshold is None and r.kept == (r.n_tokens > 1) for r in got)
    assert X.classify(empty, none).count() == 0


def test_languages_on_held_out_documents(spark):
    from corpusloom.llm.queries import op5_language_id

    got = {r.doc_id: r for r in op5_language_id(spark, "/root/testdata/sf0.01").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(lang)


def test_languages_are_those_of_a_plain_loop(spark, docs, rows):
    """Sizes again, text by text: every whole text of sf0.001 and of the fixture, in blocks, with each dictionary."""
    known = L.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "text", "lang")
    assert set(known) == {"de", "en", "es", "fr"} and all(10_000 < len(d) <= (96 << 10) + 1 for _, d in known.values())
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = Counter((r.doc_id, r.lang_pred, round(r.margin, 9), round(r.score, 9), r.rejected) for r in L.identify(docs.select("doc_id", "text").unionByName(more), known).collect())
    press = {k: zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for k, (_, d) in known.items()}
    want = Counter()
    for i, t in [r[:2] for r in rows] + [tuple(r) for r in more.collect()]:
        if not any(c.isalpha() for c in t or ""):
            want[i, "und", 0.0, 0.0, True] += 1
            continue
        raw = " ".join("".join(c if c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in t.lower()).split(" ")).encode()
        raw = b" ".join(raw.split())
        size = {k: sum(len(p.compress(raw[x : x + 8192])) for x in range(0, len(raw), 8192)) for k, p in press.items()}
        best = min(size, key=lambda k: (size[k], -known[k][0], k))
        rest = [s for k, s in size.items() if k != best]
        margin = 1 - size[best] / min(rest)
        want[i, best, round(margin, 9), round(1 / (1 + sum(2.0 ** -(2 * (s - size[best])) for s in rest)), 9), margin < 0.01] += 1
    assert got == want


def test_samples_of_long_texts_come_from_all_over_them(spark):
    text = " ".join(f"{chr(97 + i // 2600 % 26)}{i}" for i in range(60_000))
    df = spark.createDataFrame([(text, "xx"), ("short", "yy")], "t string, l string")
    got = L.learn(df, "t", "l")
    assert set("abw") <= set(got["xx"][1].decode()) and len(got["xx"][1]) < 2100 and got["yy"] == (1, b"short ")


def test_language_edges(docs, empty, rows):
    rng = random.Random(1)
    known = {"aa": (10, b" ".join(bytes(rng.choices(b"abcd", k=5)) for _ in range(2000))), "zz": (10, b" ".join(bytes(rng.choices(b"wxyz", k=5)) for _ in range(2000)))}
    got = L.identify(docs, known).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und") == (r.score == 0.0) for r in got)
    assert L.learn(empty, "text", "lang") == {} and L.identify(empty, {}).count() == 0
    assert all(r.lang_pred == "und" for r in L.identify(docs, {}).collect())
    assert set(L.learn(docs, "text", "lang")) == {"en", "fr"}
