import gzip
import re
from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from corpusloom.llm import decontam as D
from corpusloom.llm import licenses as C
from corpusloom.llm import warc as A


def test_items_in_long_documents(spark, docs, empty):
    item = " ".join(f"q{i}" for i in range(30))
    filler = " ".join(f"z{i}" for i in range(5000))
    broken = item.split()
    broken[15] = "oops"
    data = [(1, filler + " " + item.upper() + "! " + filler), (2, " ".join(broken)), (3, " ".join(item.split()[:12])), (4, None), (5, ""), (6, "x yes, No. x"), (6, "x yes, No. x")]
    items = spark.createDataFrame([(7, item), (7, item), (8, "yes no"), (9, None), (10, ""), (None, item), (11, "...")], "item_id long, text string")
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shingles, r.n_matched) for r in D.find(df, items).collect())
    assert got == [(1, 7, 26, 26), (2, 7, 26, 21), (6, 8, 1, 1), (6, 8, 1, 1)]
    assert sorted(map(tuple, D.find(df, items, block_chars=10).collect())) == sorted(map(tuple, D.find(df, items).collect()))
    assert D.find(empty, items).count() == 0 and D.find(df, items.limit(0)).count() == 0
    assert D.find(docs, items).count() == 0


def spread(items, docs, k=5, threshold=0.7):
    """Brute force: (doc, item, shingles, matched), the best text of an item."""
    cut = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    out = []
    for d, t in docs:
        best = {}
        for i, x in items:
            w = cut(x)
            own = min(k, len(w))
            if not own or i is None or t is None:
                continue
            sh = {tuple(w[p : p + own]) for p in range(len(w) - own + 1)}
            dw = cut(t)
            hit = len(sh & {tuple(dw[p : p + own]) for p in range(len(dw) - own + 1)})
            if hit >= threshold * len(sh) - 1e-9:
                best[i] = max(best.get(i, (0, 0, 0)), (hit / len(sh), len(sh), hit))
        out += [(d, i, n, h) for i, (_, n, h) in best.items()]
    return sorted(out, key=str)


def test_items_with_sparse_ids_and_several_texts(spark, docs, rows):
    words = (rows[10][1] or "").split()
    items = [(1_000_000 + 7 * i, " ".join(words[i : i + 12])) for i in range(250)] + [(-5, "one two"), (-5, " ".join(words[5:60])), (-5, "not there at all"), (1 << 60, "one")]
    long_ = [(900, " ".join(f"v{i}" for i in range(200_000)) + " " + items[3][1])]
    long_ += [(901, items[3][1])] * 2
    want = spread(items, [(r[0], r[1]) for r in rows] + long_)
    df = docs.select("doc_id", "text", "n", "key", "label").unionByName(spark.createDataFrame(long_, "doc_id long, text string"), allowMissingColumns=True)
    for block in (8 << 20, 5000):
        got = D.find(df, spark.createDataFrame(items, "item_id long, text string"), block_chars=block)
        assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_matched) for r in got.collect()), key=str) == want
    assert len(want) > 500 and (900, items[3][0], 8, 8) in want


def test_an_index_of_many_items():
    texts = [" ".join(f"w{i * 5 + j}" for j in range(12)) for i in range(100_000)]
    parts = D.index_items(texts, 5, 0.7)
    assert [(own, p, len(keys)) for own, p, keys, _ in parts] == [(5, 4, 300_000)]


def test_licences(spark, docs, empty):
    known = C.known_digests(spark)
    mit = C.KNOWN["MIT"]
    data = [(1, "Copyright (c) 2020 A. Person\n\n" + mit), (2, mit.upper().replace(" ", "  ")), (3, mit + " and more"), (4, None), (5, ""), (6, mit.replace("sublicense", "sub-license").replace("\n\n", "\n"))]
    got = {r.doc_id: r.license_id for r in C.scan(spark.createDataFrame(data, "doc_id long, text string"), known).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: "MIT"}
    assert C.scan(docs, known).count() == docs.count() and C.scan(empty, known).count() == 0
    assert known.count() == len(C.KNOWN)


def test_whole_licences_are_found_as_in_sql(spark, docs, rows, tmp_path):
    """A table in which every known text stands whole, spelt otherwise, with a notice and repeated; and a clashing column."""
    for name in ("Apache-2.0", "GPL-2.0"):
        (tmp_path / f"{name}.txt").write_text(f"{name} made up\n\nTerms of {name}, section 1.\n" * 400)
    long_ = {r.license_id: r.digest for r in C.digests_of(C.texts_in(spark, str(tmp_path))).collect()}
    texts = C.KNOWN | {n: (tmp_path / f"{n}.txt").read_text() for n in long_}
    data = [(i, t) for i, t in enumerate(t for v in texts.values() for t in (v, v.upper(), "Copyright 2021 Someone\n" + v.replace(" ", "\n  ").replace(",", " ;"), v + " x"))] * 2
    df = spark.createDataFrame(data, "doc_id long, text string").unionByName(docs.select("doc_id", "text", "key", "label"), allowMissingColumns=True)
    got = sorted(map(tuple, C.scan(df.withColumn("digest", F.lit("x")).withColumn("license_id", F.lit("y")), C.known_digests(spark, digests=long_)).collect()), key=str)
    table = pd.DataFrame(data + [(r[0], r[1]) for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", table)
    assert got == sorted(con.sql(C.scan_sql(digests=long_)).fetchall(), key=str)
    found = Counter(r[2] for r in got)
    assert all(found[n] == 6 for n in texts)
    assert len(C.DIGESTS) >= 13 and C.known_digests(spark, digests=C.DIGESTS).count() == len(C.KNOWN) + len(C.DIGESTS)


def records(spark, rows):
    return spark.createDataFrame(rows, "archive string, ord long, offset long, length long, payload binary")


def test_audit_finds_every_difference(spark):
    good = [(f"f{a}", i, i * 10, 10, f"{a}-{i}".encode()) for a in range(3) for i in range(300)]
    bad = [r for r in good if r[:2] != ("f1", 17)]
    bad[40] = (*bad[40][:4], b"damaged")
    bad += [("f2", 300, 3000, 5, b"more"), ("new", 0, 0, 1, b"x")]
    got = sorted((r.archive, r.ord, r.status) for r in A.audit(records(spark, good), records(spark, bad)).collect())
    assert got == [("f0", 40, "corrupt"), ("f1", 17, "missing"), ("f2", 300, "extra"), ("new", 0, "extra")]
    same = A.audit(records(spark, good), records(spark, good))
    assert same.count() == 0


def test_audit_edges(spark):
    rows = [(None, None, None, None, None), ("a", 0, 0, 1, b""), ("a", 0, 0, 1, b""), ("a", 1, 1, 0, None)]
    one, none = records(spark, rows), records(spark, [])
    assert A.audit(one, one).count() == 0 and A.audit(none, none).count() == 0
    assert {r.status for r in A.audit(one, none).collect()} == {"missing"} and {r.status for r in A.audit(none, one).collect()} == {"extra"}
    assert [(r.archive, r.ord, r.status) for r in A.audit(one, records(spark, rows[1:])).collect()] == [("", -1, "missing")]
    assert [r.status for r in A.audit(one, records(spark, rows[:2] + rows[3:])).collect()] == ["corrupt"]  # a repeated record counts


def test_files(spark, tmp_path):
    parts = [A.record(f"http://x/{i}", f"body {i}\r\n\r\n".encode()) for i in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    got = A.read(spark, str(tmp_path)).collect()
    assert sorted((r.archive, r.ord, bytes(r.payload)) for r in got) == sorted((a, i, f"body {i}\r\n\r\n".encode()) for a in ("a.warc", "b.warc.gz") for i in range(5))
    (tmp_path / "c.warc").write_bytes(b"")
    assert A.read(spark, str(tmp_path / "c.warc")).count() == 0


def test_damaged_files_give_what_can_be_read(spark, tmp_path):
    parts = [A.record(f"http://x/{i}", f"body {i}".encode() * 9) for i in range(6)]
    whole = b"".join(parts)
    good = [(u, bytes(b), h) for _, _, u, b, h in A.parse(whole)]
    assert len(good) == 6 and not any(h for *_, h in good)
    cut = list(A.parse(whole[: len(whole) - 30]))
    assert [x[4] for x in cut] == [False] * 5 + [True] and cut[-1][2] == "http://x/5"
    no_length = list(A.parse(parts[0] + parts[1].replace(b"Content-Length", b"Content-Lengty") + parts[2]))
    assert [(x[2], x[4]) for x in no_length] == [("http://x/0", False), ("http://x/1", True), ("http://x/2", False)]
    garbled = list(A.parse(b"junk" + parts[0] + b"\x00\xff junk" + parts[1][:20]))
    assert [x[4] for x in garbled] == [True, False, True, True]
    assert sum(x[1] for x in garbled) == len(b"junk" + parts[0] + b"\x00\xff junk" + parts[1][:20])
    zipped = [gzip.compress(p) for p in parts]
    hurt = zipped[0] + zipped[1][:12] + b"\x00\x00\x00" + zipped[1][15:] + zipped[2]
    assert {x[2] for x in A.parse(hurt) if not x[4]} >= {"http://x/0", "http://x/2"}
    assert [x[4] for x in A.parse(zipped[0][:15])][-1:] == [True] and list(A.parse(b"")) == []
    assert [x[2:] for x in A.parse(b"".join(zipped))] == [(u, b, False) for u, b, _ in good]
    (tmp_path / "a.warc").write_bytes(whole[:-30])
    (tmp_path / "b.warc.gz").write_bytes(hurt)
    (tmp_path / "c.warc").write_bytes(A.record("http://x/long", b"x" * (9 << 20)) + parts[0])
    got = A.read(spark, str(tmp_path)).collect()
    assert {r.archive for r in got} == {"a.warc", "b.warc.gz", "c.warc"} and sum(r.damaged for r in got if r.archive == "a.warc") == 1
    assert [len(r.payload) for r in got if r.archive == "c.warc"] == [9 << 20, 54]


def test_a_lost_record_shifts_nothing(spark, tmp_path):
    for side, kept in (("a", range(20)), ("b", [i for i in range(20) if i != 7])):
        (tmp_path / side).mkdir()
        (tmp_path / side / "x.warc").write_bytes(b"".join(A.record(f"http://x/{i % 18}", f"body {i}".encode()) for i in kept) + (A.record("http://new", b"n") if side == "b" else b""))
    a, b = A.read(spark, str(tmp_path / "a")), A.read(spark, str(tmp_path / "b"))
    got = A.audit(a, A.aligned(a, b)).collect()
    assert sorted((r.ord, r.status) for r in got) == [(7, "missing"), (39, "extra")]
    assert A.audit(a, A.aligned(a, b.limit(0))).count() == 20 and A.aligned(a.limit(0), b).count() == 20


def test_audit_looks_at_its_own_columns_only(spark):
    rows = [("a", i, i, 1, b"x" * (1 << 22) if i == 3 else bytes([i])) for i in range(40)]
    df = records(spark, rows)
    for c in ("node", "hash", "digest", "up", "stop", "n", "x", "kids", "differ"):
        df = df.selectExpr("*", f"cast(rand() as string) AS {c}")
    assert A.audit(df, df).count() == 0
    assert [(r.ord, r.status) for r in A.audit(df, df.filter("ord <> 3")).collect()] == [(3, "missing")]
