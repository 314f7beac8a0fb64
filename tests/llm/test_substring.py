import hashlib
import random
from collections import Counter

from corpusloom.llm import substring as S

from .conftest import words


def brute(rows, k=35):
    all_ = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in all_ for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, all_):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_same_as_brute_force(docs, rows):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in S.remove_repeated(docs).collect()), key=str)
    assert got == sorted(brute([(r[0], r[1]) for r in rows]), key=str)


def test_intervals_are_maximal(spark):
    w = [f"w{i}" for i in range(100)]
    data = [(1, " ".join(w)), (2, " ".join(["x"] + w[10:60] + ["y"] + w[70:80]))]
    got = {r.doc_id: [(x.start, x.stop) for x in r.removed] for r in S.remove_repeated(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: [(10, 60)], 2: [(1, 51)]}


def test_empty(empty):
    assert S.remove_repeated(empty).count() == 0


def test_boilerplate_of_every_document(spark):
    rng = random.Random(4)
    boiler = " ".join(f"b{i}" for i in range(60))
    data = [(i, " ".join(f"u{rng.randrange(10**7)}" for _ in range(20)) + (" " + boiler) * (1 + i % 3 // 2)) for i in range(500)]
    data += [(1000, " ".join(boiler.split()[:35])), (1001, " ".join(boiler.split()[:34])), (1002, " ".join(["same"] * 90))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")) for r in S.remove_repeated(df).collect())
    assert got == sorted(brute(data))
