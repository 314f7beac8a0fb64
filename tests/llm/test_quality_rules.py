import random
from collections import Counter
from math import comb

import numpy as np

from corpusloom.llm import quality_rules as Q

from .conftest import words


def brute(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit, count = set(), Counter(windows)
    for i, x in enumerate(windows):
        if count[x] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_features_are_those_of_brute_force(docs, rows):
    got = sorted((r[:6] for r in Q.features(docs).collect()), key=str)
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert got == want


def test_bound_is_exact():
    exact = sum(comb(30, i) * 0.1**i * 0.9 ** (30 - i) for i in range(3))
    assert abs(Q.tail_at_most(2, 30, 0.1) - exact) < 1e-12
    assert not Q.accepted(0, 0, 0.1, 0.1)
    assert Q.accepted(0, 100, 0.05, 0.01) and not Q.accepted(0, 50, 0.05, 0.01)


def lost(levels, depth, count):
    """Documents that any rule rejects, one cell after another."""
    names = sorted(Q.RULES)
    return sum(int(c) for lv, c in zip(levels, count) if any(d and lv[i] >= len(Q.GRID[names[i]]) + 1 - d for i, d in enumerate(depth)))


def cells(rng, n_good, n_bad):
    rows = Counter(tuple(rng.choices(range(6), [40, 1, 1, 1, 1, 1])[0] if q == 0 else (rng.random() < 0.004) * rng.randrange(6) for _ in range(4)) + (q,) for q in [1] * n_good + [0] * n_bad)
    levels = np.array([k[:4] for k in rows])
    count = np.array(list(rows.values()))
    q = np.array([k[4] for k in rows])
    return levels, np.where(q == 1, count, 0), np.where(q == 0, count, 0)


def test_width_is_the_largest_antichain():
    assert Q._width((6, 6, 6, 6)) == 146 and Q._width((3, 3)) == 3 and Q._width((5,)) == 1


def test_cutoffs_are_those_of_a_search_by_hand():
    names = sorted(Q.RULES)
    for seed in range(6):
        levels, good, bad = cells(random.Random(seed), 3000, 400)
        got = Q.choose(levels, good, bad, 0.02, 0.05)
        n, limit = int(good.sum()), 0.05 / 146
        ok = lambda d: sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(lost(levels, d, good) + 1)) <= limit  # noqa: B023, E731
        depth = (0, 0, 0, 0)
        while steps := [d for i in range(4) if (d := depth[:i] + (depth[i] + 1,) + depth[i + 1 :])[i] <= 5 and ok(d)]:
            depth = max(steps, key=lambda d: (lost(levels, d, bad), -lost(levels, d, good), d))  # noqa: B023
        assert got == {r: Q.GRID[r][5 - d] for r, d in zip(names, depth) if d} and got


def test_few_labels_are_judged_along_sequences():
    levels = np.array([[0, 0, 0, 0], [5, 0, 0, 0], [0, 0, 0, 5]])
    got = Q.choose(levels, np.array([230, 0, 0]), np.array([0, 3, 4]), 0.02, 0.05)
    assert got == {r: Q.GRID[r][0] for r in Q.RULES}  # nothing good is lost, so a sequence goes to its end
    assert Q.choose(levels, np.array([100, 0, 0]), np.array([0, 3, 4]), 0.02, 0.05) == {}
    one = Q.choose(levels, np.array([230, 1, 0]), np.array([0, 3, 4]), 0.02, 0.05)
    assert sorted(Q.RULES)[0] not in one and one


def test_false_rejections_stay_within_alpha_on_the_holdout(spark):
    rng = random.Random(1)
    text = lambda i: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + (" #" * rng.choice([0, 0, 0, 1, 2]) if i % 3 else " #" * 50)
    data = [(i, text(i), "en") for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _, _ in data] + [(1, 1), (999999, 1), (None, 1)], "doc_id long, quality int")
    got = Q.filter_quality(spark.createDataFrame(data, "doc_id long, text string, lang string"), labels).collect()
    good = [r for r in got if r.doc_id % 3]
    assert sum(not r.kept for r in good) <= 0.02 * len(good)
    assert not any(r.kept for r in got if r.doc_id % 3 == 0)
    kept = Q.keep_quality(spark.createDataFrame(data, "doc_id long, text string, lang string"), labels)
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert all("symbols" in r.broken for r in got if r.doc_id % 3 == 0)


def test_edges(spark, docs, empty, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.filter_quality(docs, none).collect()
    assert len(got) == len(rows)
    assert all(r.kept != r.base_failed for r in got)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert Q.filter_quality(empty, none).count() == 0
    assert Q.keep_quality(docs, none).count() == sum(r.kept for r in got) and Q.keep_quality(empty, none).columns == empty.columns


def test_verdicts_of_the_query_are_those_of_its_cutoffs(spark):
    """Every row of sf0.01 again: level cells counted in a loop, the cutoffs of each language, and whether a row breaks one."""
    from corpusloom.llm.queries import op3_quality_rules

    got = op3_quality_rules(spark, "/root/testdata/sf0.01").collect()
    told = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    names = sorted(Q.RULES)
    level = lambda r: tuple(0 if r.base_failed else sum(100 * r[Q.RULES[x][0]] > c * r[Q.RULES[x][1]] for c in Q.GRID[x]) for x in names)
    by = {}
    for r in got:
        if r.doc_id in told:
            by.setdefault(r.stratum, Counter())[(*level(r), told[r.doc_id])] += 1
    able = {s: c for s, c in by.items() if sum(n for k, n in c.items() if k[4] == 1) >= Q.labels_needed(0.02, 0.05)}
    cuts = {}
    for s, c in able.items():
        arr = [np.array([n if k[4] == q else 0 for k, n in c.items()]) for q in (1, 0)]
        cuts[s] = Q.choose(np.array([k[:4] for k in c]), *arr, 0.02, 0.05 / len(able))
    assert cuts["en"]  # something is certified at this size
    for r in got:
        broken = sorted(x for x, c in cuts.get(r.stratum, {}).items() if 100 * r[Q.RULES[x][0]] > c * r[Q.RULES[x][1]])
        assert sorted(r.broken) == broken and r.kept == (not r.base_failed and not broken)
    assert any(r.broken and not r.base_failed for r in got)
