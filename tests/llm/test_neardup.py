import random

from corpusloom.llm import neardup as N

from .conftest import words


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set())


def brute(rows):
    """Component of each row; rows with a null id are left alone."""
    sets = [(i, shingles(t)) for i, t in rows]
    own = list(range(len(sets)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a[0] is not None and b[0] is not None and a[1] and b[1] and 100 * len(a[1] & b[1]) >= 75 * len(a[1] | b[1]):
                own[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), None if d is None else least[root(i)], d is None or least[root(i)] == d) for i, (d, s) in enumerate(sets)]


def test_components_are_those_of_brute_force(docs, rows):
    got = sorted(map(tuple, N.components(docs).collect()), key=str)
    assert got == sorted(brute([(r[0], r[1]) for r in rows]), key=str)


def family(rng, k):
    base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 40, 200]))]
    out = []
    for _ in range(k):
        t = list(base)
        for _ in range(rng.randrange(0, max(2, len(t) // 6))):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_groups_and_crowded_lists(spark):
    rng = random.Random(3)
    texts = [t for k in (2, 3, 5, 40, 80) for t in family(rng, k)]
    texts += ["common phrase " + f"r{i} s{i}" for i in range(40)]
    data = list(enumerate(rng.sample(texts, len(texts))))
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted(brute(data))
    assert sorted(map(tuple, N.components(df).collect())) == want
    assert sorted(map(tuple, N.components(df, hot=3).collect())) == want  # every list is split by a second coordinate


def test_matches_needed():
    assert N.matches_needed(64, 1.0) == 64
    assert 25 <= N.matches_needed(64, 0.75) <= 34


def test_connected_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in N.connected(edges).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] != got[0]


def test_empty(empty):
    assert N.components(empty).collect() == []


def test_links_are_those_of_brute_force(spark, docs, rows):
    rng = random.Random(8)
    data = [(i, t) for i, t in enumerate([t for k in (2, 5, 30) for t in family(rng, k)] * 2)]
    pairs, members = N.links(spark.createDataFrame(data, "doc_id long, text string"))
    sets = [shingles(t) for _, t in data]
    first = {frozenset(s): i for i, s in reversed(list(enumerate(sets)))}
    assert sorted(map(tuple, members.collect())) == [(i, first[frozenset(s)]) for i, s in enumerate(sets)]
    reps = sorted(first.values())
    want = [(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert sorted(map(tuple, pairs.collect())) == want
    assert N.links(docs)[1].count() == sum(r[0] is not None and bool(shingles(r[1])) for r in rows)


def test_kept_rows_stay_whole(docs, rows, empty):
    want = sorted((r[:5] for r, k in zip(rows, brute([(r[0], r[1]) for r in rows])) if k[3]), key=str)
    got = N.keep_first(docs)
    assert got.columns == docs.columns and sorted((tuple(r)[:5] for r in got.collect()), key=str) == want
    assert N.keep_first(empty).collect() == []
