import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "bucket int, n long, key string, row string, stratum string, kept boolean, label string, sig string, cls string, slot int, a string, b string, c string, count int, kept_text string, removed string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def make(rng, n):
    return [rng.choice(["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(40)) for _ in range(n)]


def corpus():
    """Nulls, empty, blank and very long texts, single words, ties, exact, near and partial copies, repeated rows, a null id."""
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "One", "one two", "ONE two", "#** & <> 42", "ß Ünï x  y", "a\nb\na\n\na b\na b"]
    base = make(rng, 300)
    texts += [" ".join(base), " ".join(base)]
    for k in (3, 10, 20, 40, 60):
        t = list(base)
        for _ in range(k):
            t[rng.randrange(len(t))] = "new" + str(rng.randrange(999))
        texts.append(" ".join(t))
    shared = make(rng, 50)
    texts += [" ".join(make(rng, 30) + shared + make(rng, 30)) for _ in range(4)]
    texts += ["\n".join(" ".join(make(rng, rng.randrange(1, 60))) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    texts += [" ".join(["spam"] * 100), " ".join(make(rng, 40) * 3), " ".join(make(rng, 30_000))]
    rows = [(i, t, None if i % 9 == 0 else ("en", "fr")[i % 2], "s", 0) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, texts[25], "en", "s", 0), (None, None, None, None, None)]
    return [r + (None,) * 16 for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
