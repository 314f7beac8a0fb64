import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.models import WordLevel
from tokenizers.pre_tokenizers import Whitespace

from corpusloom.llm import packing as P
from corpusloom.llm.queries import TOKENIZER


def check(got, rows, room):
    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    by, seqs = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for ps in seqs.values():
        at = 0
        for off, n in sorted(ps):
            assert off == at and n > 0
            at += n
        assert at <= room
    for d in {r[0] for r in rows}:
        want = []
        for t in (r[1] for r in rows if r[0] == d):
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            want += [(s, len(ids[s : s + room]), zlib.crc32(ids[s : s + room].tobytes()), len(ids)) for s in range(0, len(ids), room)]
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by.pop(d)) == sorted(want)
    assert not by
    return seqs


def test_round_trip(docs, rows):
    for room in (2048, 64):
        seqs = check(P.pack(docs, TOKENIZER, room=room).collect(), rows, room)
        used = sum(n for ps in seqs.values() for _, n in ps)
        assert len(seqs) <= used // room + 3


def test_special_names_and_wide_spaces(spark):
    texts = ["<|endoftext|> x", "a  b   c", "tab\t x  y 　 z", "it's  we'll 12 345  ...  !!", "\n\n x \n", "é è  ü", "x" * 9000, " " * 5000]
    data = list(enumerate(texts))
    check(P.pack(spark.createDataFrame(data, "doc_id long, text string"), TOKENIZER).collect(), data, 2048)


def test_patterns_hold_every_length():
    rng = random.Random(2)
    for _ in range(30):
        room = rng.choice([10, 64, 2048])
        hist = {rng.randrange(1, room + 1): rng.randrange(1, 1000) for _ in range(rng.randrange(1, 80))}
        packs = P.spfhp(hist, room)
        got = {}
        for c, parts in packs:
            assert sum(parts) <= room and list(parts) == sorted(parts, reverse=True)
            for x in parts:
                got[x] = got.get(x, 0) + c
        assert got == hist
    assert P.spfhp({}, 8) == []


def test_empty(empty):
    assert P.pack(empty, TOKENIZER).collect() == []


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tok):
        self.tok, self.texts = tok, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.tok.encode_batch_fast(texts, **how)


def ids_of(encoder, texts):
    flat, bounds = encoder(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_new_units_share_calls_and_keep_their_ids():
    """Units that may stand after each other are encoded several at a time; ends in white space, odd beginnings and other scripts are not mixed up."""
    rng = random.Random(7)
    parts = ["a", "Ab", "tion", "é", "ß", "ñ", "中", "😀", "\n", "\t", "\xa0", " ", "　", "\x85", "  ", "'s", "'", "12", "...", "_", "<|endoftext|>", "à"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(rng.randrange(0, 60))) + rng.choice(["", " ", "\n", "\xa0"]) for _ in range(300)]
    texts += [None, "", " ", " x", "x ", "\xa0x y", "x" * 9000 + " y", "y " + "é" * 5000]
    encoder = P._Encoder(TOKENIZER)
    encoder.tok, tok = (counting := Counting(encoder.tok)), encoder.tok
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids_of(encoder, texts[:100]) + ids_of(encoder, texts[100:]) == want
    assert ids_of(encoder, texts[::-1]) == want[::-1]
    counting.texts = 0
    plain = ["start" + "".join(f" unit{i}" for i in range(5000))]
    assert ids_of(encoder, plain) == [tok.encode(plain[0], add_special_tokens=False).ids]
    assert counting.texts <= 1000  # 5001 new units


def test_vocabularies_that_are_not_of_bytes(tmp_path):
    """Widths of their tokens say nothing about the texts: every unit is encoded by itself."""
    made = Tokenizer(WordLevel({"?": 0, "one": 1, "two": 2, "é": 3}, unk_token="?"))
    made.pre_tokenizer = Whitespace()
    made.save(str(tmp_path / "words.json"))
    texts = ["one two é three", "", None, "é é  one\n", "three four five two"]
    assert ids_of(P._Encoder(str(tmp_path / "words.json")), texts) == [made.encode(t or "", add_special_tokens=False).ids for t in texts]
