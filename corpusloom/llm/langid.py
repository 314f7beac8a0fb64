"""Language identification by compression against per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import slices

#: ASCII other than letters becomes a blank: case, digits and marks say little of the language.
_LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
_OUT = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def _plain(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def _spread(text: F.Column, chars: int, windows: int = 8) -> F.Column:
    """At most ``chars`` characters of a text: all of it, or windows spread evenly from its first to its last character."""
    each = chars // windows
    parts = [F.substr(text, F.floor(F.lit(i) * (F.length(text) - each) / (windows - 1)).cast("int") + 1, F.lit(each)) for i in range(windows)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws(" ", *parts))


def learn(train: DataFrame, text_col: str, lang_col: str, docs_per_lang: int = 300, chars_per_doc: int = 2000, dict_bytes: int = 96 << 10) -> dict[str, tuple[int, bytes]]:
    """Language -> rows seen, and one raw-content dictionary, from a bounded sample of labelled rows.

    Bound: about ``docs_per_lang`` texts, chosen by a hash of the text, with ``chars_per_doc`` characters each (of longer texts windows
    from all over them), and ``dict_bytes`` in all.  Rows with a null text, language or an empty text teach nothing; rows that
    stand repeated are drawn alike; no rows give no language.  Languages are few: a row for each reaches the driver."""
    src = train.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l")).filter("l is not null and length(t) > 0")
    counts = {r[0]: r[1] for r in src.groupBy("l").count().collect()}
    if not counts:
        return {}
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs_per_lang / n))])
    u = (F.xxhash64("t").bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
    rows = src.filter(u < rate[F.col("l")]).select("l", _spread(F.col("t"), chars_per_doc).alias("t"), F.xxhash64("t").alias("h")).collect()
    out: dict[str, bytearray] = {}
    for lang, text, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        have = out.setdefault(lang, bytearray())
        if len(have) < dict_bytes:
            have += _plain(text)[: dict_bytes - len(have)] + b" "
    missed = sorted(counts.keys() - out.keys())  # a rate can miss a rare language's only rows
    if missed:
        for lang, text in src.filter(F.col("l").isin(missed)).groupBy("l").agg(F.min(_spread(F.col("t"), chars_per_doc))).collect():
            out[lang] = bytearray(_plain(text))
    return {k: (counts[k], bytes(v)) for k, v in sorted(out.items())}


def _classify(dictionaries: dict[str, tuple[int, bytes]], level: int, block: int, min_margin: float):
    def run(batches):
        names = sorted(dictionaries, key=lambda k: (-dictionaries[k][0], k))
        press = []
        for k in names:
            d = zstandard.ZstdCompressionDict(dictionaries[k][1], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            press.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        for b in slices(batches, 1, 8 << 20, 65536):
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t or not names or not any(map(str.isalpha, t)):
                    out.append((d, "und", 0.0, 0.0, True))
                    continue
                raw = _plain(t)
                parts = [raw[i : i + block] for i in range(0, len(raw), block)]
                sizes = [sum(len(c(p)) for p in parts) for c in press]
                best = min(range(len(names)), key=sizes.__getitem__)  # of equal sizes the first, the most frequent language
                rest = [s for i, s in enumerate(sizes) if i != best]
                margin = 1 - sizes[best] / max(1, min(rest)) if rest else 1.0
                score = 1 / (1 + sum(2.0 ** (-min(1000, 2 * (s - sizes[best]))) for s in rest))
                out.append((d, names[best], score, margin, margin < min_margin))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()))], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, tuple[int, bytes]], id_col: str = "doc_id", text_col: str = "text", level: int = 6, block: int = 8192, min_margin: float = 0.01) -> DataFrame:
    """The language whose dictionary makes a whole text smallest: doc_id, lang_pred, score, margin, rejected.

    A text is compressed in blocks of ``block`` bytes, all of them, with each dictionary, and sizes are summed; of equal sizes the more
    frequent language's stands.  margin is the share that the best size is below the next; under ``min_margin`` the answer is marked
    rejected (lang_pred still names the best).  Null, empty and letterless texts are ``und`` with score 0, rejected.
    One pass without a shuffle; repeated rows are classified alike."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(_classify(dictionaries, level, block, min_margin), _OUT)
