"""Fixity audit of WARC replicas with Merkle trees over ordered records."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import written

FANOUT = 16
_REC = "archive string, ord long, uri string, offset long, length long, payload binary, damaged boolean"
_START = re.compile(rb"WARC/\d+\.\d+\r?\n")


def _unzip(data: bytes) -> tuple[bytes, bool]:
    """Bytes of all gzip members, as far as each goes; was any of them broken?  After a broken one the next header is looked for."""
    out, at, broken = [], 0, False
    while at < len(data):
        z = zlib.decompressobj(31)
        try:
            while at < len(data) and not z.eof:
                piece = data[at : at + (1 << 16)]
                out.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
            broken |= not z.eof
        except zlib.error:
            broken = True
            nxt = data.find(b"\x1f\x8b\x08", at + 1)
            at = len(data) if nxt < 0 else nxt
    return b"".join(out), broken


def parse(data: bytes) -> Iterator[tuple[int, int, str, bytes, bool]]:
    """(offset, length, target URI, body, damaged) of each record of an uncompressed or per-record gzipped WARC file.

    A record that is cut, has no readable length or doesn't end in two line ends is damaged: its body is what stands between
    it and the next record's first line (or the file's end), and reading goes on there.  Bytes before the first record, between records and
    in broken gzip members are damaged records too, with an empty URI.  An empty file has no record."""
    broken = False
    if data[:2] == b"\x1f\x8b":
        data, broken = _unzip(data)
        if broken and not data:
            yield 0, 0, "", b"", True
    at = 0
    while at < len(data):
        nxt = _START.search(data, at + 1)
        stop = nxt.start() if nxt else len(data)
        head_end = data.find(b"\r\n\r\n", at) + 4
        if not _START.match(data, at) or head_end < 4:
            yield at, stop - at, "", data[at:stop], True
            at = stop
            continue
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in data[at:head_end].split(b"\r\n")[1:] if x)}
        uri = head.get(b"warc-target-uri", b"").decode(errors="replace")
        size = head.get(b"content-length", b"")
        end = head_end + int(size) + 4 if size.isdigit() and len(size) < 19 else -1
        if 0 <= end <= len(data) and data[end - 4 : end] == b"\r\n\r\n":
            yield at, end - at, uri, data[head_end : end - 4], False
            at = end
        else:
            yield at, stop - at, uri, data[head_end:stop], True
            at = stop


def record(uri: str, body: bytes, kind: str = "resource") -> bytes:
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, a file in one task: archive (file name), ord, uri, offset, length, payload, damaged.

    Damaged files give what can be read of them (``parse``); an empty file gives nothing, and so does a folder without files."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for i, (o, n, u, body, hurt) in enumerate(parse(data.as_py())):
                    rows.append((name.rsplit("/", 1)[-1], i, u, o, n, body, hurt))
                    size += len(body)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _REC)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _REC.split(", ")])


def aligned(base: DataFrame, copy: DataFrame, by: str = "uri") -> DataFrame:
    """``copy`` with the positions (ord, offset) that its records have in ``base``, so that a lost record shifts nothing.

    Records correspond that have the same archive and ``by`` and stand at the same place among those that share them (in order of
    ord).  Records of the copy that the base lacks come after the base's last position of their archive.  A null or empty ``by`` is a value like
    any other; records of one that stands often in an archive (damaged ones, say) are matched in their order."""
    key = ["archive", by]
    flat = lambda df: df.withColumn("archive", F.coalesce(F.col("archive").cast("string"), F.lit(""))).withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit(""))).withColumn("__nth", F.row_number().over(W.partitionBy(*key).orderBy("ord", "offset")))
    mine = flat(base).select(*key, "__nth", F.col("ord").alias("__ord"), F.col("offset").alias("__offset"))
    met = flat(copy).join(mine, [*key, "__nth"], "left")
    ends = flat(base).groupBy("archive").agg((F.max("ord") + 1).alias("__end"))
    extra = F.coalesce("__end", F.lit(0)) + F.col("ord")
    return met.join(ends, "archive", "left").select(*[F.coalesce("__ord", extra).alias("ord") if c == "ord" else F.coalesce("__offset", "offset").alias("offset") if c == "offset" else F.col(f"`{c}`") for c in copy.columns])


def leaves(records: DataFrame) -> DataFrame:
    """One leaf for each (archive, ord): its hash covers the payload's digest, its length and how often it stands there.

    records: archive, ord, offset, length, payload.  A null archive is '', a null ord -1, a null payload hashes as such.
    Records that share archive and ord make one leaf whose hash doesn't depend on their order; other columns aren't looked at."""
    r = records.select(
        F.coalesce(F.col("archive").cast("string"), F.lit("")).alias("archive"), F.coalesce(F.col("ord").cast("long"), F.lit(-1)).alias("node"), F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"),
        F.coalesce(F.sha2(F.col("payload").cast("binary"), 256), F.lit("null")).alias("digest"),
    )
    r = r.groupBy("archive", "node").agg(F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.min("digest").alias("digest"), F.max("digest").alias("d2"), F.count("*").alias("n"), F.sum("length").alias("length"), F.bit_xor(F.xxhash64("digest")).alias("x"))
    return r.select("archive", "node", "offset", "stop", "length", "digest", F.sha2(F.concat_ws("|", "digest", "d2", "n", "length", "x"), 256).alias("hash"))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: each node hashes the (at most ``fanout``) nodes of its offset range in order."""
    kids = F.array_sort(F.collect_list(F.struct("node", "hash")))
    up = level.groupBy("archive", F.floor(F.col("node") / fanout).cast("long").alias("up")).agg(kids.alias("kids"), F.min("offset").alias("offset"), F.max("stop").alias("stop"))
    return up.select("archive", F.col("up").alias("node"), "offset", "stop", F.sha2(F.concat_ws("|", F.transform("kids", lambda k: F.concat_ws(":", k["node"], k["hash"]))), 256).alias("hash"))


def tree(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the trees of all archives, leaves first, each written; the last has the roots."""
    levels = [written(leaves(records), "leaves")]
    most = levels[0].agg(F.max("node")).first()[0]
    while (most or 0) >= 1:
        levels.append(written(parents(levels[-1], fanout), "nodes"))
        most = (most or 0) // fanout
    return levels


def audit(replica_a: DataFrame, replica_b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records in which two replicas differ: archive, ord, offset, length, digest_a, digest_b, status, checked.

    status: ``corrupt``, ``missing`` (not in b) or ``extra`` (not in a); checked: nodes compared along the descent, for all rows
    alike.  Roots are compared first; each level down only children of mismatching nodes are joined, so that equal
    branches cost nothing below the node where they agree.  Empty replicas have no nodes; everything is then missing or extra.
    Nulls and repeated records are as in ``leaves``.  Records are compared by (archive, ord); a replica that lost records and was
    numbered anew is put in the base's order by ``aligned`` first."""
    a, b = tree(replica_a, fanout), tree(replica_b, fanout)
    while len(a) != len(b):  # the shallower tree's roots are lifted
        low = a if len(a) < len(b) else b
        low.append(written(parents(low[-1], fanout), "nodes"))
    bad, checked = None, 0
    for k in range(len(a) - 1, -1, -1):
        pick = lambda t: t if bad is None else t.withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(bad, ["archive", "up"], "left_semi").drop("up")  # noqa: B023, E731
        x, y = pick(a[k]), pick(b[k])
        both = x.alias("x").join(y.alias("y"), ["archive", "node"], "full_outer")
        differ = both.filter("NOT (x.hash <=> y.hash)")
        if k:
            seen = written(both.select("archive", "node", F.expr("NOT (x.hash <=> y.hash)").alias("differ")), "descent")
            checked += seen.count()
            bad = seen.filter("differ").select("archive", F.col("node").alias("up"))
    status = F.when(F.col("y.hash").isNull(), "missing").when(F.col("x.hash").isNull(), "extra").otherwise("corrupt")
    return differ.select("archive", F.col("node").alias("ord"), F.coalesce("x.offset", "y.offset").alias("offset"), F.coalesce("x.length", "y.length").alias("length"), F.col("x.digest").alias("digest_a"), F.col("y.digest").alias("digest_b"), status.alias("status"), F.lit(checked).cast("long").alias("checked"))
