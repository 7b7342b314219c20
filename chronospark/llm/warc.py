"""Fixity audit of WARC replicas with Merkle trees over records and offset ranges.

A leaf is the SHA-256 of one whole record.  Leaves are gathered by ranges of offsets
(64 KiB, then 64 times as much on each level), each node hashing the ordered offsets and
digests below it, up to one root per file.  An audit compares the roots of two replicas,
then only the children of nodes that differ, level by level, down to the records of the
ranges that differ.  There the records of both replicas are matched by their ids and
digests, so what only moved, because something before it was lost or has another length,
is told from what is damaged.

Status of a record: "ok" (the same bytes are in both; ``shift`` says by how much it
moved), "corrupt" (the id is in both with different bytes), "missing" or "extra" (only
the first or the second has it).  Records that repeat an id, or all of it, are matched
copy by copy in order of their offsets, equal bytes first.

Null urls and bodies are empty ones.  Records with a null id are written with an empty
one into files of their own (-1 and below, some ``per_file`` in each, by a hash of their
bytes).  Empty replicas give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import giving_back, materialize

#: Offsets are shifted right by so many bits for the nodes of each level; the last is the root.
SHIFTS = (16, 22, 28, 62)
SIDES = ("a", "b")


def record_of(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a response record, as text in UTF-8."""
    body = F.coalesce(body.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def pack(pages: DataFrame, per_file: int = 512, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Leaves (file, offset, length, id, digest) of pages packed in order of their ids.

    A file holds a range of ``per_file`` ids.  Only digests and lengths are shuffled, and
    equal records as one row with their count.
    """
    key = F.col(id_col).cast("long")
    nameless = pages.where(key.isNull()).count()
    record = record_of(F.col(id_col), F.col(url_col), F.col(body_col))
    own = F.coalesce(F.floor(key / per_file), -1 - F.pmod(F.xxhash64(F.sha2(record, 256)), F.lit(nameless // per_file + 1))).cast("long")
    leaves = pages.select(own.alias("file"), key.alias("id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    counted = leaves.groupBy("file", "id", "length", "digest").agg(F.count("*").alias("m"))
    before = Window.partitionBy("file").orderBy("id", "digest", "length").rowsBetween(Window.unboundedPreceding, -1)
    begin = counted.withColumn("begin", F.coalesce(F.sum(F.col("length") * F.col("m")).over(before), F.lit(0)))
    each = begin.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return each.select("file", (F.col("begin") + F.col("k") * F.col("length")).alias("offset"), "length", "id", "digest")


def _plain(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Uncompressed bytes of a plain file or of a gzip one with any number of members."""
    unzip = None
    for k, piece in enumerate(pieces):
        if k == 0 and piece[:2] == b"\x1f\x8b":
            unzip = zlib.decompressobj(31)
        if unzip is None:
            yield piece
            continue
        while piece:
            yield unzip.decompress(piece, 1 << 20)
            piece = unzip.unconsumed_tail
            if unzip.eof:
                piece, unzip = unzip.unused_data, zlib.decompressobj(31)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, record) of a WARC file that comes piece by piece; one
    record and one piece are in memory at a time."""
    source, held, at = _plain(pieces), b"", 0

    def until(test) -> bool:
        nonlocal held
        while not test():
            more = next(source, None)
            if more is None:
                return False
            held += more
        return True

    while until(lambda: len(held) > 0):
        until(lambda: len(held) >= 5)
        if not held.startswith(b"WARC/"):
            raise ValueError(f"no record at offset {at}")
        if not until(lambda: b"\r\n\r\n" in held):
            raise ValueError(f"no end of the header at offset {at}")
        head_end = held.index(b"\r\n\r\n")
        lines = held[:head_end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = head_end + 4 + int(headers.get("content-length", 0)) + 4
        until(lambda: len(held) >= size)
        record, held = held[:size], held[size:]
        yield at, len(record), headers, record
        at += len(record)


def read(spark: SparkSession, path: str, piece: int = 1 << 20) -> DataFrame:
    """Leaves of WARC files (plain or gzip) below a path: file, offset, length, id, digest.

    Offsets of gzip files are those of the uncompressed bytes.  A file is read by one
    task, which unpacks it record by record.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = ["file", "offset", "length", "id", "digest"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole, rows = memoryview(data.as_buffer()), []
                for offset, length, headers, record in parse(bytes(whole[i : i + piece]) for i in range(0, len(whole), piece)):
                    rows.append((name, offset, length, headers.get("warc-record-id"), hashlib.sha256(record).hexdigest()))
                    if len(rows) >= 10_000:
                        yield table(rows)
                        rows = []
                yield table(rows)

    return files.mapInArrow(giving_back(run), "file string, offset long, length long, id string, digest string")


def both(one: DataFrame, two: DataFrame) -> DataFrame:
    """The leaves of two replicas in one table, with the replica as ``side``."""
    columns = ["file", "offset", "length", "id", "digest"]
    sides = [x.select(F.lit(s).alias("side"), *columns) for s, x in zip(SIDES, (one, two))]
    return materialize(sides[0].unionByName(sides[1]), "leaves", large=True)


def tree(leaves: DataFrame) -> list[DataFrame]:
    """The levels above the leaves of both replicas, root last: file, node, a, b (digests).

    One table holds both sides, so a level is one aggregate; a node that only one replica
    has lacks the other digest.
    """
    below = leaves.select("file", F.col("offset").alias("node"), *[F.when(F.col("side") == s, F.col("digest")).alias(s) for s in SIDES])
    levels, done = [], 0
    for shift in SHIFTS:
        def digest(side: str):
            child = F.when(F.col(side).isNotNull(), F.struct("node", F.concat_ws(":", F.col("node").cast("string"), side).alias("child")))
            found = F.array_sort(F.collect_list(child))  # leaves out nulls
            return F.when(F.size(found) > 0, F.sha2(F.array_join(F.transform(found, lambda c: c["child"]), ","), 256)).alias(side)

        up = F.shiftright("node", shift - done)
        below = materialize(below.groupBy("file", up.alias("node")).agg(*[digest(s) for s in SIDES]), "nodes")
        levels.append(below)
        done = shift
    return levels


def differing(levels: list[DataFrame]) -> DataFrame:
    """(file, node) of the lowest ranges that differ, found from the roots down."""
    dirty: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k].where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")
        if dirty is not None:
            above = dirty.withColumnRenamed("node", "up")
            nodes = nodes.withColumn("up", F.shiftright("node", SHIFTS[k + 1] - SHIFTS[k])).join(above, ["file", "up"], "left_semi").select("file", "node")
        dirty = materialize(nodes, "dirty")
    return dirty


def _matched(leaves: DataFrame) -> DataFrame:
    """Records of the ranges that differ, with status and shift."""
    def paired(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Copy k of one side with copy k of the other."""
        copy = Window.partitionBy("side", "file", *keys).orderBy("offset")
        numbered = rows.withColumn("k", F.row_number().over(copy))
        return numbered.groupBy("file", *keys, "k").agg(*[F.max(F.when(F.col("side") == s, F.struct("offset", "length", "digest"))).alias(s) for s in SIDES])

    same = materialize(paired(leaves, ["id", "digest"]), "same")
    equal = same.where("a is not null and b is not null").select("file", "id", "a", "b", F.lit("ok").alias("status"))
    rest = same.where("a is null or b is null")
    rest = rest.select("file", "id", F.when(F.col("a").isNotNull(), SIDES[0]).otherwise(SIDES[1]).alias("side"), F.coalesce("a", "b").alias("r")).select("file", "id", "side", "r.*")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    odd = paired(rest, ["id"]).select("file", "id", "a", "b", status.alias("status"))
    out = equal.unionByName(odd).withColumn("r", F.coalesce("a", "b"))
    return out.select("file", "r.offset", "r.length", "id", "status", (F.col("b.offset") - F.col("a.offset")).alias("shift"))


def audited(one: DataFrame, two: DataFrame) -> DataFrame:
    """Every record of both replicas: file, offset, length, id, status and shift."""
    leaves = both(one, two)
    dirty = differing(tree(leaves)).withColumn("dirty", F.lit(True))
    marked = leaves.withColumn("node", F.shiftright("offset", SHIFTS[0])).join(dirty, ["file", "node"], "left")
    clean = marked.where("dirty is null and side = 'a'").select("file", "offset", "length", "id", F.lit("ok").alias("status"), F.lit(0).cast("long").alias("shift"))
    return clean.unionByName(_matched(marked.where("dirty")))


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """The records that are damaged, missing or extra, and those that moved."""
    return audited(one, two).where("status <> 'ok' or shift <> 0")
