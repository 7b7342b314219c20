"""Near-duplicate vectors: sign hashes in several tables, exact cosines, components.

Only vectors with the same label are compared.  Identical vectors form a class that is
handled once, with its size.  Each class has one signature, the signs of its products
with random directions; every table takes some bits of it as its code and deals the
class to a bucket.  Only signatures and ids travel there.  Inside a bucket two classes
are candidates if their whole signatures differ in no more bits than vectors at the
threshold do (but for one in 10 ** 7 such pairs), and a spanning forest of them leaves
the bucket.  The candidates are closed to groups; the vectors of each group meet once,
where all cosines are computed in double precision, links are counted exactly and a
spanning forest gives the components.  Buckets and groups of more than ``block`` classes
are cut into blocks that meet pairwise in tasks of their own.

With directions at random two vectors at cosine c share a code of k bits with
probability (1 - acos(c) / pi) ** k.  Where they are not given, bits follow the size of
the largest label (some 32 classes in a bucket) and tables follow the bits, so that a
pair at the threshold is missed with probability ``missed``; closer ones more rarely.
Vectors travel in single precision where that loses nothing.

Vectors that are null, zero, or hold null or non-finite numbers link with nothing, nor
do those with a null label; each is a component of its own.  Repeated rows are members
of one class.  An id with several vectors is one node, and each of its rows has the
links of its own vector.  A null id keeps its row, with a null component.  An empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import giving_back, materialize, partitions
from ._text import U, mix
from .components import connected_components

#: Share of pairs at the threshold whose signatures may differ in too many bits.
FAR = 1e-7


def _signs(x: np.ndarray, count: int) -> np.ndarray:
    """Signs of the products with ``count`` directions, which depend on the dimension only."""
    rng = np.random.default_rng([20240607, x.shape[1], count])
    return x @ rng.standard_normal((x.shape[1], count)) > 0


def shape_of(largest: int, least: float, missed: float) -> tuple[int, int]:
    """(tables, bits) for the largest label's classes."""
    bits = min(60, max(6, (max(1, largest) // 32).bit_length()))
    agree = (1 - np.arccos(np.clip(least, -1, 1)) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(missed) / np.log1p(-min(agree, 1 - 1e-12))))), bits


def most_apart(bits: int, least: float, far: float = FAR) -> int:
    """Bits in which signatures at the threshold differ at most, but for a share of ``far``."""
    p = float(np.arccos(np.clip(least, -1, 1)) / np.pi)
    beyond, k = 1.0, -1
    while beyond > far and k < bits:
        k += 1
        beyond -= comb(bits, k) * p**k * (1 - p) ** (bits - k)
    return k


def _packed(x: np.ndarray) -> bytes:
    small = x.astype(np.float32)
    return b"4" + small.tobytes() if (small == x).all() else b"8" + x.tobytes()


def _dim(raw: bytes) -> int:
    return (len(raw) - 1) // (raw[0] - 48)


def _matrix(raw: list[bytes]) -> np.ndarray:
    """Rows of doubles from packed vectors of one dimension."""
    if all(r[0] == 52 for r in raw):
        return np.frombuffer(b"".join(r[1:] for r in raw), np.float32).reshape(len(raw), -1).astype(float)
    return np.stack([np.frombuffer(r, np.float32 if r[0] == 52 else np.float64, offset=1).astype(float) for r in raw])


def _parts(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links."""
    m, out = len(near), []
    left = np.ones(m, bool)
    for i in range(m):
        if not left[i]:
            continue
        left[i] = False
        front = np.array([i])
        while len(front):
            new = np.flatnonzero(near[front].any(axis=0) & left)
            left[new] = False
            out += [(int(j), i) for j in new]
            front = new
    return out


def _grouped(rows: DataFrame, keys: list[str], judge, schema: str, names: list[str]) -> DataFrame:
    """``judge(key, columns)`` of each group of rows with equal keys; it gives rows."""
    n = max(2, partitions(rows.sparkSession))
    rows = rows.repartition(n, *keys).sortWithinPartitions(*keys)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, held = None, []

        def flush() -> None:
            if len(held) > 1:
                out.extend(judge(key, list(map(list, zip(*held)))))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:width] != key:
                    flush()
                    key, held = row[:width], []
                held.append(row[width:])
            yield made()
            out = []
        flush()
        yield made()

    return rows.mapInArrow(giving_back(run), schema)


def _signature(signs: np.ndarray) -> np.ndarray:
    """Signs as 64-bit words, filled up with zeros."""
    packed = np.packbits(signs, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(U)


def _candidates(rows: DataFrame, keys: list[str], apart: int) -> DataFrame:
    """Pairs (a spanning forest in each bucket) whose signatures differ in ``apart`` bits at most."""
    n = max(2, partitions(rows.sparkSession))
    rows = rows.repartition(n, *keys).sortWithinPartitions(*keys)

    def judged(bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray, rep: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, int]]:
        new = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))) if len(bucket) else np.zeros(0, int)
        size = np.diff(np.append(new, len(bucket)))
        for at, m in zip(new[size > 1].tolist(), size[size > 1].tolist()):
            x = sig[at : at + m]
            near = np.empty((m, m), bool)
            step = max(1, (1 << 20) // (m * x.shape[1]))  # a few MB at once
            for i in range(0, m, step):
                near[i : i + step] = np.bitwise_count(x[i : i + step, None] ^ x[None]).sum(axis=2, dtype=np.int64) <= apart
            np.fill_diagonal(near, False)
            if lo[at] != hi[at]:
                near &= own[at : at + m, None] != own[None, at : at + m]
            if near.any():
                ids = rep[at : at + m].tolist()
                yield from ((ids[i], ids[j]) for i, j in _parts(near) if ids[i] != ids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(columns: list[np.ndarray]) -> pa.RecordBatch:
            a, b = zip(*found) if (found := list(judged(*columns))) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:-1]]
            now.append(np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), U).reshape(batch.num_rows, -1))
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = np.ones(len(now[0]), bool)  # the last group may go on
            for c in now[:3]:
                last &= c == c[-1]
            cut = int(np.argmax(last))
            held = [c[cut:] for c in now]
            yield given([c[:cut] for c in now])
        if held is not None:
            yield given(held)

    return rows.mapInArrow(giving_back(run), "a long, b long")


def _blocked(rows: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, list[str]]:
    """Rows dealt to pairs of blocks (lo, hi) where a group has more than ``block`` of them;
    ``own`` is a row's block."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("m")).where(F.col("m") > block)
    large = materialize(large.select(*keys, F.ceil(F.col("m") / block).cast("int").alias("nb")), "large")
    if large.isEmpty():
        out = rows.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0)).withColumn("own", F.lit(0))
    else:
        out = rows.join(large, keys, "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        out = out.withColumn("own", F.pmod(F.xxhash64("rep", "alt"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        out = out.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("nb", "other")
    return out, [*keys, "lo", "hi"]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, tables: int | None = None, bits: int | None = None, block: int = 2048, missed: float = 1e-5) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                good = label is not None and v and None not in v
                x = np.array(v if good else [], float)
                raw.append(_packed(x) if good and np.isfinite(x).all() and x.any() else None)
            key = pa.array([None if r is None else hashlib.sha256(r).digest()[:16] for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), key, pa.array(raw, pa.binary())], ["id", "label", "key", "raw"])

    vectors = rows.mapInArrow(giving_back(clean), "id long, label string, key binary, raw binary")
    real = vectors.where("raw is not null and id is not null")
    classes = materialize(real.groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("raw").alias("raw")), "classes", large=True)
    # Classes that share their first id (its vectors differ) are told apart by ``alt``.
    of = F.struct("label", "key")
    several_of = materialize(real.groupBy("id").agg(F.min(of).alias("lo"), F.max(of).alias("hi")).where("lo <> hi").select("id"), "several")
    if several_of.isEmpty():
        classes = classes.withColumn("alt", F.lit(0).cast("long"))
    else:
        twice = several_of.select(F.col("id").alias("rep"))
        order = Window.partitionBy("rep").orderBy("label", "key")
        several = classes.join(twice, "rep", "left_semi").withColumn("alt", F.row_number().over(order).cast("long") - 1)
        single = classes.join(twice, "rep", "left_anti").withColumn("alt", F.lit(0).cast("long"))
        classes = materialize(single.unionByName(several), "classes", large=True)

    if bits is None:
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
        auto, bits = shape_of(largest, least, missed)
        tables = tables or auto
    tables = tables or 24
    apart = most_apart(tables * bits, least)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, label = batch.column("raw").to_pylist(), batch.column("label").to_pylist()
            by_kind: dict[tuple[str, int], list[int]] = {}
            for i, x in enumerate(raw):
                by_kind.setdefault((label[i], _dim(x)), []).append(i)
            for (name, width), own in by_kind.items():
                x = _matrix([raw[i] for i in own])
                signs = _signs(x / np.abs(x).max(axis=1, keepdims=True), tables * bits)
                codes = signs.reshape(len(own), tables, bits) @ (U(1) << np.arange(bits).astype(U))
                seed = int.from_bytes(hashlib.sha256(f"{width}:{name}".encode()).digest()[:8], "little")
                # Label, dimension, table and code as one number; two that collide share a bucket, which adds candidates only.
                bucket = mix(codes ^ mix(np.arange(tables).astype(U) + U(seed))[None, :])
                part, n = batch.take(pa.array(own)), len(own)
                at = pa.array(np.repeat(np.arange(n), tables))
                flat = pa.array([r.tobytes() for r in _signature(signs)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)), part.column("rep").take(at), part.column("alt").take(at), flat.take(at)], ["bucket", "rep", "alt", "sig"])

    dealt = classes.select("label", "rep", "alt", "raw").mapInArrow(giving_back(deal), "bucket long, rep long, alt long, sig binary")
    tiles, keys = _blocked(dealt, ["bucket"], block)

    pairs = _candidates(tiles.select(*keys, "own", "rep", "sig"), keys, apart)
    groups = connected_components(pairs)
    members = classes.join(groups.select(F.col("id").alias("rep"), F.col("component").alias("group")), "rep").select("group", "label", F.octet_length("raw").alias("width"), "rep", "alt", "size", "raw")
    tiles, keys = _blocked(members, ["group", "label", "width"], block)

    def judge(key: tuple, columns: list[list]) -> Iterator[tuple[int, int, int, int]]:
        own, rep, alt, size, raw = columns
        x = _matrix(raw)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        if key[3] != key[4]:
            near &= np.array(own)[:, None] != np.array(own)[None, :]
        sums = near @ np.array(size, float)
        for i in np.flatnonzero(sums):
            yield rep[i], alt[i], -1, int(sums[i])
        for i, j in _parts(near):
            yield rep[i], 0, rep[j], 0

    judged = materialize(_grouped(tiles.select(*keys, "own", "rep", "alt", "size", "raw"), keys, judge, "a long, alt long, b long, links long", ["a", "alt", "b", "links"]), "judged", large=True)
    links = judged.where("links = 0").select("a", "b")
    if not several_of.isEmpty():
        bound = real.join(several_of, "id", "left_semi").select("id", "label", "key").join(classes.select("label", "key", "rep"), ["label", "key"])
        links = links.union(bound.select("id", "rep"))
    parts = connected_components(links)
    sums = judged.where("links > 0").groupBy(F.col("a").alias("rep"), "alt").agg(F.sum("links").alias("links"))
    found = classes.select("label", "key", "rep", "alt", "size").join(sums, ["rep", "alt"], "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    found = materialize(found.select("label", "key", "rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "found")
    named = vectors.select("id", "label", "key").join(found, ["label", "key"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return named.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
