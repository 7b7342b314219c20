"""N-gram Jaccard join: all texts whose sets of word 5-grams have similarity >= 0.8.

Texts with equal sets form a class; only its smallest id goes on.  What could be linked
is found with a prefix filter: sets at similarity t share one of the first
n - ceil(t n) + 1 elements in any order that holds for all of them.  The order puts the
shingles last that are frequent over all documents, so passages that many documents share
do not bring these together.  All shingles of all documents are counted for that, by
their leading bits: every task sends its sorted ones as packed differences (some three
bytes each) to slices of the hash space, which count them.  The FREQUENT_MOST most
frequent ones are sent to all tasks; any order gives the same links.

* A rare shingle brings its documents together directly.  Such a pair goes on if its
  sizes, its places in the prefixes and then the two bitmap signatures allow enough
  overlap: bit i of a signature is the parity of the elements hashed to i, so two
  signatures differ in at most as many bits as the sets in elements.
* Documents that have a frequent shingle in their prefix consist mostly of frequent
  ones; all with the same one are put in one cluster.  So are those of a shingle that
  more than RUN_MOST prefixes hold, whether it is among the most frequent or not.

Pairs and clusters are closed to groups of candidates.  Each group is cut into tiles of
two neighbouring size bands (each 1.25 times the one before: further ones cannot reach
the threshold), large tiles into blocks of bounded rows and bytes (see ``_verified``).  In a tile, bit counts of
the signatures bound every overlap from above before the sorted arrays are intersected,
pairs that are connected already are passed over, and only a spanning forest leaves.

Elements are 64-bit hashes of shingles (two of the texts that are compared share one by
chance with probability n ** 2 / 2 ** 64), classes 128-bit hashes of sets.  A null or
empty text has no shingles and links with nothing.  A null id keeps its row with a null
component.  Rows that repeat an id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._packed import count_bits, sliced, slices_for, unpacked
from ._store import giving_back, materialize, partitions, small_batches
from ._text import U, Words, chunks, mix, run_hashes, window_hashes
from .components import connected_components

#: A shingle is frequent from so many documents on; the order knows the FREQUENT_MOST commonest.
FREQUENT_FROM, FREQUENT_MOST = 24, 1 << 20
#: From so many prefixes on, the documents of a shingle are a cluster and no pairs.
RUN_MOST = 64
#: Shingles that a task sorts and sends at once to be counted (8 MB).
SORTED_AT_ONCE = 1 << 20
#: Rows and bytes of a block of a tile.
BLOCK, BLOCK_BYTES = 256, 4 << 20


class Sets:
    """Sorted distinct shingle hashes of each text, one array for all."""

    def __init__(self, texts: pa.Array, size: int):
        w = Words(texts)
        h = w.hashes(lower=True)
        begin = w.windows(size)
        short = np.flatnonzero((w.counts > 0) & (w.counts < size))
        value = np.concatenate([window_hashes(h, begin, size), run_hashes(h, w.first[short], w.first[short + 1], 1)])
        doc = np.concatenate([w.doc[begin], short])
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        self.value, self.doc = value[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(w.counts) + 1))
        self.size = np.diff(self.first)

    def __getitem__(self, d: int) -> np.ndarray:
        return self.value[self.first[d] : self.first[d + 1]]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each set."""
        out = []
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            total = np.zeros(len(self.value) + 1, U)
            np.cumsum(mix(self.value ^ U(salt)), out=total[1:])
            out.append(mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(U)))
        return out[0], out[1]


def width_of(n: int) -> int:
    """Bits of the signature of a set: at least 64 and twice its elements."""
    return max(64, 1 << (2 * n - 1).bit_length())


def signature(elements: np.ndarray, width: int) -> np.ndarray:
    """Parity of the elements at each of ``width`` places, as 64-bit words."""
    bits = np.bincount((elements & U(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(U)


def fold(words: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_xor.reduce(words.reshape(-1, width // 64), axis=0)


def needed(a, b, percent: int):
    """Elements that sets of sizes a and b must share."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False)


def _summaries(texts: DataFrame, size: int, bits: int, slices: int) -> DataFrame:
    """Rows of documents (kind 0: n, digests, signature) and of packed shingles (kind 1:
    the slice as id)."""
    own = (slices - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "n", "s1", "s2", "bits"]
        open_, room = [], 0

        def sent() -> pa.RecordBatch:
            live, data = sliced(np.concatenate(open_) if open_ else np.zeros(0, U), bits, own)
            none = pa.nulls(len(live), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(live), np.int32)), pa.array(live.astype(np.int64)), none, none, none, pa.array(data, pa.binary())], names)

        for batch in batches:
            for part in chunks(batch, "text"):
                s = Sets(part.column(1), size)
                one, two = s.digests()
                marks = [signature(s[d], width_of(n)).tobytes() if n else b"" for d, n in enumerate(s.size.tolist())]
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), part.column(0), pa.array(s.size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(marks, pa.binary())], names)
                open_.append(s.value)
                room += len(s.value)
                if room >= SORTED_AT_ONCE:
                    yield sent()
                    open_, room = [], 0
        yield sent()

    return texts.mapInArrow(giving_back(run), "kind int, id long, n long, s1 long, s2 long, bits binary")


def _counted(summaries: DataFrame, bits: int, slices: int) -> DataFrame:
    """(value, n) of the leading bits of shingles that are in FREQUENT_FROM documents or more."""
    own = (slices - 1).bit_length()
    n = max(2, min(slices, partitions(summaries.sparkSession)))
    rows = summaries.where("kind = 1").select("id", "bits").repartition(n, "id").sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> pa.RecordBatch:
            value = np.sort(np.concatenate(held)) if held else np.zeros(0, U)
            edge = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
            count = np.diff(np.append(edge, len(value)))
            often = count >= FREQUENT_FROM
            found = value[edge[often]] | (U(current or 0) << U(bits - own))
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count[often])], ["value", "n"])

        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if piece != current:
                    yield done()
                    current, held = piece, []
                held.append(unpacked(data.as_py()))
        yield done()

    return rows.mapInArrow(giving_back(run), "value long, n long")


def _frequent(counts: DataFrame) -> np.ndarray:
    found = counts.orderBy(F.desc("n"), "value").limit(FREQUENT_MOST).select("value").toArrow()  # 8 MB at most
    return np.sort(found.column(0).to_numpy().view(U))


def _prefixes(texts: DataFrame, frequent: np.ndarray, bits: int, size: int, percent: int) -> DataFrame:
    """id, n, prefix and how many of its first elements are rare."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                s = Sets(part.column(1), size)
                hot = np.zeros(len(s.value), bool)
                if len(often):
                    value = s.value >> U(64 - bits)
                    at = np.minimum(np.searchsorted(often, value), len(often) - 1)
                    hot = often[at] == value
                order = np.lexsort((s.value, hot, s.doc))
                place = np.arange(len(order)) - s.first[s.doc]
                length = np.where(s.size > 0, prefix_length(s.size, percent), 0)
                inside = place < length[s.doc]
                chosen = order[inside]
                offsets = np.append(0, np.cumsum(length)).astype(np.int32)
                rare = np.bincount(s.doc[inside][~hot[chosen]], minlength=part.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.value[chosen].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.size.astype(np.int32)), lists, pa.array(rare.astype(np.int32))], ["id", "n", "prefix", "rare"])

    return texts.mapInArrow(giving_back(run), "id long, n int, prefix array<long>, rare int")


def _rare_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure) of documents with a rare shingle in both prefixes.

    Pairs whose sizes and places allow a link; and, not ``sure``, the first document of a
    shingle that more than RUN_MOST prefixes hold with each of the others.  No more than
    RUN_MOST rows of a shingle are held at a time.
    """
    n = max(2, partitions(entries.sparkSession))
    entries = entries.select("token", "id", "n", "at").repartition(n, "token").sortWithinPartitions("token", "n", "id")

    def pairs(token: np.ndarray, doc: np.ndarray, size: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for shift in range(1, RUN_MOST):  # each row with the one ``shift`` rows later in its run
            i = np.flatnonzero(token[shift:] == token[:-shift]) if shift < len(token) else ()
            if not len(i):
                return
            j = i + shift
            most = np.minimum(at[i], at[j]) + np.minimum(size[i] - at[i], size[j] - at[j])
            good = (size[i] * 100 >= size[j] * percent) & (most >= needed(size[i], size[j], percent)) & (doc[i] != doc[j])
            yield doc[i[good]], doc[j[good]]

    def made(columns: list[np.ndarray], whole: bool) -> tuple[list[np.ndarray], pa.RecordBatch]:
        """What must wait for more rows, and the links of the rest."""
        token, doc, size, at = columns
        edge = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        length = np.diff(np.append(edge, len(token)))
        run_of = np.repeat(np.arange(len(edge)), length)
        cut = len(token) if whole or not len(edge) else int(edge[-1])
        long = length > RUN_MOST
        star = np.flatnonzero(long[run_of] & (doc != doc[edge[run_of]])) if len(token) else edge
        a, b, sure = [doc[edge[run_of[star]]]], [doc[star]], [np.zeros(len(star), bool)]
        rows = np.flatnonzero((~long & (length > 1))[run_of] & (np.arange(len(token)) < cut)) if len(token) else edge
        for x, y in pairs(token[rows], doc[rows], size[rows], at[rows]):
            a.append(x), b.append(y), sure.append(np.ones(len(x), bool))
        one, two = np.concatenate(a), np.concatenate(b)
        links = np.unique(np.column_stack([np.minimum(one, two), np.maximum(one, two), np.concatenate(sure)]), axis=0)
        batch = pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1]), pa.array(links[:, 2] > 0)], ["a", "b", "sure"])
        # Of a long run that goes on its first rows are kept, so that it stays long.
        keep = [x[cut:][: RUN_MOST + 1] if len(edge) and long[-1] else x[cut:] for x in columns]
        return keep, batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held, out = made([np.concatenate(x) for x in zip(held, now)], False)
            yield out
        yield made(held, True)[1]

    return entries.mapInArrow(giving_back(run), "a long, b long, sure boolean").distinct()


def _bounded(pairs: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures allow enough overlap."""
    own = documents.select("id", "n", "bits")
    rows = pairs.join(own.toDF("a", "na", "xa"), "a").join(own.toDF("b", "nb", "xb"), "b").select("a", "b", "na", "nb", "xa", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            allowed = na + nb - 2 * needed(na, nb, percent)
            keep = []
            for x, y, most in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), allowed.tolist()):
                p, q = np.frombuffer(x, U), np.frombuffer(y, U)
                width = 64 * min(len(p), len(q))
                keep.append(int(np.bitwise_count(fold(p, width) ^ fold(q, width)).sum()) <= most)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(giving_back(run), "a long, b long")


def _frequent_links(entries: DataFrame) -> DataFrame:
    """Each document with the first one that has the same frequent shingle in its prefix."""
    first = entries.groupBy("token").agg(F.min("id").alias("b"))
    return entries.join(first, "token").select(F.col("id").alias("a"), "b").where("a <> b").distinct()


def tile_forest(ids: list[int], sets: list[np.ndarray], percent: int, parts: list[int] | None = None, asking: list[bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links in one tile.

    ``parts`` says what is connected already; with ``asking`` only pairs with one of
    these rows count.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    width = width_of(int(size[-1]))
    bits = np.stack([signature(s, width) for s in sets])
    part = np.arange(len(ids)) if parts is None else np.array([parts[i] for i in order])
    ask = None if asking is None else np.array([asking[i] for i in order])
    out = []
    for i in range(len(ids) - 1):
        end = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        j = np.arange(i + 1, end)
        j = j[part[j] != part[i]]
        if ask is not None and not ask[i]:
            j = j[ask[j]]
        if not len(j):
            continue
        need = needed(size[i], size[j], percent)
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        near = apart <= size[i] + size[j] - 2 * need
        for k, least in zip(j[near].tolist(), need[near].tolist()):
            if part[k] == part[i]:
                continue
            at = np.searchsorted(sets[k], sets[i])
            at[at == len(sets[k])] = 0
            if int((sets[k][at] == sets[i]).sum()) >= least:
                out.append((ids[i], ids[k]))
                old, new = max(part[i], part[k]), min(part[i], part[k])
                part[part == old] = new
    return out


def _tiles(rows: DataFrame, percent: int) -> DataFrame:
    """Links in each tile; rows are keys component, tile, lo, hi, then id, raw, part, asking."""
    keys = ["component", "tile", "lo", "hi"]
    n = max(2, partitions(rows.sparkSession))
    rows = rows.select(*keys, "id", "raw", "part", "asking").repartition(n, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            if len(held) > 1:
                ids, raw, part, asking = zip(*held)
                known = None if part[0] is None else list(part)
                out = tile_forest(list(ids), [np.frombuffer(r, U) for r in raw], percent, known, None if asking[0] is None else list(asking))
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != key:
                    yield done()
                    key, held = row[:4], []
                held.append(row[4:])
        yield done()

    return rows.mapInArrow(giving_back(run), "a long, b long")


def _verified(texts: DataFrame, groups: DataFrame, size: int, percent: int, block: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a spanning forest in each tile) among the documents of each group.

    A large tile is cut into blocks of about ``block`` rows and ``block_bytes`` at most.  Each block is joined in itself; then the smallest
    ids of what has come together meet, which connects most of a group of near copies;
    at last only the rows outside the largest part of a tile are sent to all its blocks,
    so a group that hangs together is never dealt out pair by pair.
    """
    members = texts.join(groups, "id").select("id", "text", "component")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.log(1.25)
        for batch in batches:
            for part in chunks(batch, "text"):
                s = Sets(part.column(1), size)
                band = np.floor(np.log(np.maximum(s.size, 1)) / step).astype(np.int32)
                raw = [s[d].tobytes() for d in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array(band), pa.array(raw, pa.binary())], ["component", "id", "band", "raw"])

    tile, none = ["component", "tile"], F.lit(None)
    made = materialize(members.mapInArrow(giving_back(sets), "component long, id long, band int, raw binary"), "sets", large=True)
    # The blocks that a number of rows of that many bytes needs.
    def blocks(count: Column, size: Column) -> Column:
        return F.greatest(F.ceil(count / block), F.ceil(size / block_bytes)).cast("int")

    counts = made.groupBy("component", "band").agg(F.count("*").alias("m"), F.sum(F.octet_length("raw")).alias("w"))
    held = counts.select("component", F.explode(F.array("band", F.col("band") - 1)).alias("tile"), "m", "w").groupBy(*tile).agg(F.sum("m").alias("m"), F.sum("w").alias("w")).where("m > 1")
    held = materialize(held.select(*tile, F.least("m", blocks(F.col("m"), F.col("w"))).cast("int").alias("nb")), "tiles")
    rows = made.withColumn("tile", F.explode(F.array("band", F.col("band") - 1))).drop("band")
    rows = rows.join(held, tile).withColumn("lo", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    open_ = [none.cast("long").alias("part"), none.cast("boolean").alias("asking")]
    links = _tiles(rows.select(*tile, "lo", F.col("lo").alias("hi"), "id", "raw", *open_), percent)
    if held.where("nb > 1").isEmpty():
        return links
    links = materialize(links, "inside")
    large = rows.where("nb > 1").drop("lo")

    def with_parts(links: DataFrame) -> DataFrame:
        parts = connected_components(links).withColumnRenamed("component", "part")
        return materialize(large.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "parts")

    # The first of each part, all with all in blocks.
    firsts = with_parts(links).groupBy(*tile, "part").agg(F.min_by(F.struct("id", "raw"), "id").alias("f")).select(*tile, "part", "f.*")
    firsts = materialize(firsts, "firsts")
    firsts = firsts.join(firsts.groupBy(*tile).agg(blocks(F.count("*"), F.sum(F.octet_length("raw"))).alias("nb")), tile)
    firsts = firsts.withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    links = materialize(links.union(_tiles(firsts.select(*tile, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "raw", "part", open_[1]), percent)), "firsts")
    # Rows outside the largest part ask all others.
    parted = with_parts(links)
    sizes = parted.groupBy(*tile, "part").agg(F.count("*").alias("m"), F.sum(F.octet_length("raw")).alias("w"))
    largest = F.struct("m", -F.col("part"))
    main = sizes.groupBy(*tile).agg(F.max_by("part", largest).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"), F.sum("w").alias("bytes"), F.max_by("w", largest).alias("own"))
    main = materialize(main.where("all > most").select(*tile, "main", blocks(F.col("all") - F.col("most"), F.col("bytes") - F.col("own")).alias("ask_nb")), "main")
    parted = parted.join(main, tile).withColumn("asking", F.col("part") != F.col("main"))
    parted = parted.withColumn("lo", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("hi", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("ask_nb")).cast("int"))
    # Tile (lo, hi): the rows of block lo, and the asking rows of their block hi.
    settled = parted.withColumn("hi", F.explode(F.sequence(F.lit(0), F.col("ask_nb") - 1)))
    asking = parted.where("asking").withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    columns = [*tile, "lo", "hi", "id", "raw", "part", "asking"]
    return links.union(_tiles(settled.select(*columns).union(asking.select(*columns)), percent))


def link_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_shingles and component_id (the smallest id reached)."""
    texts = small_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bits, slices = count_bits(texts), slices_for(texts)
    summaries = materialize(_summaries(texts, words, bits, slices), "summaries", large=True)
    documents = summaries.where("kind = 0").select("id", "n", "s1", "s2", "bits")
    classes = materialize(documents.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("id")).distinct()
    prefixes = _prefixes(texts.where("id is not null"), _frequent(_counted(summaries, bits, slices)), bits, words, percent).join(reps, "id", "left_semi")
    prefixes = materialize(prefixes, "prefixes", large=True)
    entries = prefixes.select("id", "n", "rare", F.posexplode("prefix").alias("at", "token"))
    rare = materialize(_rare_pairs(entries.where("at < rare"), percent), "rare", large=True)
    pairs = _bounded(rare.where("sure").select("a", "b"), documents.where("n > 0"), percent).union(rare.where("not sure").select("a", "b"))
    frequent = _frequent_links(prefixes.where("rare < size(prefix)").select("id", F.explode(F.slice("prefix", F.col("rare") + 1, F.size("prefix") - F.col("rare"))).alias("token")))
    groups = connected_components(pairs.union(frequent))
    links = _verified(texts.where("id is not null"), groups, words, percent, block)
    parts = connected_components(links)
    named = classes.join(parts, classes["rep"] == parts["id"], "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = documents.select("id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce(F.least("component", "id"), "id")).alias("component_id"))
