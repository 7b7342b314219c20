"""Exact repeats of long passages: fixed-block anchors, probed by every rolling window.

Every text is cut into non-overlapping reference blocks of half a window (25 of 50
words); whatever 50 words two documents share, those of one hold a whole block of the
other.  All blocks are indexed, and every rolling window of 25 words of every text probes
the index.  The index is dealt to slices of the hash space, to which the tasks send their
sorted hashes as packed differences (some three bytes for each word of text), so it grows
with the input and needs no memory for all of it; a block that two documents hold is an
anchor.  Around each anchor the hits are extended: all windows of 50 words that hold it
are compared by two independent hashes of 64 bits, and one that also starts in a document
with a smaller id is a repeat.  Repeats that overlap or touch are joined to maximal ones,
and their words go.

Anchors (not all blocks) are put into a bit filter of at most 2 ** ``filter_bits`` bits
that is sent to all tasks; if it is too small for them, more windows are compared and no
result changes.  The windows around the COMMON_MOST most common anchors, which may be in
a third of all documents, are compared apart from the others: by sums in each task.

A null text has no words.  Rows with a null id keep all words.  Rows that repeat an
id, with one text or several, lose no words to each other.  An empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import filters
from ._packed import count_bits, sliced, slices_for, unpacked
from ._store import giving_back, materialize, partitions, release, small_batches
from ._text import U, Words, chunks, window_hashes

#: An anchor is common from so many documents on, if it is among the COMMON_MOST most common.
COMMON_FROM, COMMON_MOST = 32, 1 << 20
#: Hashes that a task sorts and sends at once (8 MB).
SORTED_AT_ONCE = 1 << 20
#: Rows (20 bytes each) that are sent to all executors at most.
BROADCAST_MOST = 1 << 20


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.hash(F.col(text_col).cast("string")).alias("sign"))


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def anchors(texts: DataFrame, size: int) -> DataFrame:
    """(h, n) of the reference blocks that n >= 2 documents hold: their leading bits.

    A document's windows count once, however often it repeats them.
    """
    bits, slices = count_bits(texts), slices_for(texts)
    own = (slices - 1).bit_length()

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        room = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for kind, values in enumerate(held):
                live, data = sliced(np.concatenate([np.zeros(0, U), *values]), bits, own)
                yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(np.full(len(live), kind, np.int32)), pa.array(data, pa.binary())], ["slice", "kind", "data"])
                values.clear()

        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column(1))
                begin = w.windows(size)
                begin = begin[np.repeat(w.counts, w.counts)[begin] >= 2 * size]  # a shorter text has no window
                h, doc = window_hashes(w.hashes(), begin, size), w.doc[begin]
                held[1].append(h[(begin - w.first[doc]) % size == 0])
                order = np.argsort(h, kind="stable")  # rows of a document stay together
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                held[0].append(h[new])
                room += int(new.sum())
                if room >= SORTED_AT_ONCE:
                    yield from sent()
                    room = 0
        yield from sent()

    n = max(2, min(slices, partitions(texts.sparkSession)))
    rows = texts.where("id is not null").mapInArrow(giving_back(probes), "slice long, kind int, data binary")
    rows = rows.repartition(n, "slice").sortWithinPartitions("slice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        held: list[list[np.ndarray]] = [[], []]

        def done() -> pa.RecordBatch:
            windows, blocks = (np.sort(np.concatenate([np.zeros(0, U), *x])) for x in held)
            edge = np.flatnonzero(np.append(True, windows[1:] != windows[:-1])) if len(windows) else np.zeros(0, np.int64)
            count = np.diff(np.append(edge, len(windows)))
            value, count = windows[edge[count > 1]], count[count > 1]
            at = np.minimum(np.searchsorted(blocks, value), max(0, len(blocks) - 1))
            known = blocks[at] == value if len(blocks) else np.zeros(len(value), bool)
            whole = (value[known] | (U(current or 0) << U(bits - own))) << U(64 - bits)
            return pa.RecordBatch.from_arrays([_signed(whole), pa.array(count[known])], ["h", "n"])

        for batch in batches:
            for piece, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if piece != current:
                    yield done()
                    current, held = piece, [[], []]
                held[kind].append(unpacked(data.as_py()))
        yield done()

    return rows.mapInArrow(giving_back(run), "h long, n long")


def repeated_windows(texts: DataFrame, window: int, filter_bits: int) -> DataFrame:
    """(gid, gone): by id, where windows begin that also start in a smaller one.

    A place has the hash of its row's text above its 32 low bits, so that different texts
    with one id are kept apart.
    """
    size, bits = window // 2, count_bits(texts)
    spark = texts.sparkSession
    index = materialize(anchors(texts, size), "anchors", large=True)
    shared = spark.sparkContext.broadcast(filters.build(index, filters.size_for(index.count(), filter_bits))[0])
    often = index.where(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "h").limit(COMMON_MOST).select("h").toArrow()  # 8 MB at most
    common = spark.sparkContext.broadcast(np.sort(often.column(0).to_numpy().view(U)))
    release(index)

    def windows_of(popular: bool):
        """Windows of 50 words that hold an anchor: popular ones (with a common anchor) or the others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often = common.value
            for batch in batches:
                for part in chunks(batch, "text"):
                    w = Words(part.column(1))
                    h = w.hashes()
                    begin = w.windows(size)
                    probe = window_hashes(h, begin, size) >> U(64 - bits) << U(64 - bits)
                    hit = shared.value.test(probe)
                    begin, probe = begin[hit], probe[hit]

                    def any_inside(at: np.ndarray, windows: np.ndarray) -> np.ndarray:
                        total = np.zeros(len(w.start) + 1, np.int64)
                        total[at + 1] = 1
                        np.cumsum(total, out=total)
                        return total[windows + window - size + 1] > total[windows]

                    whole = w.windows(window)
                    whole = whole[any_inside(begin, whole)]
                    # By its words alone: both sides of a pair come to the same comparison.
                    hot = np.zeros(len(whole), bool)
                    if len(often):
                        place = np.minimum(np.searchsorted(often, probe), len(often) - 1)
                        hot = any_inside(begin[often[place] == probe], whole)
                    whole = whole[hot == popular]
                    doc, sign = w.doc[whole], part.column(2).to_numpy().astype(np.int64)
                    one = window_hashes(h, whole, window)
                    two = window_hashes(w.hashes(lane=1), whole, window, 1) if len(whole) else one
                    yield pa.RecordBatch.from_arrays([_signed(one), _signed(two), part.column(0).take(pa.array(doc)), pa.array(sign[doc] << np.int64(32) | (whole - w.first[doc]))], ["h", "h2", "id", "at"])

        return texts.where("id is not null").mapInArrow(giving_back(run), "h long, h2 long, id long, at long")

    # A window without a common anchor is in fewer documents than the last common one.
    key = Window.partitionBy("h", "h2")
    later = windows_of(False).withColumn("low", F.min("id").over(key)).where("id > low").select("id", "at")
    if len(common.value):
        hot = materialize(windows_of(True), "popular", large=True)
        first = materialize(hot.groupBy("h", "h2").agg(F.min("id").alias("low")), "first")
        first = F.broadcast(first) if first.count() <= BROADCAST_MOST else first
        later = later.union(hot.join(first, ["h", "h2"]).where("id > low").select("id", "at"))
    return materialize(later.groupBy(F.col("id").alias("gid")).agg(F.collect_set("at").alias("gone")), "gone", large=True)


def _pruned(df: DataFrame, id_col: str, text_col: str, window: int, filter_bits: int, schema: str, result) -> DataFrame:
    texts = _texts(df, id_col, text_col)
    gone = repeated_windows(texts, window, filter_bits)
    rows = texts.join(gone, texts["id"] == gone["gid"], "left").select("id", "text", "sign", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column(1))
                raw = w.buf.tobytes()
                sign = part.column(2).to_numpy().astype(np.int64)
                out = []
                for d, gone in enumerate(part.column(3).to_pylist()):
                    lo, hi = int(w.first[d]), int(w.first[d + 1])
                    keep, repeats = np.ones(hi - lo, bool), ""
                    if gone:
                        starts = np.sort(np.array(gone, np.int64))
                        starts = starts[starts >> 32 == sign[d]] & 0xFFFFFFFF
                        edge = np.zeros(hi - lo + 1, np.int64)
                        edge[starts] += 1
                        edge[starts + window] -= 1
                        keep = np.cumsum(edge)[:-1] == 0
                        turn = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=1, append=1))
                        repeats = ",".join(f"{s}:{e}" for s, e in turn.reshape(-1, 2).tolist())
                    left = [raw[s:e] for s, e in zip(w.start[lo:hi][keep].tolist(), w.end[lo:hi][keep].tolist())]
                    out.append((*result(hi - lo, len(left), b" ".join(left)), repeats))
                columns = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], [id_col, "n_words", "n_removed", schema, "repeats"])

    return rows.mapInArrow(giving_back(run), f"`{id_col}` long, n_words long, n_removed long, {schema} string, repeats string")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, filter_bits: int = 30) -> DataFrame:
    """id, n_words, n_removed, kept_text (the words that stay, joined by one space) and repeats
    (the maximal ranges of removed words, "start:end", comma-joined)."""
    return _pruned(df, id_col, text_col, window, filter_bits, "kept_text", lambda n, k, raw: (n, n - k, raw.decode()))


def dedup_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, filter_bits: int = 30) -> DataFrame:
    """As ``dedup`` with the SHA-256 of the kept text instead of the text."""
    return _pruned(df, id_col, text_col, window, filter_bits, "kept_sha256", lambda n, k, raw: (n, n - k, hashlib.sha256(raw).hexdigest()))
