"""Merkle fingerprints of documents over phrases, paragraphs and sections.

Leaves are phrases of about four words; a phrase ends where the hash of its last word
says so or where its paragraph ends, so an edit moves no other boundary.  Paragraphs
are lines; a section ends at a blank line or where the hash of a paragraph says so.
Each level hashes its ordered children (128 bits a node), and the root is a SHA-256 of
the size and the ordered sections.  Equal roots mean equal texts, white space included.

A fingerprint is the whole tree in short: the root, a stroke, and for each section its
digest (64 bits), a colon and its paragraphs; for each paragraph its digest (32 bits), a
point and its leaves (24 bits each, in base 64).  Two fingerprints are compared from the
root down: equal sections and then equal paragraphs are taken as they are, and only the
branches that differ are entered, down to the leaves (``locate``).  Likeness is the share
of leaves in matched branches (twice the matched ones over all); it is 1 for equal roots
and below 1 for all others.

A null is an empty text.  Rows with the same id follow each other by a hash of their
texts (``xxhash64``), then by the texts; rows with a null id come last in the same order,
and the first row of all follows the very last one.  Repeated rows have equal
fingerprints.  An empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import giving_back, partitions, small_batches
from ._text import U, Words, chunks, mix, run_hashes, span_hashes

_EVERY_LEAF, _EVERY_SECTION = U(3), U(7)
#: Likeness of texts that differ in order or in short digests only.
_UNEQUAL = 0.9999


class Mark(NamedTuple):
    """A fingerprint taken apart; ``firsts`` are the first children of each node."""

    root: str
    sections: list[int]
    section_firsts: list[int]
    paragraphs: list[int]
    paragraph_firsts: list[int]
    leaves: list[int]


class Trees:
    """The levels of every row's tree as flat arrays, children before parents."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        n_docs, size = len(words.counts), len(words.buf)
        doc = words.doc
        line = np.flatnonzero(words.buf == 0x0A)
        closes = np.zeros(len(words.start), bool)
        if len(words.start):
            closes = (mix(words.hashes()) & _EVERY_LEAF) == 0
            next_start = np.append(words.start[1:], size)
            breaks = np.searchsorted(line, next_start) - np.searchsorted(line, words.end)
            last = np.append(doc[1:] != doc[:-1], True)
            ends_line = (breaks > 0) | last
            blank = breaks > 1
            closes |= ends_line
        # A leaf spans from its first word to the next leaf's; the first one of a text
        # also has what stands before it.
        opens = np.flatnonzero(np.append(True, closes[:-1])) if len(closes) else np.zeros(0, np.int64)
        leaf_doc = doc[opens]
        first = np.append(True, leaf_doc[1:] != leaf_doc[:-1]) if len(opens) else np.zeros(0, bool)
        begin = np.where(first, words.offsets[leaf_doc], words.start[opens]) if len(opens) else opens
        end = np.append(begin[1:], 0)
        final = np.append(first[1:], True) if len(opens) else first
        end = np.where(final, words.offsets[leaf_doc + 1], end) if len(opens) else end[:0]
        self.leaf = [span_hashes(words.buf, begin, end, lane) for lane in (0, 1)]
        self.leaf_begin, self.leaf_end = begin, end
        self.leaf_first = np.searchsorted(leaf_doc, np.arange(n_docs + 1))
        at_close = np.flatnonzero(closes)
        paragraph_end = np.flatnonzero(ends_line[at_close]) + 1 if len(at_close) else at_close
        self.paragraph, p_first = self._up(self.leaf, paragraph_end)
        self.paragraph_leaf = p_first
        p_doc = leaf_doc[p_first] if len(p_first) else leaf_doc[:0]
        p_last = np.append(p_doc[1:] != p_doc[:-1], True) if len(p_doc) else np.zeros(0, bool)
        p_blank = blank[at_close[paragraph_end - 1]] if len(p_doc) else p_last
        section_end = np.flatnonzero(((self.paragraph[0] & _EVERY_SECTION) == 0) | p_last | p_blank) + 1
        self.section, s_first = self._up(self.paragraph, section_end)
        self.section_paragraph = s_first
        s_doc = p_doc[s_first] if len(s_first) else p_doc[:0]
        self.section_first = np.searchsorted(s_doc, np.arange(n_docs + 1))
        self.words = words
        self._points: np.ndarray | None = None

    @staticmethod
    def _up(children: list[np.ndarray], ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        firsts = np.append(0, ends[:-1]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        return [run_hashes(children[lane], firsts, ends, lane) for lane in (0, 1)], firsts

    def mark(self, d: int) -> Mark:
        s0, s1 = int(self.section_first[d]), int(self.section_first[d + 1])
        size = int(self.words.offsets[d + 1] - self.words.offsets[d])
        if s0 == s1:  # no words: the bytes themselves
            raw = self.words.buf[self.words.offsets[d] : self.words.offsets[d + 1]].tobytes()
            return Mark(hashlib.sha256(b"%d:" % size + raw).hexdigest()[:32], [], [], [], [], [])
        top = b"".join(lane[s0:s1].tobytes() for lane in self.section)
        root = hashlib.sha256(b"%d:" % size + top).hexdigest()[:32]
        l0, l1 = int(self.leaf_first[d]), int(self.leaf_first[d + 1])
        p0 = int(self.section_paragraph[s0])
        p1 = int(np.searchsorted(self.paragraph_leaf, l1))
        return Mark(
            root, self.section[0][s0:s1].tolist(), (self.section_paragraph[s0:s1] - p0).tolist(), (self.paragraph[0][p0:p1] >> U(32)).tolist(),
            (self.paragraph_leaf[p0:p1] - l0).tolist(), (self.leaf[0][l0:l1] >> U(40)).tolist(),
        )

    def points(self, d: int, leaves: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Ranges of leaves of row d as ranges of its code points."""
        if self._points is None:
            self._points = np.append(0, np.cumsum((self.words.buf & 0xC0) != 0x80))
        zero, base = int(self._points[self.words.offsets[d]]), int(self.leaf_first[d])
        return [(int(self._points[self.leaf_begin[base + a]]) - zero, int(self._points[self.leaf_end[base + b - 1]]) - zero) for a, b in leaves]


def fingerprint(mark: Mark) -> str:
    data = np.array(mark.leaves, ">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes() if mark.leaves else b""
    leaves = base64.b64encode(data).decode()
    own, bound = [], [*mark.paragraph_firsts[1:], len(mark.leaves)]
    for digest, a, b in zip(mark.paragraphs, mark.paragraph_firsts, bound):
        own.append(f"{digest:08x}.{leaves[4 * a : 4 * b]}")
    bound = [*mark.section_firsts[1:], len(own)]
    return mark.root + "/" + ";".join(f"{digest:016x}:{','.join(own[a:b])}" for digest, a, b in zip(mark.sections, mark.section_firsts, bound))


def parse(value: str) -> Mark:
    root, _, rest = value.partition("/")
    out = Mark(root, [], [], [], [], [])
    for section in rest.split(";") if rest else []:
        digest, _, inner = section.partition(":")
        out.sections.append(int(digest, 16))
        out.section_firsts.append(len(out.paragraphs))
        for paragraph in inner.split(","):
            digest, _, leaves = paragraph.partition(".")
            out.paragraphs.append(int(digest, 16))
            out.paragraph_firsts.append(len(out.leaves))
            raw = np.frombuffer(base64.b64decode(leaves), np.uint8).reshape(-1, 3).astype(int)
            out.leaves.extend((raw @ [1 << 16, 1 << 8, 1]).tolist())
    return out


def _unmatched(one: list[int], two: list[int], of_one: list[int], of_two: list[int]) -> tuple[list[int], list[int]]:
    """The nodes of each side, among the given ones, that the other side has no copy of."""
    x, y = Counter([one[i] for i in of_one]), Counter([two[i] for i in of_two])
    both = x & y
    if not both:
        return of_one, of_two
    out = []
    for side, nodes in ((one, of_one), (two, of_two)):
        left, rest = Counter(both), []
        for i in nodes:
            if left[side[i]] > 0:
                left[side[i]] -= 1
            else:
                rest.append(i)
        out.append(rest)
    return out[0], out[1]


def _children(nodes: list[int], firsts: list[int], total: int) -> list[int]:
    return [k for i in nodes for k in range(firsts[i], firsts[i + 1] if i + 1 < len(firsts) else total)]


def differing(a: Mark, b: Mark) -> tuple[list[int], list[int]]:
    """The leaves of each side in branches that the other one does not have."""
    if a.root == b.root:
        return [], []
    x, y = list(range(len(a.sections))), list(range(len(b.sections)))
    x, y = _unmatched(a.sections, b.sections, x, y)
    x, y = _children(x, a.section_firsts, len(a.paragraphs)), _children(y, b.section_firsts, len(b.paragraphs))
    x, y = _unmatched(a.paragraphs, b.paragraphs, x, y)
    x, y = _children(x, a.paragraph_firsts, len(a.leaves)), _children(y, b.paragraph_firsts, len(b.leaves))
    return _unmatched(a.leaves, b.leaves, x, y)


def _likeness(a: Mark, b: Mark, differ: tuple[list[int], list[int]]) -> float:
    if a.root == b.root:
        return 1.0
    total = len(a.leaves) + len(b.leaves)
    return min(_UNEQUAL, 1 - (len(differ[0]) + len(differ[1])) / total) if total else 0.0


def likeness(a: str, b: str) -> float:
    one, two = parse(a), parse(b)
    return _likeness(one, two, differing(one, two))


def _ranges(leaves: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i in leaves:
        if out and out[-1][1] == i:
            out[-1] = (out[-1][0], i + 1)
        else:
            out.append((i, i + 1))
    return out


def locate(one: str, two: str) -> list[tuple[int, int]]:
    """Ranges of leaves of the second fingerprint that the first one does not have."""
    return _ranges(differing(parse(one), parse(two))[1])


def spans_of(text: str, leaves: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of ranges of leaves, as ``locate`` gives them."""
    return Trees(pa.array([text])).points(0, leaves)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text: id and fingerprint; no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                t = Trees(part.column(1))
                out = [fingerprint(t.mark(d)) for d in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], [id_col, "fingerprint"])

    return small_batches(df).select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(giving_back(run), f"`{id_col}` {kind}, fingerprint string")


def _at_or_above(key: Column, bounds: list[int]) -> tuple[list[tuple[str, Column]], Column]:
    """How many of the descending bounds are at or above the key: steps of a binary search."""
    size = 1
    while size <= len(bounds):
        size *= 2
    table = F.array(*[F.lit(b).cast("long") for b in bounds + [None] * (size - len(bounds))])
    steps, at, step, k = [], F.lit(0), size // 2, 0
    while step:
        probe = at + F.lit(step)
        steps.append((f"__p{k}", F.when(F.coalesce(F.element_at(table, probe) >= key, F.lit(False)), probe).otherwise(at)))
        at, step, k = F.col(f"__p{k}"), step // 2, k + 1
    return steps, at


def _pieces(rows: DataFrame, pieces: int) -> DataFrame:
    """Rows with their piece: ranges of (id descending, hash), nulls last.

    Bounds are quantiles of the ids.  An id that holds several quantiles, and the rows
    without id, are cut further by the hashes of their texts.
    """
    cuts = [i / pieces for i in range(1, pieces)]
    key, h = F.col("__id"), F.col("__h")
    stat = rows.agg(F.max("__id").alias("top"), F.percentile_approx("__id", cuts, 100 * pieces).alias("cuts"), F.count("*").alias("n"), F.count("__id").alias("named")).first()
    found = Counter((stat["cuts"] or []) + ([stat["top"]] if stat["top"] is not None else []))
    bounds = sorted(found, reverse=True)
    # Piece p holds the ids that are at or below exactly p bounds; a bound that is hot has room for more.
    room = [found[b] for b in bounds] + [1 + pieces * (stat["n"] - stat["named"]) // max(1, stat["n"])]
    begin = np.append(0, np.cumsum(room)).tolist()
    steps, at = _at_or_above(key, bounds)
    for name, column in steps:
        rows = rows.withColumn(name, column)
    at = F.when(key.isNull(), F.lit(len(bounds) + 1)).otherwise(at)
    wide = F.element_at(F.array(*[F.lit(r) for r in room]), at)
    edge = F.element_at(F.array(*[F.lit(b).cast("long") for b in [*bounds, None]]), at)
    by_hash = F.least(wide - 1, F.floor((F.shiftright(h, 32) + F.lit(1 << 31)) * wide / F.lit(float(1 << 32)))).cast("int")
    part = F.when(key.isNull() | (key == edge), by_hash).otherwise(wide - 1)
    return rows.withColumn("__p", (F.element_at(F.array(*[F.lit(b) for b in begin]), at) + part).cast("int")).select("__p", "__id", "__h", "__text")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document.

    The next document is the one with the next smaller id, and the largest after the
    smallest.  The last third of the code points is replaced by the first as many of
    the next text; ``edited_ranges`` are the code points of the edited text in leaves
    that the fingerprint of the text does not have ("start:end", comma-joined).

    The rows are cut into ``pieces`` ranges; each is sorted, and the first row of the
    range that follows is dealt to it as a guest, so the texts are shuffled once and no
    row waits for another task.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = small_batches(df).select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__h"), text.alias("__text"))
    rows = _pieces(rows, pieces or max(2, 2 * partitions(spark)))
    # The first row of each piece (some numbers for each): the guest of the piece before.
    place = F.struct(F.col("__id").isNull().alias("none"), (-F.col("__id")).alias("down"), "__h", F.col("__id").alias("id"))
    firsts = sorted((r["__p"], r["f"]["id"], r["f"]["__h"]) for r in rows.groupBy("__p").agg(F.min(place).alias("f")).collect())
    at = F.col("__p")
    before = {p: firsts[k - 1][0] for k, (p, _, _) in enumerate(firsts)}
    size = max(before, default=-1) + 1
    table = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), at + 1)
    known = {p: (i, h) for p, i, h in firsts}
    if firsts:
        one = table([known.get(p, (None, None))[0] for p in range(size)], "long")
        two = table([known.get(p, (None, None))[1] for p in range(size)], "long")
        first = one.eqNullSafe(F.col("__id")) & (two == F.col("__h"))
        home = F.struct(at.alias("p"), F.lit(False).alias("guest"))
        guest = F.struct(table([before.get(p) for p in range(size)], "int").alias("p"), F.lit(True).alias("guest"))
        where = F.when(first, F.array(home, guest)).otherwise(F.array(home))
    else:
        where = F.array(F.struct(at.alias("p"), F.lit(False).alias("guest")))
    dealt = rows.select("__id", "__h", "__text", F.explode(where).alias("__at")).select(F.col("__at.p").alias("__p"), F.col("__at.guest").alias("__guest"), "__id", "__text", "__h")
    spread = dealt.repartitionByRange(max(2, len(firsts)), "__p")
    ordered = spread.sortWithinPartitions("__p", F.asc("__guest"), F.desc_nulls_last("__id"), "__h", "__text").drop("__h")

    schema = "__id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_ranges string"

    def finish(pending: list[tuple[int | None, str, str]]) -> Iterator[pa.RecordBatch]:
        """Rows as (id, text, next text)."""
        begin = 0
        while begin < len(pending):
            end, room = begin, 0
            while end < len(pending) and (end == begin or room < 1 << 20):
                room += len(pending[end][1])
                end += 1
            own = pending[begin:end]
            edited = []
            for _, text, after in own:
                k = len(text) // 3
                edited.append(text[: len(text) - k] + after[:k] if k else text)
            data = [e.encode() for e in edited]
            following = own[-1][2]
            chained = all(own[i][2] is own[i + 1][1] for i in range(len(own) - 1))
            after = [following] if chained else [x[2] for x in own]
            trees = Trees(pa.array([x[1] for x in own] + edited + after, pa.large_string()))
            m = len(own)
            marks = [trees.mark(i) for i in range(2 * m + len(after))]
            columns: list[list] = [[] for _ in range(8)]
            for i, (doc, text, _) in enumerate(own):
                after_mark = marks[2 * m + (0 if chained else i)] if not chained or i == m - 1 else marks[i + 1]
                edit, next_ = differing(marks[i], marks[m + i]), differing(marks[i], after_mark)
                ranges = ",".join(f"{s}:{e}" for s, e in trees.points(m + i, _ranges(edit[1])))
                values = (doc, len(text), hashlib.sha256(data[i]).hexdigest(), fingerprint(marks[i]), fingerprint(marks[m + i]), _likeness(marks[i], marks[m + i], edit), _likeness(marks[i], after_mark, next_), ranges)
                for c, v in zip(columns, values):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
            names = ["__id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_ranges"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece: int | None = None
        held: tuple[int | None, str] | None = None  # the last row, until its next is seen
        guested = False
        for whole in batches:
            for batch in chunks(whole, "__text"):
                ready: list[tuple[int | None, str, str]] = []
                for p, guest, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if p != piece:
                        if held is not None:
                            ready.append((*held, held[1]))
                        piece, held, guested = p, None, False
                    if guest and guested:
                        continue
                    if held is not None:
                        ready.append((*held, text))
                    held, guested = (None if guest else (doc, text)), guest
                yield from finish(ready)
        if held is not None:
            yield from finish([(*held, held[1])])

    return ordered.mapInArrow(giving_back(run), schema).withColumnRenamed("__id", id_col)
