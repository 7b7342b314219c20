"""Quality by co-training: two classifiers teach each other, then judge together.

One view is the content of a text (which characters and words it is made of, how they
repeat), the other its metadata (source, language, size and layout of lines).  Each has
a logistic classifier.  In every round each view labels the unlabelled documents of
which it is most sure, as many of each class as the labels' shares say, for the other
view to learn from.  Both are then calibrated on a held-out fifth of the labels, and a
logistic combination of the two calibrated scores, fitted there too, scores all
documents.

Fitting uses at most ``labelled`` labelled documents, and pseudo-labels from a random
``pool`` of others (both those with the smallest hashes of their ids), as the method
does: the surest documents of all would be the least telling ones.  Every document is
scored.  An id teaches once.  Labels are joined by
id; where an id has several, their mean decides, and a tie is good.  Without labels of
both classes every score is 1.  A null text is an empty one; null sources and
languages are values of their own.  Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import giving_back, small_batches
from ._text import U, Words, chunks, mix

_CLASS = np.full(256, 7, np.int64)  # other signs
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".,;:'()-", b"!?", None, b"|")):
    if _chars:
        _CLASS[list(_chars)] = _k
_CLASS[128:] = 9
_CLASSES = 10
HASHED = 24


def _one_hot(values: list[str | None], size: int, seed: int) -> np.ndarray:
    out = np.zeros((len(values), size))
    cache: dict[str | None, int] = {}
    for i, v in enumerate(values):
        if v not in cache:
            h = U(seed)
            for b in (v or "\0").encode():
                h = mix(np.array([int(h) ^ b], U))[0]
            cache[v] = int(h % U(size))
        out[i, cache[v]] = 1.0
    return out


def features(texts: pa.Array, source: list[str | None], lang: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The two views of each row: content and metadata."""
    w = Words(texts)
    n, size = len(w.counts), np.diff(w.offsets)
    safe = np.maximum(size, 1)[:, None]
    kind = _CLASS[w.buf]
    row = np.repeat(np.arange(n), size)
    share = np.bincount(row * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES) / safe
    h = w.hashes(lower=True)
    doc, words = w.doc, np.maximum(w.counts, 1)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[: len(mask)][mask], minlength=n) / words

    same = doc[1:] == doc[:-1]
    twice = per_doc((h[1:] == h[:-1]) & same) if len(h) > 1 else np.zeros(n)
    order = np.lexsort((h, doc))
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    repeated = np.bincount(doc[order][1:][again], minlength=n) / words if len(h) > 1 else np.zeros(n)
    final = w.buf[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    closing = kind[w.end - 1] if len(h) else np.zeros(0, np.int64)
    odd = per_doc((closing == 7) | (closing == 8) | (final == 0x21))
    shout = per_doc((kind[w.start] == 1) & (kind[np.minimum(w.start + 1, w.end - 1)] == 1) & (w.end - w.start > 1)) if len(h) else np.zeros(n)
    alone = per_doc((w.end - w.start == 1) & (closing >= 5)) if len(h) else np.zeros(n)
    length = np.bincount(doc, w.end - w.start, n) / words
    content = np.column_stack([np.sqrt(share), share, twice, repeated * np.sqrt(100 / (100 + words)), odd, shout, alone, np.sqrt(odd), np.sqrt(shout), np.sqrt(alone), np.sqrt(twice), length / 8])
    # Metadata: who, which language, how long, how the lines are laid out.
    line = np.flatnonzero(w.buf == 0x0A)
    line_doc = row[line]
    lines = np.bincount(line_doc, minlength=n) + 1
    before = w.buf[np.maximum(line - 1, 0)]
    closed = np.bincount(line_doc[np.isin(before, (0x2E, 0x21, 0x3F))], minlength=n)
    ends = np.where(size > 0, w.buf[np.maximum(w.offsets[1:] - 1, 0)] if len(w.buf) else 0, 0)
    closed = (closed + (ends == 0x2E)) / lines
    start = np.where(size > 0, kind[np.minimum(w.offsets[:-1], max(0, len(kind) - 1))] if len(kind) else 0, 0)
    meta = np.column_stack([np.log1p(size) / 5, np.log1p(lines), np.log1p(size / lines) / 3, closed, ends == 0x2E, ends == 0x21, start == 1, start == 0, words / np.maximum(size, 1) * 5, _one_hot(source, HASHED, 3), _one_hot(lang, 8, 5)]).astype(float)
    return content, meta


class Logistic:
    """Logistic regression with a ridge, by Newton steps on standardised features."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-9] = 1.0
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        weight = np.ones(len(x)) if weight is None else weight
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        b = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            slope = z.T @ (weight * (y - p)) - penalty * b
            curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            b = b + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        self.b = b
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.b[0] + ((x - self.mean) / self.scale) @ self.b[1:], -30, 30)


class CoTrained:
    """Two views and their combination."""

    def __init__(self, content: np.ndarray, meta: np.ndarray, good: np.ndarray, more_content: np.ndarray, more_meta: np.ndarray, rounds: int = 5, each: float = 0.05):
        self.views: list[Logistic] = []
        if len(set(good.tolist())) < 2:
            return
        held = np.arange(len(good)) % 5 == 0
        if len(set(good[held].tolist())) < 2 or len(set(good[~held].tolist())) < 2:
            held = np.zeros(len(good), bool)
        fit, test = ~held, held if held.any() else ~held
        x = [content[fit], meta[fit]]
        pool = [more_content, more_meta]
        taught: list[dict[int, float]] = [{}, {}]
        y, share = good[fit].astype(float), float(good[fit].mean())

        def learn(v: int) -> Logistic:
            rows = np.array(sorted(taught[v]), int)
            labels = np.array([taught[v][i] for i in rows])
            return Logistic().fit(np.concatenate([x[v], pool[v][rows]]), np.concatenate([y, labels]), np.concatenate([np.ones(len(y)), np.full(len(rows), 0.5)]))

        views = [learn(0), learn(1)]
        for _ in range(rounds if len(more_content) else 0):
            count = each * len(more_content)
            for v in (0, 1):
                odds = views[v].odds(pool[v])
                best = np.argsort(-odds, kind="stable")
                sure = [i for i in best[: max(1, round(count * share))] if odds[i] > 2]
                bad = [i for i in best[::-1][: max(1, round(count * (1 - share)))] if odds[i] < -2]
                # A label that the other view was given already stays.
                for rows, label in ((sure, 1.0), (bad, 0.0)):
                    for i in rows:
                        taught[1 - v].setdefault(int(i), label)
            views = [learn(0), learn(1)]
        self.views = views
        held_good = good[test].astype(float)
        odds = np.column_stack([views[0].odds(content[test]), views[1].odds(meta[test])])
        self.calibrated = [Logistic().fit(odds[:, [v]], held_good) for v in (0, 1)]
        both = np.column_stack([c.odds(odds[:, [v]]) for v, c in enumerate(self.calibrated)])
        self.joint = Logistic().fit(both, held_good, ridge=0.1)

    def scores(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Probability of good quality by content, by metadata, and by both."""
        if not self.views:
            return np.ones((len(content), 3))
        both = np.column_stack([self.calibrated[0].odds(self.views[0].odds(content)[:, None]), self.calibrated[1].odds(self.views[1].odds(meta)[:, None])])
        odds = np.column_stack([both, self.joint.odds(both)])
        return 1 / (1 + np.exp(-odds))


def _view_rows(df: DataFrame, ids: DataFrame, text_col: str) -> list[tuple]:
    """Features of one row of each of these ids, of which there are few.

    Of rows that repeat an id the one with the smallest hash of its text counts, so what
    goes to the driver is bounded by the number of ids.
    """
    text = F.col(text_col).cast("string")
    rows = df.select(F.col("doc_id").alias("__id"), text.alias("__text"), F.col("source").cast("string").alias("__source"), F.col("lang").cast("string").alias("__lang"), F.xxhash64(text, "source", "lang").alias("__hash"))
    rows = rows.join(F.broadcast(ids), F.col("__id") == F.col("__want")).select("__id", "__text", "__source", "__lang", "good", "__hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                a, b = features(part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(4), pa.array(list(a), pa.list_(pa.float64())), pa.array(list(b), pa.list_(pa.float64())), part.column(5)], ["id", "good", "content", "meta", "hash"])

    made = rows.mapInArrow(giving_back(run), "id long, good int, content array<double>, meta array<double>, hash long")
    one = made.groupBy("id").agg(F.min_by(F.struct("good", "content", "meta"), F.struct("hash", "content", "meta")).alias("r"))
    return sorted(map(tuple, one.select("id", "r.good", "r.content", "r.meta").collect()), key=lambda r: r[0])


def train(df: DataFrame, labels: DataFrame, text_col: str = "text", labelled: int = 6000, pool: int = 6000, rounds: int = 5) -> CoTrained:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    order = [F.xxhash64(F.lit(5), "doc_id"), F.col("doc_id")]
    own = known.orderBy(*order).limit(labelled).select(F.col("doc_id").alias("__want"), "good")
    others = df.select("doc_id").where("doc_id is not null").distinct().orderBy(*order).limit(pool).select(F.col("doc_id").alias("__want"), F.lit(None).cast("int").alias("good"))
    taught = _view_rows(df, own, text_col)
    seen = {r[0] for r in taught}
    more = [r for r in _view_rows(df, others, text_col) if r[0] not in seen]

    def matrix(rows: list[tuple], k: int, width: int) -> np.ndarray:
        return np.array([r[k] for r in rows], float).reshape(len(rows), width)

    a, b = features(pa.array([""]), [None], [None])
    widths = a.shape[1], b.shape[1]
    return CoTrained(matrix(taught, 2, widths[0]), matrix(taught, 3, widths[1]), np.array([r[1] for r in taught], int), matrix(more, 2, widths[0]), matrix(more, 3, widths[1]), rounds)


def classify(df: DataFrame, labels: DataFrame, text_col: str = "text", least: float = 0.5, labelled: int = 6000, pool: int = 6000, rounds: int = 5, only_kept: bool = False) -> DataFrame:
    """doc_id, content_score, meta_score, score and keep of each row.

    With ``only_kept`` the kept rows, all columns of ``df`` as they are.
    """
    shared = df.sparkSession.sparkContext.broadcast(train(small_batches(df), labels, text_col, labelled, pool, rounds))
    rows = df if only_kept else df.select("doc_id", text_col, "source", "lang")
    kind = df.schema["doc_id"].dataType.simpleString()
    at = [rows.columns.index(c) for c in ("doc_id", text_col, "source", "lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names = batch.schema.names
            for part in chunks(batch, names[at[1]]):
                score = model.scores(*features(part.column(at[1]), part.column(at[2]).cast(pa.string()).to_pylist(), part.column(at[3]).cast(pa.string()).to_pylist()))
                keep = pa.array(score[:, 2] >= least)
                if only_kept:
                    yield part.filter(keep)
                else:
                    yield pa.RecordBatch.from_arrays([part.column(at[0]), *(pa.array(score[:, k]) for k in range(3)), keep], ["doc_id", "content_score", "meta_score", "score", "keep"])

    return rows.mapInArrow(giving_back(run), df.schema if only_kept else f"doc_id {kind}, content_score double, meta_score double, score double, keep boolean")
