"""Personal data by fixed rules and a skip-chain conditional random field.

The rules find e-mail addresses, IP addresses, card and phone numbers in whole texts.
The field then labels tokens that the rules left open.  Its nodes are the tokens that
hold a digit or an at sign; chain factors join neighbours, skip factors join each token
to the next one with the same or a similar key (its letters and digits without marks;
for numbers also the last seven digits), and damped loopy belief propagation makes the
labels of one document agree.  A token gets a new span only if its posterior reaches
``threshold`` and a skip path leads to a token of that kind that the rules found, so a
document without findings stays untouched.

All weights (shape of a token with each label, neighbours, skip links) are fitted by the
pseudo-likelihood with a ridge, on a bounded sample of documents (``sample`` rows with
the smallest hashes of their texts).  The rules are the teachers: half of what they found
is hidden and has to be told from its shape and its links, and half of it is repeated
further on as people repeat such things (bare digits, other marks, a part of it, in
capitals) with the same label, as is one open token for each, with none.

Nulls and empty texts have no spans.  Each row is judged alone, so repeated rows give
repeated results, and ties are broken by position and then by the order of kinds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import giving_back, small_batches
from .spans import SPAN_TYPE, Span, ordered

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

# The character classes of the rules.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^ \t\n\v\f\r]+")
_MARKS = re.compile(r"[^A-Za-z0-9@]+")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_LONG_RUN = re.compile(r"(.)\1{4,}", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: what stands before and after each at sign."""
    floor, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        end = 0
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield begin, end
        floor = max(at + 1, end)
        at = text.find("@", floor)


def matches(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans of the rules, and the matches that their conditions dropped."""
    found: list[Span] = []
    dropped: list[tuple[int, int]] = []
    if "@" in text:
        found += [("email", s, e, True) for s, e in _emails(text)]
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    found.append(("ip", m.start(), m.end(), True))
                else:
                    dropped.append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end(), True))
                else:
                    dropped.append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end(), True))
                else:
                    dropped.append(m.span())
    return ordered(found, KINDS), dropped


def shape(token: str) -> str:
    """Classes of characters of the whole token with runs shortened: what it looks like."""
    return _LONG_RUN.sub(r"\1\1\1\1", _LETTERS.sub(lambda m: "a" * min(4, len(m[0])), _DIGITS.sub(lambda m: "9" * min(4, len(m[0])), token)))


class Graph:
    """Nodes and factors of one document."""

    __slots__ = ("spans", "given", "dropped", "shapes", "labels", "chain", "skip", "open")

    def __init__(self, text: str, found: list[Span], dropped: list[tuple[int, int]]):
        self.spans, self.shapes, self.labels, self.dropped = [], [], [], []
        keys: dict[str, int] = {}
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        marks = sorted([(s, e, LABELS.index(k)) for k, s, e, _ in found] + [(s, e, -1) for s, e in dropped])
        near, before = 0, -2
        for place, m in enumerate(_TOKEN.finditer(text)):
            token = m[0]
            if not ("@" in token or _DIGIT.search(token)):
                continue
            while near < len(marks) and marks[near][1] <= m.start():
                near += 1
            own, k = [], near
            while k < len(marks) and marks[k][0] < m.end():
                if marks[k][1] > m.start():
                    own.append(marks[k])
                k += 1
            label = max((x[2] for x in own), default=0)
            node = len(self.spans)
            self.spans.append(m.span())
            self.shapes.append(shape(token))
            self.labels.append(max(label, 0))
            self.dropped.append(bool(own) and label < 0)
            if place == before + 1:
                self.chain.append((node - 1, node))
            before = place
            key = _MARKS.sub("", token).lower()
            similar = {key} if len(key) >= 6 else set()
            if (digits := "".join(c for c in token if c in "0123456789")) and len(digits) >= 7:
                similar.add("#" + digits[-7:])
            for k in similar:
                if k in keys and keys[k] != node:
                    self.skip.append((keys[k], node))
                keys[k] = node
        self.skip = sorted(set(self.skip))
        self.given = [x > 0 for x in self.labels]
        self.open = any(not (self.given[b] and self.given[a]) for a, b in self.skip)


def repeated(text: str, found: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with half of the findings, and as many open tokens, repeated at its end
    in other forms; the repeats of findings are further spans."""
    out, more = [text], []
    size = len(text)
    open_ = [m[0] for m in _TOKEN.finditer(text) if _DIGIT.search(m[0]) and not any(s < m.end() and e > m.start() for _, s, e, _ in found)]
    for kind, s, e, _ in found:
        if rng.random() < 0.5:
            continue
        value = text[s:e]
        way = int(rng.integers(3))
        if kind == "email":
            again = (value.upper(), value.split("@")[0], value)[way]
        else:
            digits = "".join(c for c in value if c in "0123456789")
            again = (digits, value.replace(" ", ".").replace("-", "."), digits[-7:])[way]
        out.append(f" see {again}")
        more.append((kind, size + 5, size + 5 + len(again), False))
        size += len(out[-1])
        if open_:
            out.append(f" with {open_[int(rng.integers(len(open_)))]}")
            size += len(out[-1])
    return "".join(out), more


class Field:
    """Weights of shapes, neighbours and skip links, fitted by the pseudo-likelihood."""

    def __init__(self, graphs: list[Graph], taught: list[list[int]], hide: float = 0.5, seed: int = 7, ridge: float = 2.0, steps: int = 300):
        """``taught`` holds the true labels of each graph's nodes."""
        n = len(LABELS)
        rng = np.random.default_rng(seed)
        self.shapes: dict[tuple[str, int], int] = {}
        kind, label, given, dropped, edges = [], [], [], [], ([], [])
        for g, own in zip(graphs, taught):
            base = len(label)
            hidden = rng.random(len(own)) < hide
            for s, truth, known, out, far in zip(g.shapes, own, g.given, hidden, g.dropped):
                kind.append(self.shapes.setdefault((s, int(far)), len(self.shapes)))
                label.append(truth)
                given.append(known and not out)
                dropped.append(far)
            for links, of in zip(edges, (g.chain, g.skip)):
                links += [(base + a, base + b) for a, b in of]
        self.node = np.zeros((len(self.shapes) + 1, n))  # the last row: shapes that were not seen
        self.prior, self.chain, self.skip = np.zeros(n), np.zeros((n, n)), np.zeros((n, n))
        if not label:
            return
        kind, label = np.array(kind), np.array(label)
        open_ = ~np.array(given) & ~np.array(dropped)
        truth = np.eye(n)[label]
        pairs = [np.array(x, int).reshape(-1, 2) for x in edges]
        weights = [self.node[:-1], self.prior, self.chain, self.skip]
        speed = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        for t in range(1, steps + 1):
            odds = weights[0][kind] + weights[1]
            for (p, w) in zip(pairs, weights[2:]):
                np.add.at(odds, p[:, 0], w[:, label[p[:, 1]]].T)
                np.add.at(odds, p[:, 1], w[label[p[:, 0]]])
            odds -= odds.max(axis=1, keepdims=True)
            share = np.exp(odds)
            share /= share.sum(axis=1, keepdims=True)
            off = np.where(open_[:, None], truth - share, 0.0)  # of the log-likelihood of each open node
            slopes = [np.zeros_like(w) for w in weights]
            np.add.at(slopes[0], kind, off)
            slopes[1] = off.sum(axis=0)
            for p, slope in zip(pairs, slopes[2:]):
                np.add.at(slope.T, label[p[:, 1]], off[p[:, 0]])
                np.add.at(slope, label[p[:, 0]], off[p[:, 1]])
            slopes[3] = (slopes[3] + slopes[3].T) / 2  # a skip link has no direction
            for w, slope, (first, second) in zip(weights, slopes, speed):
                slope -= ridge * w
                first *= 0.9
                first += 0.1 * slope
                second *= 0.99
                second += 0.01 * slope**2
                w += 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)

    def unary(self, g: Graph) -> np.ndarray:
        out = np.empty((len(g.spans), len(LABELS)))
        for i, (s, label, dropped) in enumerate(zip(g.shapes, g.labels, g.dropped)):
            if label or dropped:
                out[i] = -50.0
                out[i, label] = 0.0
            else:
                out[i] = self.node[self.shapes.get((s, 0), -1)] + self.prior
        return out

    def posterior(self, g: Graph, rounds: int = 20, damping: float = 0.3) -> np.ndarray:
        """Sum-product messages over all factors of one document."""
        unary = self.unary(g)
        edges = g.chain + g.skip
        if not edges:
            return np.exp(unary - np.logaddexp.reduce(unary, axis=1, keepdims=True))
        pair = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
        a, b = np.array(edges).T
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, target, message)
            outgoing = belief[source] - message[back]
            new = np.logaddexp.reduce(outgoing[:, :, None] + pair, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            moved = damping * message + (1 - damping) * new
            if np.abs(moved - message).max() < 1e-4:
                message = moved
                break
            message = moved
        belief = unary.copy()
        np.add.at(belief, target, message)
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))

    def more(self, text: str, g: Graph, found: list[Span], threshold: float) -> list[Span]:
        """Spans of tokens that agree with a finding of the rules elsewhere in the text."""
        if not g.open or not any(g.given):
            return []
        post = self.posterior(g)
        reach = [{g.labels[i]} - {0} for i in range(len(g.spans))]
        for edges in (g.skip, g.skip[::-1]):  # along the ordered links, there and back
            for a, b in edges:
                reach[a] |= reach[b]
                reach[b] |= reach[a]
        out: list[Span] = []
        for i, (s, e) in enumerate(g.spans):
            label = int(post[i].argmax())
            if g.given[i] or g.dropped[i] or not label or post[i, label] < threshold or label not in reach[i]:
                continue
            while s < e and not text[s].isalnum():
                s += 1
            while e > s and not text[e - 1].isalnum():
                e -= 1
            if s < e and not any(x[1] < e and x[2] > s for x in found):
                out.append((LABELS[label], s, e, False))
        return out


def _sample(df: DataFrame, rows: int) -> list[str]:
    from .sampling import smallest_hashes

    open_texts = df.where(F.col("__text").rlike("[0-9@]"))
    return [r["__text"] for r in smallest_hashes(open_texts, "__text", rows).collect()]


def train(texts: list[str], seed: int = 11) -> Field:
    rng = np.random.default_rng(seed)
    graphs, taught = [], []
    for text in texts:
        found, dropped = matches(text)
        text, more = repeated(text, found, rng)
        found, dropped = matches(text)  # a repeat may be a finding of the rules again
        g = Graph(text, found, dropped)
        own = list(g.labels)
        for kind, s, e, _ in more:
            for i, (a, b) in enumerate(g.spans):
                if a < e and b > s and not own[i] and not g.dropped[i]:
                    own[i] = LABELS.index(kind)
        graphs.append(g)
        taught.append(own)
    return Field(graphs, taught)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 500, threshold: float = 0.8, carry: tuple[str, ...] = ()) -> DataFrame:
    """Spans of personal data in each text: id, the carried columns and ``spans``.

    ``sample`` bounds the rows that train the field; every row is searched.
    """
    kept = [F.col(id_col), *(F.col(c) for c in carry if c != id_col)]
    rows = small_batches(df).select(*kept, F.col(text_col).cast("string").alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(train(_sample(rows, sample)))
    names = rows.columns[:-1]
    schema = T.StructType(rows.drop("__text").schema.fields + T.StructType.fromDDL(f"spans {SPAN_TYPE}").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for text in batch.column(len(names)).to_pylist():
                spans: list[Span] = []
                if text and ("@" in text or _DIGIT.search(text)):
                    spans, dropped = matches(text)
                    if spans:
                        spans = ordered(spans + field.more(text, Graph(text, spans, dropped), spans, threshold), KINDS)
                out.append([{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, kind)], [*names, "spans"])

    return rows.mapInArrow(giving_back(run), schema)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlaps are merged."""
    out, at = [], 0
    for kind, s, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, text_col: str = "text", size_col: str = "n_chars", sample: int = 500, threshold: float = 0.8) -> DataFrame:
    """All columns of ``df`` with personal data replaced, and the size counted anew.

    Rows without findings pass unchanged, nulls included.
    """
    rows = small_batches(df).select(F.col(text_col).cast("string").alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(train(_sample(rows, sample)))
    at, size = df.columns.index(text_col), df.columns.index(size_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            columns = list(batch.columns)
            texts, sizes, changed = columns[at].to_pylist(), columns[size].to_pylist(), False
            for i, text in enumerate(texts):
                if text and ("@" in text or _DIGIT.search(text)):
                    spans, dropped = matches(text)
                    if spans:
                        spans = ordered(spans + field.more(text, Graph(text, spans, dropped), spans, threshold), KINDS)
                        texts[i] = redact(text, spans)
                        sizes[i], changed = len(texts[i]), True
            if changed:
                columns[at] = pa.array(texts, columns[at].type)
                columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(giving_back(run), df.schema)
