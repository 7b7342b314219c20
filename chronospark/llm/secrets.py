"""Secrets by fixed rules and a battery of randomness tests.

The rules find assignments, access keys and long hexadecimal runs in whole texts.  The
battery judges the other unbroken runs of at least ``SHORTEST`` characters that hold a
letter.  A run ends at "=" unless that is its padding, so the value of "name=value" is a
run of its own; one that no alphabet holds, as a path before a key, is judged by its
parts between "-" and "_" or between "+" and "/".  The encoding is inferred: the smallest
of the alphabets in ``ENCODINGS`` that holds the run.  Three tests follow, each with
about 0 for random runs: chi-squared for the uniformity of the characters over that
alphabet, the number of runs (of character classes, or of the alphabet's halves where it
has one class), and the serial correlation of vowels (of the values where it has none).

Their weighted sum is judged against the hypothesis "written by people": identifiers made
of the words in ``WORDS`` with separators, capitals and numbers as people put them
(``written``).  A fixed simulation of such identifiers gives, for each encoding and
length, the weights (those that tell written from random runs best), mean and spread of
the sum, and the distribution of what is left; so p-values are uniform for such
identifiers, with an exponential tail below one in fifty, and
doubled, as other words and styles are in use.  A run of more than LONGEST
characters is judged by its pieces: its p-value is that of the least random one.

False discoveries are controlled over all documents at once: the p-values are counted
per length band (a bounded table: ten bins for each power of ten that a double holds), each band gets a share of the error rate that grows
with its length, and the largest Benjamini-Hochberg threshold is found per band.

Nulls and empty texts have no spans; repeated rows are repeated findings; ties in
p-values fall on the same side of the threshold.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import giving_back, materialize, small_batches
from .spans import Span, ordered

KINDS = ("assign", "access", "hex", "random")

# The rules, and what a text must hold for the first of them.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_NAMES = ("passw", "secret", "token", "key")
SHORTEST = 16
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_=-]{%d})[A-Za-z0-9+/_-]++(?:=++(?![A-Za-z0-9+/_-]))?" % SHORTEST)
_SPLITS = (re.compile(r"[^_-]+"), re.compile(r"[^+/]+"))

_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "letters": _LOWER + _UPPER,
    "base62": _DIGITS + _LOWER + _UPPER,
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
}
_SETS = {k: frozenset(v) for k, v in ENCODINGS.items()}
#: Upper ends of the length bands and their weights in the control of errors.
BANDS = (20, 24, 32, 48, 64, 128, 1 << 62)
_WEIGHT = np.array([0.5, 0.75, 1.0, 1.0, 1.25, 1.25, 1.25])
WEIGHTS = _WEIGHT / _WEIGHT.sum()
BINS = 3001
#: Lengths that are simulated, runs of each, and the longest piece that is judged at once.
LENGTHS = (16, 20, 24, 32, 40, 48, 64, 96, 128, 192, 256)
SIMULATED, LONGEST = 1500, 256
#: Share of the simulated runs below which the tail is continued.
TAIL = 0.02
#: p-values are multiplied by it, as people use other words and styles than the simulated ones.
MARGIN = 2.0
# Words that identifiers are made of.
WORDS = (
    "get set is has add new old all any use run end key map list item name type value data file path user group role page link text line word size time date year month day "
    "hour count total index number first last next start stop open close read write load save send find search sort filter merge split join build make create update delete "
    "remove insert select table column row field form view model class object function method module package server client request response message error warning status "
    "state event handler manager service factory provider controller helper util config option setting default current previous parent child node tree graph image button "
    "window screen color width height left right top bottom center border style layout content title header footer section chapter report order invoice payment customer "
    "account address city country street phone product price stock market company project task team member release version branch test case result release notes final "
    "draft the and for with from into over under about international connection profile information application development environment language document"
).split()


def rules(text: str) -> list[Span]:
    """Spans of the rules; the whole match is the span."""
    found: list[Span] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [("assign", m.start(), m.end(), True) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), True) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), True) for m in _HEX.finditer(text)]
    return ordered(found, KINDS)


def encoding(run: str) -> str | None:
    """The smallest alphabet that holds the run, its padding aside; none for numbers."""
    chars = set(run.rstrip("="))
    if chars <= set(_DIGITS):
        return None
    return next((k for k, v in _SETS.items() if chars <= v), None)


def _tables(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character of an alphabet: its class for the runs, and what the serial
    correlation is taken of."""
    alphabet = ENCODINGS[name]
    kinds = np.array([0 if c in _DIGITS else 1 if c in _LOWER else 2 if c in _UPPER else 3 for c in alphabet])
    _, kinds = np.unique(kinds, return_inverse=True)
    if kinds.max() == 0:
        kinds = (np.arange(len(alphabet)) >= len(alphabet) // 2).astype(int)
    serial = np.array([c in "aeiouAEIOU" for c in alphabet], float) if len(alphabet) > 16 else np.arange(len(alphabet), dtype=float)
    return kinds, np.bincount(kinds) / len(alphabet), serial


_OF = {k: _tables(k) for k in ENCODINGS}
_PLACE = {k: {c: i for i, c in enumerate(v)} for k, v in ENCODINGS.items()}


def statistics(values: np.ndarray, name: str) -> np.ndarray:
    """The three tests of runs of one length (a row of places in the alphabet each)."""
    m, n = values.shape
    size = len(ENCODINGS[name])
    kinds, share, serial = _OF[name]
    counts = np.bincount((np.arange(m)[:, None] * size + values).ravel(), minlength=m * size).reshape(m, size)
    squares = (counts.astype(float) ** 2).sum(axis=1) * size / n - n
    chi = (squares - (size - 1)) / math.sqrt(2 * (size - 1) * max(n - 1, 1) / n)
    k = kinds[values]
    p = 1 - float((share**2).sum())
    changes = (k[:, 1:] != k[:, :-1]).sum(axis=1)
    runs = ((n - 1) * p - changes) / math.sqrt((n - 1) * p * (1 - p))
    x = serial[values]
    x = x - x.mean(axis=1, keepdims=True)
    spread = (x**2).sum(axis=1)
    lag = (x[:, 1:] * x[:, :-1]).sum(axis=1) / np.where(spread > 1e-9, spread, 1.0)
    return np.column_stack([chi, runs, -(lag + 1 / n) * math.sqrt(n)])


def battery(run: str) -> tuple[float, float, float]:
    """z-scores of the three tests; about 0 for random runs, large for written ones."""
    name = encoding(run)
    if name is None:
        return 9.0, 9.0, 9.0
    place = _PLACE[name]
    return tuple(statistics(np.array([[place[c] for c in run.rstrip("=")]]), name)[0].tolist())


def written(rng: random.Random, length: int, name: str) -> str:
    """An identifier of ``length`` characters as people write them, in this encoding."""
    words, chars = _fitting(name), _SETS[name]
    rate = 0.35 if chars & set(_DIGITS) else 0.0
    style, mark = rng.randrange(3), rng.choice("_-") if name == "base64url" else "/" if name == "base64" else ""
    out: list[str] = []
    size = 0
    while size < length:
        if rng.random() < rate * (1 if out else 0.2):
            top = rng.choice((10, 100, 2040, 10**6))
            piece = "".join(c for c in str(rng.randrange(1950 if top == 2040 else 0, top)) if c in chars)
        else:
            piece = rng.choice(words)
            if name in ("upper", "HEX", "base32", "BASE36"):
                piece = piece.upper()
            elif name in ("letters", "base62") or (mark and style == 0):
                piece = piece.upper() if rng.random() < 0.05 else piece.capitalize() if out or style else piece
        if out and mark and rng.random() < 0.9:
            piece = mark + piece
        out.append(piece)
        size += len(piece)
    return "".join(out)[:length]


@functools.cache
def _fitting(name: str) -> list[str]:
    """The words that an alphabet can hold; of hexadecimal ones their letters that it has."""
    if name in ("hex", "HEX"):
        short = {"".join(c for c in w if c in "abcdef") for w in WORDS}
        return sorted(w for w in short if len(w) >= 2)
    return list(WORDS)


class Battery:
    """The battery with its simulated distributions; a fixed table of some 100 KB."""

    def __init__(self, seed: int = 20240607):
        rng, dice = np.random.default_rng(seed), random.Random(seed)
        self.weight: dict[str, np.ndarray] = {}
        self.mean: dict[str, np.ndarray] = {}
        self.spread: dict[str, np.ndarray] = {}
        self.rest: dict[str, np.ndarray] = {}
        self.beyond: dict[str, float] = {}
        for name, alphabet in ENCODINGS.items():
            place, weights, means, spreads, rest = _PLACE[name], [], [], [], []
            long = [written(dice, LENGTHS[-1], name) for _ in range(SIMULATED)]
            for n in LENGTHS:
                made = [r[:n] for r in long]
                runs = [r for r in made if encoding(r) == name]
                if len(runs) < len(made) // 10:  # an encoding that identifiers of this length hardly show
                    runs = made
                own = statistics(np.array([[place[c] for c in r] for r in runs]), name)
                chance = statistics(rng.integers(0, len(alphabet), (1000, n)), name)
                within = np.cov(own.T) + np.cov(chance.T) + 1e-3 * np.eye(3)
                w = np.linalg.solve(within, own.mean(axis=0) - chance.mean(axis=0))
                w /= np.abs(w).sum() or 1.0
                score = own @ w
                weights.append(w)
                means.append(score.mean())
                spreads.append(score.std() or 1.0)
                rest.append((means[-1] - score) / spreads[-1])
            self.weight[name], self.mean[name], self.spread[name] = np.array(weights), np.array(means), np.array(spreads)
            left = np.sort(np.concatenate(rest))
            cut = int(len(left) * (1 - TAIL))
            self.beyond[name] = float((left[cut:] - left[cut]).mean()) or 1.0
            self.rest[name] = left[np.linspace(0, cut, 501).astype(int)]

    def score(self, name: str, tests: np.ndarray, n: int) -> np.ndarray:
        """How far below the written ones the weighted sums lie, in their spreads."""
        at = np.log(min(max(n, LENGTHS[0]), LENGTHS[-1]))
        grid = np.log(LENGTHS)
        mean, spread = (np.interp(at, grid, x[name]) for x in (self.mean, self.spread))
        weight = np.array([np.interp(at, grid, self.weight[name][:, k]) for k in range(3)])
        return (mean - tests @ weight) / spread

    def tail(self, name: str, far: np.ndarray) -> np.ndarray:
        """Share of written runs that lie at least as far below."""
        known = self.rest[name]
        inside = 1 - np.searchsorted(known, far, "left") / (len(known) - 1) * (1 - TAIL)
        outside = TAIL * np.exp(-(far - known[-1]) / self.beyond[name])
        return np.where(far > known[-1], outside, np.clip(inside, TAIL, 1.0))

    def p_value(self, run: str) -> float:
        """Chance that a written run of this length looks as random as this one."""
        name = encoding(run)
        if name is None:
            return 1.0
        place = _PLACE[name]
        value = np.array([place[c] for c in run.rstrip("=")])
        pieces = np.array_split(value, -(-len(value) // LONGEST))
        out = 0.0
        for piece in pieces:
            tests = statistics(piece[None], name)
            out = max(out, float(self.tail(name, self.score(name, tests, len(piece)))[0]))
        return min(1.0, max(MARGIN * out, 1e-300))


@functools.cache
def judge() -> Battery:
    """The battery of this process; the simulation is the same everywhere."""
    return Battery()


def p_value(run: str) -> float:
    return judge().p_value(run)


def _judged(run: str, at: int, known: Battery) -> tuple[int, int, float] | None:
    """Start, end and p-value of a run that is long enough and holds a letter."""
    if len(run) < SHORTEST or run.isdigit():
        return None
    return at, at + len(run), known.p_value(run)


def _parts(run: str, at: int, known: Battery) -> list[tuple[int, int, float]]:
    """The run, or its parts by the separators that leave the most random one."""
    if encoding(run) is not None:
        found = _judged(run, at, known)
        return [found] if found else []
    ways = [[x for m in split.finditer(run) if (x := _judged(m[0], at + m.start(), known))] for split in _SPLITS]
    best = min(ways, key=lambda way: min((p for _, _, p in way), default=2.0))
    # The better of two ways was picked, so a p-value counts twice.
    return [(s, e, min(1.0, len(_SPLITS) * p)) for s, e, p in best]


def candidates(text: str, found: list[Span], known: Battery | None = None) -> list[tuple[int, int, float]]:
    """Runs outside the rules' spans: start, end and p-value."""
    out, near = [], 0
    ends = np.maximum.accumulate([x[2] for x in found]).tolist() if found else []
    for m in _RUN.finditer(text):
        if len(m[0]) >= SHORTEST:
            while near < len(ends) and ends[near] <= m.start():
                near += 1
            close = []
            for k in range(near, len(found)):
                if found[k][1] >= m.end():
                    break
                close.append(found[k])
            out += [x for x in _parts(m[0], m.start(), known or judge()) if not any(s < x[1] and e > x[0] for _, s, e, _ in close)]
    return out


def _band(length: int) -> int:
    return next(i for i, top in enumerate(BANDS) if length <= top)


def thresholds(counts: dict[tuple[int, int], int], rate: float) -> list[float]:
    """The largest p-value of each band that is a discovery, from binned counts.

    Bin b holds p-values from 10**-(b+1)/10 up to 10**-b/10; a whole bin passes or not.
    Band i may err at its weight's share of ``rate``.
    """
    out = []
    for i in range(len(BANDS)):
        own = {b: n for (band, b), n in counts.items() if band == i}
        total, upto, best = sum(own.values()), 0, 0.0
        for b in sorted(own, reverse=True):
            upto += own[b]
            if 10 ** (-b / 10) <= rate * WEIGHTS[i] * len(BANDS) * upto / max(total, 1):
                best = 10 ** (-b / 10)
        out.append(best)
    return out


def _bin(p: float) -> int:
    return min(BINS - 1, int(-10 * math.log10(p)))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """Secrets in each text: id and ``spans``.

    The texts are read once; rules and candidates go to a narrow scratch table, from
    which the counts of p-values and then the result are taken.
    """
    kind = df.schema[id_col].dataType.simpleString()
    made = f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>, runs array<struct<start:long,end:long,p:double,band:int,bin:int>>"

    shared = df.sparkSession.sparkContext.broadcast(judge())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        seen = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64()), ("band", pa.int32()), ("bin", pa.int32())]))
        for batch in batches:
            one, two = [], []
            for text in batch.column(1).to_pylist():
                found = rules(text) if text else []
                runs = candidates(text, found, known) if text else []
                one.append([{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in found])
                two.append([{"start": s, "end": e, "p": p, "band": _band(e - s), "bin": _bin(p)} for s, e, p in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, span), pa.array(two, seen)], [id_col, "spans", "runs"])

    rows = small_batches(df).select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    found = materialize(rows.mapInArrow(giving_back(run), made), "secrets")
    counts = found.select(F.explode("runs").alias("r")).groupBy("r.band", "r.bin").count()
    cut = thresholds({(r["band"], r["bin"]): r["count"] for r in counts.collect()}, rate)  # at most bands x bins rows
    limits = F.array(*[F.lit(float(x)) for x in cut])
    passed = F.filter("runs", lambda r: r["p"] <= F.element_at(limits, r["band"] + 1))
    extra = F.transform(passed, lambda r: F.struct(F.lit("random").alias("kind"), r["start"].alias("start"), r["end"].alias("end"), F.lit(False).alias("base")))
    rank = F.array(*[F.lit(k) for k in KINDS])

    def by_place(a, b):
        return (
            F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(F.array_position(rank, a["kind"]) < F.array_position(rank, b["kind"]), -1)
            .when(F.array_position(rank, a["kind"]) > F.array_position(rank, b["kind"]), 1)
            .otherwise(0).cast("int")
        )

    return found.select(id_col, F.when(F.size(extra) == 0, F.col("spans")).otherwise(F.array_sort(F.concat("spans", extra), by_place)).alias("spans"))
