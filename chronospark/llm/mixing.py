"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Tokens are summed over all documents into cells of source, language and topic.  The
cells' weights are raked in turn to the three target marginals until none is off by
more than ``tolerance``.  A document's probability is its cell's factor, at most 1: cells
that would pass it are kept whole and the others of their values raked further, so that
the expected tokens of the sample have the target marginals.  A document is drawn when a
hash of its id (and text) falls below its probability, so the draw does not depend on how
the rows are dealt.

The sample is the largest (in tokens) whose marginals no value is too small for, and has
a share of ``least`` of all tokens at least: values that are too small for their part of
that stay whole, and what they lack goes to the other values.  Only given targets, which
are met as they are, can make it smaller.  Where the cells cannot meet the marginals at
that size, smaller ones down to the least share are tried, and the one nearest is taken;
a warning says how far it is off.

Targets are shares per value.  Where none are given, a marginal's shares are its own
to the power ``temper``, so large sources lose weight and small ones gain.  Values
without a target keep their own share; targets of absent values are left out, and what
remains is scaled to 1.

Nulls count as a value of their own ("" in keys).  Documents without tokens are drawn
with their cell's probability.  Repeated rows have equal probability and equal fate.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

log = logging.getLogger(__name__)

MARGINALS = ("source", "lang", "topic")
#: Cells that may be raked on the driver (a few MB); more are raked by Spark.
DRIVER_CELLS = 100_000
#: Share of all tokens that is kept at least where no targets are given.
LEAST = 0.5
#: How much smaller each further trial of a sample size is, and how many there are.
SMALLER, TRIALS = 0.95, 20
#: Bounds of the iterations: steps to cap a marginal, growth of a factor in one step.
CAP_ROUNDS, MOST_STEP = 50, 100.0
#: A factor from here on counts as 1, so that rounding does not decide it.
FULL = 1 - 1e-9


def topic_of(text: Column) -> Column:
    """What a text looks like: the layouts that web text comes in.

    A notice is a license line anywhere in the text, as such lines mostly end a page.
    """
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) > F.length(text) / 40, "table")
        .when(F.lower(text).rlike("licen[cs]|copyright|rights reserved"), "notice")
        .when(F.instr(text, "@") > 0, "contact")
        .when(F.length(text) < 400, "note")
        .when(F.length(text) < 4000, "article")
        .otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def shares(own: dict[str, float], target: dict[str, float] | None, temper: float) -> dict[str, float]:
    total = sum(own.values()) or 1.0
    if target is None:
        raw = {k: (v / total) ** temper if v > 0 else 0.0 for k, v in own.items()}
    else:
        raw = {k: float(target.get(k, v / total)) for k, v in own.items()}
    whole = sum(v for k, v in raw.items() if own[k] > 0) or 1.0
    return {k: v / whole if own[k] > 0 else 0.0 for k, v in raw.items()}


def capped(own: dict[str, float], target: dict[str, float], size: float) -> dict[str, float]:
    """Parts of a sample of ``size`` of all tokens: none is more than the value has."""
    total, scale = sum(own.values()) or 1.0, size
    for _ in range(CAP_ROUNDS):
        short = sum(own[v] / total for v, w in target.items() if scale * w >= own[v] / total)
        rest = sum(w for v, w in target.items() if scale * w < own[v] / total)
        before, scale = scale, (size - short) / rest if rest > 0 else scale
        if abs(scale - before) <= 1e-12 * before:
            break
    return {v: min(scale * w, own[v] / total) for v, w in target.items()}


def rake(cells: list[tuple[tuple[str, ...], float]], targets: list[dict[str, float]], tolerance: float = 1e-6, rounds: int = 200) -> np.ndarray:
    """A factor for each cell, by raking to each marginal in turn."""
    return _rake(cells, targets, tolerance, rounds, 1.0, np.inf)[0]


def _rake(cells: list[tuple[tuple[str, ...], float]], targets: list[dict[str, float]], tolerance: float, rounds: int, size: float, full: float) -> tuple[np.ndarray, float]:
    """The factors, from ``size`` on, and how far the marginals are off; a factor of
    ``full`` or more keeps a cell whole."""
    weight = np.array([w for _, w in cells], float)
    factor = np.full(len(cells), size)
    index, goal = [], []
    for k, target in enumerate(targets):
        names = sorted(target)
        at = {v: i for i, v in enumerate(names)}
        index.append(np.array([at[key[k]] for key, _ in cells], int))
        goal.append(np.array([target[v] for v in names]))
    total, worst = weight.sum(), 0.0
    if not total:
        return factor, worst
    for _ in range(rounds):
        worst = 0.0
        for at, want in zip(index, goal):
            whole = np.bincount(at, np.where(factor >= full, weight, 0.0), len(want)) / total
            rest = np.bincount(at, np.where(factor >= full, 0.0, weight * factor), len(want)) / total
            have = whole + rest
            ratio = np.where(have > 0, want / np.where(have > 0, have, 1), 1.0)
            # Only what is not whole can still grow (a step of Newton's method).
            ratio = np.where((rest > 0) & (want > whole), np.minimum((want - whole) / np.where(rest > 0, rest, 1), MOST_STEP), ratio)
            worst = max(worst, float(np.abs(have - want)[have > 0].max(initial=0.0)))
            factor = factor * ratio[at]
        if worst < tolerance:
            break
    return factor, worst


def _rake_spread(cells: DataFrame, targets: list[DataFrame], tolerance: float, rounds: int, size: float) -> tuple[DataFrame, float]:
    """The same for any number of cells: each step is a sum and a join."""
    cells = materialize(cells.withColumn("factor", F.lit(float(size))), "cells")
    total, worst = cells.agg(F.sum("tokens")).first()[0] or 1, 0.0
    full = F.col("factor") >= FULL
    for _ in range(rounds):
        worst = 0.0
        for name, target in zip(MARGINALS, targets):
            have = cells.groupBy(name).agg((F.sum(F.when(full, F.col("tokens")).otherwise(0)) / total).alias("whole"), (F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("factor"))) / total).alias("rest")).withColumn("have", F.col("whole") + F.col("rest"))
            step = F.when((F.col("rest") > 0) & (F.col("want") > F.col("whole")), F.least(F.lit(MOST_STEP), (F.col("want") - F.col("whole")) / F.col("rest"))).when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(1.0)
            ratio = materialize(have.join(target, name).select(name, "have", "want", step.alias("ratio")), "ratio")
            worst = max(worst, ratio.agg(F.max(F.when(F.col("have") > 0, F.abs(F.col("have") - F.col("want"))))).first()[0] or 0.0)
            cells = cells.join(ratio.select(name, "ratio"), name).withColumn("factor", F.col("factor") * F.col("ratio")).drop("ratio")
        cells = materialize(cells, "cells")
        if worst < tolerance:
            break
    return cells, worst


def _capped_spread(target: DataFrame, name: str, size: float) -> DataFrame:
    """``capped`` for any number of values, from their shares ``own`` and ``goal``."""
    scale = size
    for _ in range(CAP_ROUNDS):
        over = F.lit(scale) * F.col("goal") >= F.col("own")
        short, rest = target.agg(F.sum(F.when(over, F.col("own"))), F.sum(F.when(~over, F.col("goal")))).first()
        before, scale = scale, (size - (short or 0.0)) / rest if rest else scale
        if abs(scale - before) <= 1e-12 * before:
            break
    return target.select(name, F.least(F.lit(scale) * F.col("goal"), F.col("own")).alias("want"))


def _nearest(limits: list[tuple[str, float]], given: dict, least: float, tolerance: float, trial):
    """The factors of the largest sample that meets its marginals, by ``trial(size)``.

    ``limits`` are the sizes up to which each marginal's smallest value suffices.
    """
    hard = min((x for name, x in limits if name in given), default=1.0)
    soft = min((x for name, x in limits if name not in given), default=1.0)
    size = min(1.0, hard, max(soft, least))
    floor, best, off = 0.0 if given else min(size, least), None, np.inf
    for _ in range(TRIALS):
        found, worst = trial(size)
        if best is None or worst < off:
            best, off = found, worst
        if worst < tolerance or size <= floor:
            break
        size = max(floor, size * SMALLER)
    if off >= tolerance:
        log.warning("the cells cannot meet the marginals: the sample that comes nearest is off by %.2g of all tokens", off)
    return best


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))


def factors(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.85, tolerance: float = 1e-6, rounds: int = 200, driver_cells: int = DRIVER_CELLS, least: float = LEAST) -> DataFrame:
    """The raked cells: source, lang, topic and probability."""
    spark, targets = cells.sparkSession, targets or {}
    cells = materialize(cells, "cells")
    if cells.count() <= driver_cells:
        own = [((r[0], r[1], r[2]), float(r["tokens"])) for r in cells.collect()]  # bounded just now
        sizes, goals, limits = [], [], []
        for k, name in enumerate(MARGINALS):
            sums: dict[str, float] = {}
            for key, w in own:
                sums[key[k]] = sums.get(key[k], 0.0) + w
            goals.append(shares(sums, targets.get(name), temper))
            sizes.append(sums)
            total = sum(sums.values()) or 1.0
            limits.append((name, min((sums[v] / total / w for v, w in goals[k].items() if w > 0), default=1.0)))
        factor = _nearest(limits, targets, least, tolerance, lambda size: _rake(own, [capped(s, g, size) for s, g in zip(sizes, goals)], tolerance, rounds, size, FULL))
        made = [(*key, float(min(1.0, f)) if w > 0 else 1.0) for (key, w), f in zip(own, factor)]
        return F.broadcast(spark.createDataFrame(made, "source string, lang string, topic string, probability double"))
    goals, limits = [], []
    for name in MARGINALS:
        sums = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("w"))
        total = sums.agg(F.sum("w")).first()[0] or 1.0
        raw = F.pow(F.col("w") / total, F.lit(temper))
        if name in targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[name].items()] or [("", 0.0)], f"{name} string, given double")
            sums = sums.join(given, name, "left")
            raw = F.coalesce("given", F.col("w") / total)
        sums = materialize(sums.select(name, (F.col("w") / total).alias("own"), F.when(F.col("w") > 0, raw).otherwise(0.0).alias("want")), "goal")
        whole = sums.agg(F.sum("want")).first()[0] or 1.0
        goals.append(sums.select(name, "own", (F.col("want") / whole).alias("goal")))
        limits.append((name, goals[-1].where("goal > 0").agg(F.min(F.col("own") / F.col("goal"))).first()[0] or 1.0))
    raked = _nearest(limits, targets, least, tolerance, lambda size: _rake_spread(cells, [_capped_spread(g, n, size) for n, g in zip(MARGINALS, goals)], tolerance, rounds, size))
    return raked.select(*MARGINALS, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("factor"))).otherwise(1.0).alias("probability"))


def keyed(df: DataFrame, text_col: str = "text", topic: Column | None = None) -> list[Column]:
    """The cell of a row and its tokens."""
    text = F.col(text_col).cast("string")
    return [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("__lang"), (topic_of(text) if topic is None else topic).alias("__topic"), tokens_of(text).alias("__tokens")]


def draw(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, dict[str, float]] | None = None, temper: float = 0.85, seed: int = 1, only_drawn: bool = False, least: float = LEAST) -> DataFrame:
    """id, source, lang, topic, tokens, probability and sampled of each row.

    With ``only_drawn`` the drawn rows and only the columns of ``df``.
    """
    names = df.columns
    text = F.col(text_col).cast("string")
    own = keyed(df, text_col)
    draw_of = F.xxhash64(F.lit(seed), F.col(id_col), text).alias("__draw")
    if only_drawn:  # whole rows: their cells are found again when they are written
        rows = df.select(*[F.col(c).alias(f"__in{i}") for i, c in enumerate(names)], *own, draw_of)
    else:  # the texts are read once; what is left of them is narrow
        rows = materialize(df.select(F.col(id_col).alias(f"__in{names.index(id_col)}"), *own, draw_of), "keyed")
    cells = rows.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic")).agg(F.sum("__tokens").alias("tokens"))
    found = factors(cells, targets, temper, least=least).select(*[F.col(c).alias(f"__{c}") for c in MARGINALS], F.col("probability").alias("__p"))
    # At most DRIVER_CELLS cells are broadcast, more are joined by a shuffle.
    joined = rows.join(found, ["__source", "__lang", "__topic"], "left")
    unit = (F.shiftrightunsigned(F.col("__draw"), 11).cast("double")) / F.lit(float(1 << 53))
    drawn = unit < F.col("__p")
    if only_drawn:
        return joined.where(drawn).select(*[F.col(f"__in{i}").alias(c) for i, c in enumerate(names)])
    return joined.select(F.col(f"__in{names.index(id_col)}").alias(id_col), F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.col("__p").alias("probability"), drawn.alias("sampled"))
