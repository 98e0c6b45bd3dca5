"""Mixing sources to target weights: raking by iterative proportional fitting, then calibrated sampling.

The token counts of the (source, language, topic) cells are raked until their margins meet the target
shares. A document of a cell is then drawn with the expected number of copies that gives its cell its
fitted tokens: the whole part always, the rest by a hash of its id and a seed, so a repeated run or a lost
executor gives the same sample.

Cells are summed before the shuffle, so a hot source costs one row per task. Up to SMALL cells are raked
on the driver as one row each; more are raked by joins, sweep after sweep, with the same result.

Defined cases: a null or empty text has no tokens and leaves its cell's share unchanged, but is drawn like
its cell (a cell without any tokens is drawn whole); null cell values are values of their own; a null
doc_id hashes like any other id, so such rows are drawn together; repeated rows are drawn together; target
values that no document has are left out and the others scaled up, and values without a target keep their
share; an empty table gives an empty result; other columns are kept by sampled and never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm import topics
from inkfold.llm.tables import free_name, materialize

DIMS = ("source", "lang", "topic")
SMALL = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Targets:
    """Target shares by dimension. A dimension without given shares has its own ones, tempered by `power` (0 makes them equal)."""

    power: float = 0.95
    shares: tuple[tuple[str, dict], ...] = ()
    #: Temper cells instead of margins: the targets are the margins of cells to the power of `power`, scaled to the given
    #: shares (of one dimension at most), so they agree with each other even where dimensions go together, as language and topic do.
    joint: bool = False

    def __post_init__(self):
        if self.joint and len(self.shares) > 1:
            raise ValueError("joint targets take given shares of one dimension")

    def of(self, dim: str, observed: dict) -> dict:
        """The share of each observed value; they sum to 1."""
        total = sum(observed.values()) or 1.0
        given = dict(self.shares).get(dim)
        if given is None:
            raw = {v: (n / total) ** self.power if n else 0.0 for v, n in observed.items()}
        else:
            free = {v: n / total for v, n in observed.items() if v not in given and n}
            room = 1 - sum(free.values())
            asked = {v: s for v, s in given.items() if observed.get(v)}
            scale = room / (sum(asked.values()) or 1.0)
            raw = free | {v: s * scale for v, s in asked.items()}
        whole = sum(raw.values()) or 1.0
        return {v: raw.get(v, 0.0) / whole for v in observed}


#: The production mix: given language shares; sources and topics tempered a little towards equal shares.
MIX = Targets(0.9, (("lang", {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}),), joint=True)


def rake(table: pd.DataFrame, targets: dict[str, dict], sweeps: int = 50, tolerance: float = 1e-6) -> np.ndarray:
    """Shares of the cells whose margins meet targets: source, lang, topic and tokens in, one share per row out."""
    share = table["tokens"].to_numpy(np.float64)
    share = share / (share.sum() or 1.0)
    codes = {d: table[d].factorize(use_na_sentinel=False) for d in DIMS}
    goal = {d: np.array([targets[d].get(None if pd.isna(v) else v, 0.0) for v in codes[d][1]]) for d in DIMS}
    for _ in range(sweeps):
        off = 0.0
        for d in DIMS:
            code = codes[d][0]
            margin = np.bincount(code, share, len(goal[d]))
            ratio = np.divide(goal[d], margin, out=np.ones(len(margin)), where=margin > 0)
            off = max(off, float(np.abs(ratio - 1)[margin > 0].max(initial=0)))
            share = share * ratio[code]
        if off < tolerance:
            break
    return share


def apart(table: pd.DataFrame, share: np.ndarray, targets: dict[str, dict]) -> float:
    """The largest difference between a margin of the cells' shares and its target."""
    off = 0.0
    for d in DIMS:
        for value, fitted in pd.Series(share).groupby(table[d], dropna=False).sum().items():
            off = max(off, abs(fitted - targets[d].get(None if pd.isna(value) else value, 0.0)))
    return float(off)


def rake_by_joins(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """rake for any number of cells: adds share. targets: (value, goal) by dimension."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = materialize(cells.withColumn("share", F.col("tokens") / F.lit(float(total))), "cells")
    for _ in range(sweeps):
        start = now
        for d in DIMS:
            margin = now.groupBy(F.col(d).alias("value")).agg(F.sum("share").alias("margin"))
            ratio = margin.join(targets[d], margin["value"].eqNullSafe(targets[d]["value"])).select(
                margin["value"].alias("value"), F.when(F.col("margin") > 0, F.col("goal") / F.col("margin")).otherwise(1.0).alias("ratio")
            )
            now = now.join(ratio, now[d].eqNullSafe(ratio["value"])).select(*DIMS, "tokens", "docs", (F.col("share") * F.col("ratio")).alias("share"))
        now = materialize(now, "cells")
        moved = now.alias("a").join(start.alias("b"), [F.col(f"a.{d}").eqNullSafe(F.col(f"b.{d}")) for d in DIMS])
        off = moved.where("b.share > 0").agg(F.max(F.abs(F.col("a.share") / F.col("b.share") - 1))).first()[0]
        if not off or off < tolerance:
            break
    return now


def cell_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def cell_copies(rows: DataFrame, targets: Targets, budget: int | None = None, small: int = SMALL) -> tuple[DataFrame, bool, float]:
    """Expected copies of a document of each cell, whether the cells are few, and how far a fitted margin is from its target at most.

    rows: DIMS and n_tokens.

    budget: tokens that the sample should have; by default as many as there are without a second copy of any
    document.
    """
    cells = materialize(cell_table(rows), "cells")
    margins = {d: cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("n")) for d in DIMS}
    few = cells.limit(small + 1).count() <= small
    if few:
        table = cells.toPandas().sort_values(list(DIMS), na_position="first", ignore_index=True)
        goal = {}
        for d in DIMS:
            sums = table.groupby(d, dropna=False)["tokens"].sum()
            goal[d] = targets.of(d, {None if pd.isna(v) else v: float(n) for v, n in sums.items()})
        if targets.joint:
            weight = table["tokens"].to_numpy(np.float64) ** targets.power * (table["tokens"] > 0)
            for d, _ in targets.shares:
                weight = weight / weight.groupby(table[d], dropna=False).transform("sum").replace(0, 1) * [goal[d][None if pd.isna(v) else v] for v in table[d]]
            for d in DIMS:
                goal[d] = {None if pd.isna(v) else v: n / (weight.sum() or 1.0) for v, n in weight.groupby(table[d], dropna=False).sum().items()}
        share, tokens = rake(table, goal), table["tokens"].to_numpy(np.float64)
        per_token = np.divide(share, tokens, out=np.zeros_like(share), where=tokens > 0)
        scale = budget if budget is not None else 1 / (per_token.max(initial=0) or 1.0)
        # a cell without tokens is drawn whole; rounding must not lose the largest probability
        copies = np.where(tokens > 0, np.round(per_token * scale, 12), 1.0)
        rows_out = [(*(None if pd.isna(v) else v for v in cell), float(e)) for cell, e in zip(table[list(DIMS)].itertuples(index=False), copies)]
        kinds = ", ".join(f"{d} string" for d in DIMS)
        return cells.sparkSession.createDataFrame(rows_out, f"{kinds}, expected double"), True, apart(table, share, goal) if tokens.any() else 0.0
    goals = {d: _goals(margins[d], targets, d) for d in DIMS} if not targets.joint else _joint_goals(cells, margins, targets)
    fitted = rake_by_joins(cells, goals).withColumn("per_token", F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens")))
    top = fitted.agg(F.max("per_token")).first()[0] or 1.0
    scale = float(budget) if budget is not None else 1 / top
    expected = F.coalesce(F.round(F.col("per_token") * scale, 12), F.lit(1.0))
    off = 0.0
    for d in DIMS:
        margin = fitted.groupBy(F.col(d).alias("value")).agg(F.sum("share").alias("share"))
        both = margin.join(goals[d], margin["value"].eqNullSafe(goals[d]["value"]))
        off = max(off, both.agg(F.max(F.abs(F.col("share") - F.col("goal")))).first()[0] or 0.0)
    return materialize(fitted.select(*DIMS, expected.alias("expected")), "copies"), False, off


def _goals(margin: DataFrame, targets: Targets, dim: str) -> DataFrame:
    """Targets.of as a DataFrame, for margins of any size."""
    given = dict(targets.shares).get(dim)
    total = float(margin.agg(F.sum("n")).first()[0] or 1)
    share = margin.select("value", (F.col("n") / total).alias("s"))
    if given is None:
        raw = share.select("value", F.when(F.col("s") > 0, F.pow("s", F.lit(targets.power))).otherwise(0.0).alias("raw"))
    else:
        asked = margin.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "asked_value string, asked double")
        both = share.join(F.broadcast(asked), share["value"].eqNullSafe(asked["asked_value"]), "left")
        sums = both.agg(F.sum(F.when(F.col("asked").isNull(), F.col("s"))).alias("free"), F.sum(F.when(F.col("s") > 0, F.col("asked"))).alias("asked")).first()
        scale = (1 - (sums["free"] or 0.0)) / (sums["asked"] or 1.0)
        raw = both.select("value", F.when(F.col("asked").isNull(), F.col("s")).when(F.col("s") > 0, F.col("asked") * scale).otherwise(0.0).alias("raw"))
    whole = float(raw.agg(F.sum("raw")).first()[0] or 1)
    return materialize(raw.select("value", (F.col("raw") / whole).alias("goal")), "goals")


def _joint_goals(cells: DataFrame, margins: dict[str, DataFrame], targets: Targets) -> dict[str, DataFrame]:
    """The targets of joint tempering as DataFrames, for cells of any number."""
    weighed = cells.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(targets.power))).otherwise(0.0))
    for d, _ in targets.shares:
        sums = weighed.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("whole"))
        goal = _goals(margins[d], targets, d)
        scale = sums.join(goal, sums["value"].eqNullSafe(goal["value"])).select(sums["value"], F.when(F.col("whole") > 0, F.col("goal") / F.col("whole")).otherwise(0.0).alias("scale"))
        weighed = weighed.join(scale, weighed[d].eqNullSafe(scale["value"])).select(*DIMS, (F.col("weight") * F.col("scale")).alias("weight"))
    weighed = materialize(weighed.select(*DIMS, "weight"), "weights")
    whole = float(weighed.agg(F.sum("weight")).first()[0] or 1)
    return {d: materialize(weighed.groupBy(F.col(d).alias("value")).agg((F.sum("weight") / whole).alias("goal")), "goals") for d in DIMS}


def copies(expected: Column, doc_id: Column, seed: int) -> Column:
    """The whole part of `expected`, and one more with the probability of the rest, by hash."""
    draw = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(2**53))
    return (F.floor(expected) + (draw < expected - F.floor(expected)).cast("int")).cast("int")


def _with_expected(rows: DataFrame, names: dict[str, str], cells: DataFrame, few: bool, to: str) -> DataFrame:
    """rows with the expected copies of their cell as `to`; cells are broadcast only if their number is within SMALL."""
    cells = cells.select(*[F.col(d).alias(f"{to}_{d}") for d in DIMS], F.col("expected").alias(to))
    cells = F.broadcast(cells) if few else cells
    on = [rows[names[d]].eqNullSafe(cells[f"{to}_{d}"]) for d in DIMS]
    return rows.join(cells, on).drop(*[f"{to}_{d}" for d in DIMS])


def plan(docs: DataFrame, targets: Targets = Targets(), budget: int | None = None, seed: int = 17, topic: Column | None = None, small: int = SMALL) -> DataFrame:
    """doc_id, the cell, n_tokens, the expected copies, the copies drawn and the residual, for every row of docs.

    topic: by default the clusters of topics.fit. residual: how far a fitted margin is from its target at most, a share.
    """
    own = topic if topic is not None else topics.fit(docs).of(F.col("text"))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), own.alias("topic"), token_count(F.col("text")).alias("n_tokens"))
    rows = materialize(rows, "mix-rows")
    cells, few, off = cell_copies(rows, targets, budget, small)
    out = _with_expected(rows, {d: d for d in DIMS}, cells, few, "expected")
    return out.select("doc_id", *DIMS, "n_tokens", "expected", copies(F.col("expected"), F.col("doc_id"), seed).alias("copies"), F.lit(off).alias("residual"))


def sampled(docs: DataFrame, targets: Targets = Targets(), budget: int | None = None, seed: int = 17, topic: Column | None = None, small: int = SMALL) -> DataFrame:
    """The rows drawn from docs, as often as they are drawn, with the columns of docs; texts aren't shuffled if cells are few."""
    mark = free_name(docs, "mix")
    names = {d: f"{mark}_own_{d}" for d in DIMS}
    own = topic if topic is not None else topics.fit(docs).of(F.col("text"))
    rows = docs.select("*", F.col("source").cast("string").alias(names["source"]), F.col("lang").cast("string").alias(names["lang"]), own.alias(names["topic"]))
    stats = rows.select(*[F.col(names[d]).alias(d) for d in DIMS], token_count(F.col("text")).alias("n_tokens"))
    cells, few, _ = cell_copies(stats, targets, budget, small)
    drawn = _with_expected(rows, names, cells, few, f"{mark}_expected")
    n = copies(F.col(f"{mark}_expected"), F.col("doc_id"), seed)
    one_each = drawn.where(n >= 1).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), n)).alias(f"{mark}_copy"))
    return one_each.select(*docs.columns)
