"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed into cells of source, language and topic. Sampling probabilities of the cells, which start out equal
to the wanted share of all tokens, are raked: scaled so that the expected tokens of each source, then each language,
then each topic meet their targets, cut off at 1, and round again until nothing moves. A document is drawn with the
probability of its cell by a hash of its id and text, so a rerun or a lost executor draws the same ones, and its
weight is its cell's probability over the wanted share.

Targets may be given as shares by value; by default a value's share is its share of the tokens to a power below 1,
which damps large ones. There may be many cells: up to ``max_cells`` of them (some 100 bytes each) are raked on the
driver and broadcast back, beyond that the same steps run as joins and aggregates over the table of cells, with the
same rule to stop.

Not all targets can be met: a cell can't give more than all of its documents. ``mix_report`` has what each source,
language and topic was to give and gives, and ``mix_sources`` warns where one is off by more than ``OFF`` of its target.

Topics: where there is no topic column, ``topic_of`` sorts texts by layout and length.

Defined cases: null sources, languages and topics are a value of their own, ``(none)``; documents without words have
no tokens and are drawn with their cell's probability; rows equal in id and text are drawn alike; an empty table gives
an empty result; values that the targets don't name have target 0, and are not drawn; texts of any length are counted
whole; other columns are kept, but one named ``mix`` gives way to the result.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..session import materialise
from .columns import spaced

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.8, "topic": 0.9}
SHARE = 0.6
MAX_CELLS = 100_000
ROUNDS = 200
TOLERANCE = 1e-9
NONE = "(none)"
#: Share of its target by which a marginal may be off without a warning.
OFF = 0.02


def topic_of(text: Column, n_tokens: Column) -> Column:
    bars = F.regexp_count(text, F.lit(r"\|"))
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return (
        F.when(bars * 5 >= n_tokens, "table")
        .when(n_tokens < 60, "note")
        .when(lines * 8 >= n_tokens, "list")
        .when(n_tokens < 1000, "article")
        .otherwise("long-form")
    )


def token_count(text: Column) -> Column:
    """Words between ASCII white space: places where one begins."""
    return F.size(F.array_remove(F.split(spaced(text), " "), "")).cast("bigint")


def _targets(totals: dict[str, dict[str, float]], given: Mapping[str, Mapping[str, float]], powers: Mapping[str, float]) -> dict[str, dict[str, float]]:
    out = {}
    for d, sums in totals.items():
        raw = {v: float(given[d].get(v, 0.0)) for v in sums} if d in given else {v: s ** powers[d] if s > 0 else 0.0 for v, s in sums.items()}
        whole = sum(raw.values())
        out[d] = {v: (x / whole if whole else 0.0) for v, x in raw.items()}
    return out


def rake(cells: list[tuple], share: float = SHARE, given: Mapping[str, Mapping[str, float]] | None = None, powers: Mapping[str, float] = POWERS) -> list[float]:
    """Probabilities of cells (source, lang, topic, tokens)."""
    total = math.fsum(c[3] for c in cells)
    p = [share] * len(cells)
    if not total:
        return p
    sums = {d: {} for d in DIMENSIONS}
    for c in cells:
        for i, d in enumerate(DIMENSIONS):
            sums[d][c[i]] = sums[d].get(c[i], 0.0) + c[3]
    targets = _targets(sums, given or {}, powers)
    for _ in range(ROUNDS):
        moved = 0.0
        for i, d in enumerate(DIMENSIONS):
            now: dict[str, float] = {}
            for c, x in zip(cells, p):
                now[c[i]] = now.get(c[i], 0.0) + c[3] * x
            for k, c in enumerate(cells):
                if c[3] and now[c[i]]:
                    x = min(1.0, p[k] * share * total * targets[d][c[i]] / now[c[i]])
                    moved, p[k] = max(moved, abs(x - p[k])), x
        if moved < TOLERANCE:
            break
    return p


def _wanted(cells: DataFrame, d: str, share: float, given: Mapping[str, Mapping[str, float]] | None, powers: Mapping[str, float]) -> DataFrame:
    """(d, want): the tokens each value of a dimension is to give."""
    sums = cells.groupBy(d).agg(F.sum("tokens").alias("s"))
    if given and d in given:
        table = F.create_map(*(F.lit(x) for k, v in given[d].items() for x in (k, float(v)))) if given[d] else None
        raw = F.coalesce(F.try_element_at(table, F.col(d)), F.lit(0.0)) if table is not None else F.lit(0.0)
    else:
        raw = F.when(F.col("s") > 0, F.pow(F.col("s").cast("double"), F.lit(powers[d]))).otherwise(F.lit(0.0))
    sums = sums.withColumn("raw", raw)
    whole = sums.agg(F.sum("raw").alias("w"), F.sum("s").alias("t")).first()
    return sums.select(d, (F.col("raw") * F.lit(share * float(whole["t"] or 0) / (whole["w"] or 1))).alias("want"))


def rake_frame(cells: DataFrame, share: float = SHARE, given: Mapping[str, Mapping[str, float]] | None = None, powers: Mapping[str, float] = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """The same for any number of cells, by the same rule to stop, as a table with a column p."""
    now = cells.withColumn("p", F.lit(share))
    wanted = {d: materialise(_wanted(cells, d, share, given, powers), "mix-targets") for d in DIMENSIONS}
    for _ in range(rounds):
        now = now.withColumn("moved", F.lit(0.0))
        for d in DIMENSIONS:
            have = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("p")).alias("have"))
            now = now.join(have, d).join(wanted[d], d)
            scaled = F.when((F.col("tokens") > 0) & (F.col("have") > 0), F.least(F.lit(1.0), F.col("p") * F.col("want") / F.col("have"))).otherwise(F.col("p"))
            now = now.withColumn("scaled", scaled)
            moved = F.greatest("moved", F.abs(F.col("scaled") - F.col("p")))
            now = now.select(*DIMENSIONS, "tokens", F.col("scaled").alias("p"), moved.alias("moved"))
        now = materialise(now, "mix-cells")
        moved, now = now.agg(F.max("moved")).first()[0], now.drop("moved")
        if moved is None or moved < TOLERANCE:
            break
    return now


def residuals(fitted: DataFrame, share: float = SHARE, given: Mapping[str, Mapping[str, float]] | None = None, powers: Mapping[str, float] = POWERS) -> DataFrame:
    """(dimension, value, tokens, target, expected, off) of fitted cells (with p): off is the share of the target that is missing or too much."""
    parts = []
    for d in DIMENSIONS:
        got = fitted.groupBy(d).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("p")).alias("expected")).join(_wanted(fitted, d, share, given, powers), d)
        off = F.when(F.col("want") > 0, F.abs(F.col("expected") - F.col("want")) / F.col("want")).otherwise(F.when(F.col("expected") > 0, 1.0).otherwise(0.0))
        parts.append(got.select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "tokens", F.col("want").alias("target"), "expected", off.alias("off")))
    return reduce(DataFrame.unionByName, parts)


def _rows_and_cells(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """docs with their cell and tokens, the table of cells, and the names of the cell's columns and of the tokens in docs."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    *keys, tokens = fresh(docs.columns, *(f"_mix_{x}" for x in (*DIMENSIONS, "tokens")))
    rows = docs.withColumn(tokens, token_count(F.col("text")))
    topic = named("topic") if "topic" in docs.columns else topic_of(F.coalesce(F.col("text"), F.lit("")), F.col(tokens))
    rows = rows.withColumns(dict(zip(keys, (named("source"), named("lang"), topic))))
    cells = rows.groupBy(*(F.col(k).alias(d) for k, d in zip(keys, DIMENSIONS))).agg(F.sum(tokens).alias("tokens"))
    return rows, materialise(cells, "mix-cells"), [*keys, tokens]


def _fit(cells: DataFrame, share: float, targets: Mapping[str, Mapping[str, float]] | None, max_cells: int) -> tuple[DataFrame, bool]:
    """The cells with p, and whether they are few."""
    if cells.count() > max_cells:
        return rake_frame(cells, share, targets), False
    got = [tuple(r) for r in cells.orderBy(*DIMENSIONS).collect()]
    columns = {d: pa.array([c[i] for c in got], pa.string()) for i, d in enumerate(DIMENSIONS)}
    columns |= {"tokens": pa.array([c[3] for c in got], pa.int64()), "p": pa.array(rake(got, share, targets), pa.float64())}
    return cells.sparkSession.createDataFrame(pa.table(columns)), True


def mix_report(docs: DataFrame, *, share: float = SHARE, targets: Mapping[str, Mapping[str, float]] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """What each source, language and topic is to give and gives, in tokens; see ``residuals``."""
    return residuals(_fit(_rows_and_cells(docs)[1], share, targets, max_cells)[0], share, targets)


def mix_sources(
    docs: DataFrame,
    *,
    share: float = SHARE,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    seed: int = 42,
    max_cells: int = MAX_CELLS,
    strict: bool = False,
    name: str = "mix",
) -> DataFrame:
    """docs with a struct, ``mix`` unless it is given another name: source, lang, topic, n_tokens, weight, probability, sampled.

    Targets that can't be met are warned of, or with ``strict`` refused.
    """
    rows, cells, (*keys, tokens) = _rows_and_cells(docs)
    (p,) = fresh(rows.columns, "_mix_p")
    text = F.coalesce(F.col("text"), F.lit(""))
    fitted, few = _fit(cells, share, targets, max_cells)
    missed = residuals(fitted, share, targets).where(F.col("off") > OFF).orderBy(F.desc("off")).limit(5).collect()
    if missed:
        said = ", ".join(f"{r['dimension']} {r['value']} by {100 * r['off']:.1f} %" for r in missed)
        if strict:
            raise ValueError(f"targets that can't be met: {said}")
        warnings.warn(f"targets that can't be met: {said}", stacklevel=2)
    fitted = (F.broadcast(fitted) if few else fitted).select(*(F.col(d).alias(k) for k, d in zip(keys, DIMENSIONS)), F.col("p").alias(p))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), text), F.lit(1 << 53)) / F.lit(float(1 << 53))
    mix = F.struct(
        *(F.col(k).alias(d) for k, d in zip(keys, DIMENSIONS)),
        F.col(tokens).alias("n_tokens"),
        (F.col(p) / F.lit(share)).alias("weight"),
        F.col(p).alias("probability"),
        (drawn < F.col(p)).alias("sampled"),
    )
    return rows.join(fitted, keys).select(*(F.col(f"`{c}`") for c in docs.columns if c != name), mix.alias(name))
