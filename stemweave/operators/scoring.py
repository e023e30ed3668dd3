"""Scoring, weighting and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored_few


def composite_score(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of named score columns; a missing score counts 0."""
    total = F.lit(0.0)
    for name in sorted(weights):
        total = total + F.coalesce(parts[name], F.lit(0.0)) * weights[name]
    return total


def eligible(culture: Column | None = None, era: Column | None = None, tags: Column | None = None, *, cultures: list[str] | None = None, latest: int | None = None, required: list[str] = (), excluded: list[str] = ()) -> Column:
    """The conjunction of the gates that are given.  A missing culture or era passes; missing tags count as none."""
    ok = F.lit(True)
    if cultures is not None:
        ok = ok & (culture.isNull() | culture.isin(cultures))
    if latest is not None:
        ok = ok & (era.isNull() | (era <= latest))
    have = F.coalesce(tags, F.array().cast("array<string>")) if tags is not None else None
    if required:
        ok = ok & (F.size(F.array_except(F.array(*map(F.lit, required)), have)) == 0)
    if excluded:
        ok = ok & ~F.arrays_overlap(have, F.array(*map(F.lit, excluded)))
    return ok


def allocate_frequency(df: DataFrame, surface: str, score: str, freq: str, out: str = "weight") -> DataFrame:
    """A surface's frequency shared out by score, evenly where all scores are zero; surfaces without positive frequency go.

    Negative scores are dropped before; zero scores stay.
    """
    w = Window.partitionBy(surface)
    kept = df.where((F.col(score) >= 0) & (F.col(freq) > 0))
    total, n = F.sum(score).over(w), F.count("*").over(w)
    return kept.withColumn(out, F.when(total > 0, F.col(freq) * F.col(score) / total).otherwise(F.col(freq) / n))


def cohesion_reweight(df: DataFrame, group: str, weight: str, raw: str, c: float) -> DataFrame:
    """Weights times ``(1 - c) + c * raw / mean(raw)`` within a group; unchanged where all raw values are zero."""
    mean = F.avg(raw).over(Window.partitionBy(group))
    return df.withColumn(weight, F.when(mean > 0, F.col(weight) * ((1 - c) + c * F.col(raw) / mean)).otherwise(F.col(weight)))


def novelty_blend(df: DataFrame, group: str, weight: str, novelty: float) -> DataFrame:
    """``(1 - n) * w / sum(w) + n / N`` within a group."""
    w = Window.partitionBy(group)
    share = F.col(weight) / F.nullif(F.sum(weight).over(w), F.lit(0))
    return df.withColumn(weight, (1 - novelty) * F.coalesce(share, F.lit(0.0)) + novelty / F.count("*").over(w))


CELLS = 1024


def weighted_choice(weights: DataFrame, draws: DataFrame, group: str, key: str, weight: str, u: str, few: bool = False) -> DataFrame:
    """For each draw ``u`` in [0, 1) the first key whose cumulative share exceeds it; zero weights are never drawn, and
    a group without positive weights gives null.

    Shares are intervals of [0, 1), dealt with the draws into cells of equal width, so draws of one group meet its keys in as many tasks.
    With ``few`` the intervals are written and counted, and broadcast if they are few, so the draws stay where they are.
    """
    live = weights.where(F.col(weight) > 0)
    order = Window.partitionBy(group).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(weight).over(Window.partitionBy(group))
    spans = live.select(F.col(group).alias("_g"), F.col(key).alias("chosen"), F.sum(weight).over(order).alias("_hi"), F.col(weight).alias("_w"), total.alias("_t"))
    cell = lambda c: F.floor(c / F.col("_t") * CELLS)
    low = F.lag("_hi", 1, 0).over(Window.partitionBy("_g").orderBy("chosen"))
    # a cell more on both sides makes up for rounding; the test below is exact
    spans = spans.withColumn("_lo", low).withColumn("_cell", F.explode(F.sequence(F.greatest(cell(F.col("_lo")) - 1, F.lit(0)), cell(F.col("_hi")) + 1))).drop("_w")
    spans = stored_few(spans) if few else spans
    dealt = draws.withColumn("_cell", F.floor(F.col(u) * CELLS))
    at = F.col(u) * F.col("_t")
    return dealt.join(spans, (dealt[group] == spans["_g"]) & (dealt["_cell"] == spans["_cell"]) & (F.col("_lo") <= at) & (at < F.col("_hi")), "left").drop("_g", "_hi", "_t", "_lo", "_cell")


def seeded(seed: int, *cols: Column) -> Column:
    """A digest of a seed and a row's key, to order rows at random but repeatably."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hashed_uniform(seed: int, *cols: Column) -> Column:
    """A deterministic draw in [0, 1) from a seed and the row's key: the first 52 bits of a digest."""
    return F.conv(F.left(seeded(seed, *cols), F.lit(13)), 16, 10).cast("long") / float(1 << 52)


def reserve_slot(df: DataFrame, group: str, capable: Column, seed: int, key: str) -> DataFrame:
    """Marks one capable row of each group, drawn by digest; groups without one are marked nowhere."""
    rank = F.row_number().over(Window.partitionBy(group, "_ok").orderBy(seeded(seed, F.col(key)), key))
    return df.withColumn("_ok", F.coalesce(capable, F.lit(False))).withColumn("reserved", F.col("_ok") & (rank == 1)).drop("_ok")


def resolve_repeats(df: DataFrame, request: str, slot: str, key: str, synonyms: DataFrame) -> DataFrame:
    """The second and later use of a key within a request gets the key's synonym where there is one, else it stays."""
    again = F.row_number().over(Window.partitionBy(request, key).orderBy(slot)) > 1
    marked = df.withColumn("_again", again).join(synonyms.withColumnRenamed("key", key), key, "left")
    return marked.withColumn("final", F.when(F.col("_again"), F.coalesce("synonym", key)).otherwise(F.col(key))).drop("_again", "synonym")
