"""Seed-aligned aggregation, deltas, screens and selections over result rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def seed_stats(df: DataFrame, keys: Sequence[str], value: str, *, single_sd: float | None = 0.0) -> DataFrame:
    """keys, n, mean, sd (sample), min, max; single_sd is the sd of one value (0 or None)."""
    sd = F.stddev_samp(value)
    if single_sd is not None:
        sd = F.coalesce(sd, F.lit(float(single_sd)))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def macro_by_seed(df: DataFrame, seed: str, levels: Sequence[str], value: str) -> DataFrame:
    """seed, value: within a seed the mean of each innermost level, then of those in each outer one, outermost all alike. levels: outermost first."""
    out = df
    for depth in range(len(levels), -1, -1):
        out = out.groupBy(seed, *levels[:depth]).agg(F.avg(value).alias(value))
    return out


def paired_delta(rows: DataFrame, keys: Sequence[str], method: str, before: str, after: str, values: Sequence[str]) -> DataFrame:
    """keys and delta_<value>, after minus before; both sides must be there, else the delta is NULL and `complete` false."""
    sides = [rows.filter(F.col(method) == m).select(*keys, *(F.col(v).alias(f"{p}_{v}") for v in values), F.lit(True).alias(f"has_{p}")) for m, p in ((before, "b"), (after, "a"))]
    both = sides[0].join(sides[1], list(keys), "full_outer")
    return both.select(*keys, *((F.col(f"a_{v}") - F.col(f"b_{v}")).alias(f"delta_{v}") for v in values), (F.col("has_a").isNotNull() & F.col("has_b").isNotNull()).alias("complete"))


def sign_of(delta: str | Column, tolerance: float = TOLERANCE) -> Column:
    """-1, 0 or 1; 0 within the tolerance."""
    x = F.col(delta) if isinstance(delta, str) else delta
    return F.when(x > tolerance, 1).when(x < -tolerance, -1).when(x.isNotNull(), 0)


def sign_counts(deltas: DataFrame, seed: str, grid: str, anchor: float, delta: str) -> DataFrame:
    """positive, zero and negative deltas, and flips: signs opposite to the same seed's sign at the anchor."""
    at = F.max(F.when(F.col(grid) == F.lit(anchor), F.col("sign"))).over(Window.partitionBy(seed))
    marked = deltas.withColumn("sign", sign_of(delta)).withColumn("anchor_sign", at)
    return marked.agg(
        F.count_if(F.col("sign") > 0).alias("positive"),
        F.count_if(F.col("sign") == 0).alias("zero"),
        F.count_if(F.col("sign") < 0).alias("negative"),
        F.count_if(F.col("sign") * F.col("anchor_sign") < 0).alias("flips"),
    )


def count_match(candidates: DataFrame, seed: str, grid: str, count: str, target: Column | int, anchor: str = "0.5") -> DataFrame:
    """The candidate of each seed with the least (|count - target|, |grid - anchor| in decimals, grid). A grid value that a seed has twice, none, or one that isn't above 0 fails."""
    wrong = (F.countDistinct(grid) != F.count("*")) | ~F.bool_and(F.coalesce(F.col(grid).cast("double") > 0, F.lit(False)))
    exact = F.col(grid).cast("decimal(18,6)")
    key = F.struct(F.abs(F.col(count) - target), F.abs(exact - F.lit(anchor).cast("decimal(18,6)")), exact)
    best = F.when(wrong, F.raise_error(F.lit("a seed has a repeated or invalid grid value"))).otherwise(F.min_by(F.struct(grid, count), key))
    return candidates.groupBy(seed).agg(best.alias("best")).select(seed, f"best.{grid}", f"best.{count}")


def harm_screen(rows: DataFrame, keys: Sequence[str], seed: str, floors: Mapping[str, float], gains: Sequence[str], seeds: Sequence[int], least_positive: int = 4) -> DataFrame:
    """keys, n_seeds, issues (sorted), verdict: passed only if all seeds are there, once each, no value is below its floor, and each gain is positive in enough seeds and on average."""
    expected = len(set(seeds))
    found = F.countDistinct(F.when(F.col(seed).isin(list(seeds)), F.col(seed)))
    once = F.count_if(F.col(seed).isin(list(seeds))) == found
    checks = [F.when((found != expected) | ~once, "incomplete"), *(F.when(~F.bool_and(F.coalesce(F.col(c) >= f, F.lit(False))), f"{c} below floor") for c, f in sorted(floors.items()))]
    for g in gains:
        checks += [F.when(F.count_if(F.col(g) > 0) < least_positive, f"{g} positive in too few"), F.when(F.coalesce(F.avg(g) <= 0, F.lit(True)), f"{g} mean not positive")]
    out = rows.groupBy(*keys).agg(found.alias("n_seeds"), F.array_sort(F.array_compact(F.array(*checks))).alias("issues"))
    return out.withColumn("verdict", F.when(F.size("issues") == 0, "passed").when(F.array_contains("issues", "incomplete"), "incomplete").otherwise("failed"))


#: The outcomes of `mixing_screen`.
HARM, CLEAN, PENDING, CANDIDATE, NO_GAIN = "tradeoff_or_harm_flagged", "clean_control_no_flagged_harm_not_a_benefit_claim", "mixing_interpretation_pending", "candidate_at_fixed_anchor_only", "no_screened_mixing_gain"


def mixing_screen(rows: DataFrame, keys: Sequence[str], seed: str, floors: Mapping[str, float], gain: str, batches: str, interpretable: str, seeds: Sequence[int], rare: str | None = None, rare_floor: float = -0.05, least_gain: float = 0.02, least_positive: int = 4) -> DataFrame:
    """keys, n_harms, mean_gain, outcome of a panel of one row a seed.

    `invalid` if a seed is missing, repeated or foreign, a value is null, not finite or above 2,
    the rows differ in their rare groups, or a gain is missing that the panel needs; else
    HARM if a value, or one of the rare groups' in the map `rare`, is below its floor;
    CLEAN for a single batch; PENDING where mixing can't be interpreted; CANDIDATE if the
    gain is at least `least_gain` on average and above 0 for `least_positive` seeds; else NO_GAIN.
    """

    def sound(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x) <= 2), F.lit(False))

    values = [(F.col(c).cast("double"), floor) for c, floor in sorted(floors.items())]
    groups = F.map_values(rare) if rare else F.array().cast("array<double>")
    ok = F.lit(True)
    for x, _ in values:
        ok = ok & sound(x)
    ok = ok & F.coalesce(F.forall(groups, sound), F.lit(False))
    harms = sum((F.coalesce(x < floor, F.lit(False)).cast("long") for x, floor in values), F.lit(0).cast("long")) + F.coalesce(F.size(F.filter(groups, lambda x: x < rare_floor)), F.lit(0))
    names = F.array_sort(F.map_keys(rare)) if rare else F.array().cast("array<string>")
    mixed = F.coalesce((F.col(batches) > 1) & F.col(interpretable), F.lit(False))
    g = F.col(gain).cast("double")
    each = rows.select(*keys, F.col(seed).alias("s"), (ok & (~mixed | sound(g))).alias("ok"), harms.alias("harms"), names.alias("names"), F.when(mixed, g).alias("g"), mixed.alias("mixed"), F.col(batches).alias("b"), F.col(interpretable).alias("i"))
    known = list(seeds)
    valid = (F.count("*") == len(known)) & (F.countDistinct(F.when(F.col("s").isin(known), F.col("s"))) == len(known)) & F.bool_and("ok") & (F.countDistinct("names") == 1) & (F.min("b") == F.max("b")) & F.bool_and(F.col("b") >= 1) & F.bool_and((F.col("b") > 1) | ~F.col("i")) & (F.min("mixed") == F.max("mixed"))
    by = each.groupBy(*keys).agg(F.coalesce(valid, F.lit(False)).alias("valid"), F.sum("harms").alias("n_harms"), F.max("b").alias("b"), F.bool_and("i").alias("i"), F.avg("g").alias("mean_gain"), F.count_if(F.col("g") > 0).alias("positive"))
    gained = (F.col("mean_gain") >= least_gain) & (F.col("positive") >= least_positive)
    outcome = F.when(~F.col("valid"), "invalid").when(F.col("n_harms") > 0, HARM).when(F.col("b") == 1, CLEAN).when(~F.col("i"), PENDING).when(gained, CANDIDATE).otherwise(NO_GAIN)
    return by.select(*keys, "n_harms", "mean_gain", outcome.alias("outcome"))


def f_tail(f: str | Column, df1: str | Column, df2: str | Column) -> Column:
    """P(F > f) by `f_survival`, for the few rows of a result table; NULL where one of the three is."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna([p, q, r]).any() else f_survival(float(p), float(q), float(r)) for p, q, r in zip(x, a, b, strict=True)], dtype="float64")

    return tail(*(F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (f, df1, df2)))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way: f, df_between, df_within, eta2, omega2."""
    by = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss"))
    s = by.agg(F.count("*").alias("k"), F.sum("n").alias("t"), F.sum("ss").alias("ssw"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"))
    k, t, ssw = F.col("k"), F.col("t"), F.col("ssw")
    ssb = F.col("nmm") - F.col("nm") * F.col("nm") / t
    msw = ssw / F.nullif(t - k, F.lit(0.0))
    return s.select((ssb / F.nullif(k - 1, F.lit(0)) / F.nullif(msw, F.lit(0.0))).alias("f"), (k - 1).alias("df_between"), (t - k).cast("long").alias("df_within"), (ssb / F.nullif(ssb + ssw, F.lit(0.0))).alias("eta2"), ((ssb - (k - 1) * msw) / F.nullif(ssb + ssw + msw, F.lit(0.0))).alias("omega2"))


def f_survival(f: float, df1: float, df2: float) -> float:
    """P(F > f) by the continued fraction of the regularised incomplete beta function."""
    from math import exp, lgamma, log

    if f <= 0:
        return 1.0
    x, a, b = df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + step * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + step / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return h

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if 0 < x < 1 else 0.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * fraction(b, a, 1 - x) / b


def sweep_summary(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, metric, n, mean, sd (sample) of each of the values."""
    long = df.select(*keys, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(list(keys), list(values), "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def label_free_k(partitions: DataFrame, seed: str, cluster: str) -> DataFrame:
    """Median over seeds of the number of clusters."""
    return partitions.groupBy(seed).agg(F.countDistinct(cluster).alias("k")).agg(F.percentile("k", 0.5).alias("k"))


def missing_units(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that are not in actual."""
    return expected.select(*keys).distinct().join(actual.select(*keys).distinct(), list(keys), "left_anti")


def convergence_gate(series: DataFrame, keys: Sequence[str], step: str, value: str, tolerance: float) -> DataFrame:
    """Each step with its relative change against one and two steps before; stops: either is within the tolerance."""
    w = Window.partitionBy(*keys).orderBy(step)

    def change(back: int) -> Column:
        old = F.lag(value, back).over(w)
        return F.abs(F.col(value) - old) / F.nullif(F.abs(old), F.lit(0.0))

    out = series.withColumn("change_1", change(1)).withColumn("change_2", change(2))
    return out.withColumn("stops", F.coalesce((F.col("change_1") <= tolerance) | (F.col("change_2") <= tolerance), F.lit(False)))


def rank_rows(df: DataFrame, orders: Sequence[tuple[str, bool]], name: str = "position") -> DataFrame:
    """Leaderboard: rows numbered by (column, descending?) in turn, NaN taken as NULL and NULL last."""
    by = []
    for c, down in orders:
        x = F.nanvl(c, F.lit(None).cast("double")) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)
        by.append(x.desc_nulls_last() if down else x.asc_nulls_last())
    return df.withColumn(name, F.row_number().over(Window.orderBy(*by)))


def classify_crossover(rows: DataFrame, keys: Sequence[str], score: str, targets: DataFrame, tolerance: float) -> DataFrame:
    """keys and follows: the one target whose value every row of the key meets within the tolerance; `neither` or `ambiguous` otherwise. targets: keys, name, value."""
    near = rows.join(targets, list(keys)).groupBy(*keys, "name").agg(F.bool_and(F.abs(F.col(score) - F.col("value")) <= tolerance).alias("ok"))
    return near.groupBy(*keys).agg(F.when(F.count_if("ok") == 1, F.max(F.when(F.col("ok"), F.col("name")))).when(F.count_if("ok") == 0, "neither").otherwise("ambiguous").alias("follows"))


def coverage(rows: DataFrame, row: str, size: int, updates: int) -> DataFrame:
    """row and visits when `updates` batches of `size` are taken in cyclic order."""
    n = rows.count()
    starts = rows.sparkSession.range(updates).select((F.col("id") * size).alias("s"))
    visits = starts.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: (F.col("s") + j) % n)).alias(row)).groupBy(row).agg(F.count("*").alias("visits"))
    return rows.select(row).join(visits, row, "left").fillna(0, "visits")
