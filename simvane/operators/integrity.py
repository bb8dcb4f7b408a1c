"""Strict joins, audits and set operations on ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """Input that breaks a stated rule."""


def alignment_report(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """One row: n_expected, n_observed, n_missing, n_extra, duplicate keys on either side, null keys on either side."""
    sides = [d.groupBy(F.col(key).alias("k")).agg(F.count("*").alias(n)) for d, n in ((expected, "e"), (observed, "o"))]
    both = sides[0].join(sides[1], sides[0]["k"].eqNullSafe(sides[1]["k"]), "full_outer").select(F.coalesce(sides[0]["k"], sides[1]["k"]).alias("k"), "e", "o")
    known = F.col("k").isNotNull()
    return both.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("n_expected"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("n_observed"),
        F.count_if(known & F.col("e").isNotNull() & F.col("o").isNull()).alias("n_missing"),
        F.count_if(known & F.col("o").isNotNull() & F.col("e").isNull()).alias("n_extra"),
        F.count_if(known & (F.col("e") > 1)).alias("duplicate_expected"),
        F.count_if(known & (F.col("o") > 1)).alias("duplicate_observed"),
        F.coalesce(F.sum(F.when(~known, F.coalesce("e", F.lit(0)) + F.coalesce("o", F.lit(0)))), F.lit(0)).alias("null_keys"),
    )


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One-to-one join; fails unless both sides have the same keys, once each and none null."""
    r = alignment_report(left, right, key).first()
    bad = {k: v for k, v in r.asDict().items() if not k.startswith("n_e") and not k.startswith("n_o") and v}
    bad |= {k: r[k] for k in ("n_extra",) if r[k]}
    if bad:
        raise IntegrityError(f"ids don't match one to one: {bad}")
    return left.join(right, key)


def select_canonical(canonical: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of canonical whose key is wanted; an unknown wanted key fails."""
    unknown = wanted.select(key).distinct().join(canonical.select(key), key, "left_anti").limit(5).collect()
    if unknown:
        raise IntegrityError(f"unknown ids: {[r[0] for r in unknown]}")
    return canonical.join(wanted.select(key).distinct(), key, "left_semi")


def restore_order(df: DataFrame, position: str) -> DataFrame:
    return df.orderBy(position)


def fallback_join(left: DataFrame, right: DataFrame, key: str, normal: Column, value: str) -> DataFrame:
    """left with value and stage: `exact` where the key matches, `normalized` where only the normal forms do and the normal form is one row's alone on the right, `none` otherwise. normal: an expression on the column key."""
    exact = right.select(F.col(key).alias("k1"), F.col(value).alias("v1"))
    forms = right.withColumn("form", normal).groupBy("form").agg(F.count("*").alias("c"), F.max(value).alias("v2")).filter("c = 1")
    out = left.withColumn("form_", normal).join(exact, F.col(key) == F.col("k1"), "left").join(forms.select("form", "v2", F.lit(True).alias("hit")), F.col("form_") == F.col("form"), "left")
    stage = F.when(F.col("k1").isNotNull(), "exact").when(F.col("hit"), "normalized").otherwise("none")
    return out.select(*left.columns, F.when(F.col("k1").isNotNull(), F.col("v1")).otherwise(F.col("v2")).alias(value), stage.alias("stage"))


def composite_lookup(rows: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join of rows with the union of disjoint sources on all keys; blank keys, keys in two sources and rows without a match fail."""
    union = sources[0]
    for s in sources[1:]:
        union = union.unionByName(s)
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    checks = {"blank keys": rows.filter(blank), "keys in two sources": union.groupBy(*keys).count().filter("count > 1"), "rows without a match": rows.join(union, list(keys), "left_anti")}
    for what, found in checks.items():
        if found.limit(1).count():
            raise IntegrityError(what)
    return rows.join(union, list(keys))


def retained_excluded(left: DataFrame, right: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a value on the right, rows without)."""
    joined = left.join(right.select(key, value), key, "left")
    return joined.filter(F.col(value).isNotNull()), joined.filter(F.col(value).isNull()).drop(value)


def manifest_subset(rows: DataFrame, manifest: DataFrame, key: str, checked: Sequence[str]) -> DataFrame:
    """Rows listed in the manifest; a listed row that is absent or differs in a checked column fails."""
    other = manifest.select(F.col(key).alias("m_key"), *(F.col(c).alias(f"m_{c}") for c in checked))
    joined = other.join(rows, F.col("m_key") == F.col(key), "left")
    differs = F.col(key).isNull()
    for c in checked:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"m_{c}"))
    bad = joined.filter(differs).select("m_key").limit(5).collect()
    if bad:
        raise IntegrityError(f"rows of the manifest are absent or differ: {[r[0] for r in bad]}")
    return joined.select(*rows.columns)


def dependency_audit(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, n_b, sample (the smallest b): how many different b each a has."""
    return df.groupBy(a).agg(F.countDistinct(b).alias("n_b"), F.min(b).alias("sample"))


def drop_conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and value of the keys with one value only."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n"), F.min(value).alias(value)).filter("n = 1").drop("n")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """column and code: place among the sorted distinct values, from 0. Distinct values are put in one order; rows are not."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return values.withColumn("code", (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key and change (added, removed, changed) between two manifests."""
    a, b = (d.select(F.col(key).alias(f"{p}k"), F.col(value).alias(f"{p}v"), F.lit(True).alias(f"{p}h")) for d, p in ((old, "a"), (new, "b")))
    both = a.join(b, F.col("ak") == F.col("bk"), "full_outer")
    change = F.when(F.col("ah").isNull(), "added").when(F.col("bh").isNull(), "removed").when(~F.col("av").eqNullSafe(F.col("bv")), "changed")
    return both.select(F.coalesce("ak", "bk").alias(key), change.alias("change")).filter("change is not null")


def union_or_intersection(df: DataFrame, item: str, group: str, mode: str, least: int = 0) -> DataFrame:
    """item and n_groups of the union over groups, or of the intersection, which falls back to the union if it has fewer than `least` items."""
    by = df.groupBy(item).agg(F.countDistinct(group).alias("n_groups"))
    if mode == "union":
        return by
    n = df.agg(F.countDistinct(group).alias("all_groups"))
    marked = by.crossJoin(F.broadcast(n)).withColumn("in_all", F.col("n_groups") == F.col("all_groups"))
    enough = marked.agg((F.count_if("in_all") >= least).alias("enough"))
    return marked.crossJoin(F.broadcast(enough)).filter(F.col("in_all") | ~F.col("enough")).select(item, "n_groups")


def explode_match(panel: DataFrame, features: DataFrame, cls: str, terms: str, feature: str, least: int, fold_case: bool = True) -> DataFrame:
    """cls, n_found, found (sorted): terms of each class that are features, for classes with at least `least`."""
    name = F.lower if fold_case else (lambda c: F.col(c) if isinstance(c, str) else c)
    each = panel.select(cls, F.explode(terms).alias("t_")).select(cls, name("t_").alias("t_")).distinct()
    have = features.select(name(feature).alias("t_")).distinct()
    return each.join(have, "t_").groupBy(cls).agg(F.count("*").alias("n_found"), F.array_sort(F.collect_set("t_")).alias("found")).filter(F.col("n_found") >= least)


def repair_vector(vector: str) -> Column:
    """The vector with 0 for components that are null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.when(bad(x), F.lit(0.0)).otherwise(x))


def strict_vector(vector: str) -> Column:
    """The vector; a component that is null or not finite fails the query."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a vector has a component that is not finite"))).otherwise(x)


def vector_diagnostics(df: DataFrame, vector: str = "v") -> DataFrame:
    """dim, n, least, largest, constant; dim NULL: rows of zeros alone among all rows."""
    long = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    return long.groupBy("dim").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("largest"), (F.min("x") == F.max("x")).alias("constant"))


def condition_summary(df: DataFrame, by: Sequence[str], batch: str, label: str, id_col: str) -> DataFrame:
    """by, n_rows, n_batches, n_labels, top_label (the most frequent, the smallest of equals) and its rows."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("c"))
    top = counts.groupBy(*by).agg(F.min_by(F.struct(F.col(label).alias("l"), "c"), F.struct((-F.col("c")).alias("m"), F.col(label))).alias("t"))
    out = df.groupBy(*by).agg(F.count(id_col).alias("n_rows"), F.countDistinct(batch).alias("n_batches"), F.countDistinct(label).alias("n_labels"))
    out = out.join(top, list(by)) if by else out.crossJoin(top)
    return out.select(*by, "n_rows", "n_batches", "n_labels", F.col("t.l").alias("top_label"), F.col("t.c").alias("top_rows"))
