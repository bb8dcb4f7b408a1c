"""Column functions: names, tags, lists, hashes and formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens read as true, and as missing.
TRUE_TOKENS = ("1", "true", "t", "yes", "y")
MISSING_TOKENS = ("", "na", "nan", "none", "null")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_name(x: Column | str) -> Column:
    """Without a last -1, then without a last .1, and with - for other points. Other numbers tell rows apart and stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(x), r"-1$", ""), r"\.1$", ""), r"\.", "-")


def tag(x: Column | str) -> Column:
    """Runs of other characters than letters and digits become one _, none at either end."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")


def fraction_tag(x: Column | str) -> Column:
    """0.1 as frac0_10."""
    return F.concat(F.lit("frac"), F.regexp_replace(F.format_string("%.2f", _c(x).cast("double")), r"\.", "_"))


def header_key(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", "")


def is_missing(x: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_c(x))).isin(*MISSING_TOKENS), F.lit(True))


def truthy(x: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_c(x))).isin(*TRUE_TOKENS), F.lit(False))


def split_list(x: Column | str) -> Column:
    """Parts between ; , or |, trimmed, without missing tokens."""
    parts = F.transform(F.split(_c(x), r"[;,|]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: ~F.lower(p).isin(*MISSING_TOKENS))


def year_in(x: Column | str, most: int = 4) -> Column:
    """The first number of four digits; with `most`, of up to so many digits, all of them taken."""
    return F.try_to_number(F.nullif(F.regexp_extract(_c(x), rf"(\d{{4,{most}}})", 1), F.lit("")), F.lit("9" * most)).cast("int")


def ontology_id(x: Column | str) -> Column:
    """The id as CL:ddddddd; NULL if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(_c(x), r"(CL[_:]\d{7})", 1), "_", ":"), F.lit(""))


def list_md5(items: Column | str, trailing_newline: bool = False) -> Column:
    """MD5 of the items joined by newlines, in their order; with or without a newline after the last."""
    text = F.array_join(_c(items), "\n")
    return F.md5(F.concat(text, F.lit("\n")) if trailing_newline else text)


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the compact JSON of the columns in the order of their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def remap(x: Column | str, pool: Mapping[str, str], rename: Mapping[str, str]) -> Column:
    """Pooled, then renamed; what is in neither map stays."""

    def through(c: Column, names: Mapping[str, str]) -> Column:
        out = c
        for old, new in names.items():
            out = F.when(c == old, F.lit(new)).otherwise(out)
        return out

    return through(through(_c(x), pool), rename)


def natural_key(x: Column | str) -> Column:
    """Sorts names by the text before their first number, then the number, then all of the name."""
    number = F.try_to_number(F.nullif(F.substring(F.regexp_extract(_c(x), r"(\d+)", 1), 1, 18), F.lit("")), F.lit("9" * 18))
    return F.struct(F.regexp_extract(_c(x), r"^(\D*)", 1), number, _c(x))


def mean_sd(mean: Column | str, sd: Column | str, digits: int = 3) -> Column:
    """mean ± sd, or the mean alone where sd is NULL."""
    m = F.format_string(f"%.{digits}f", _c(mean))
    return F.when(_c(sd).isNull(), m).otherwise(F.concat(m, F.lit(" ± "), F.format_string(f"%.{digits}f", _c(sd))))


def signed(x: Column | str, digits: int = 3) -> Column:
    return F.format_string(f"%+.{digits}f", _c(x))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """x to so many places as round() of SQL engines gives it: halves go away from 0, and what becomes 0 keeps its sign, which F.round drops."""
    x, unit = _c(x), F.lit(10.0**digits)
    return F.when(F.abs(x * unit) < 0.5, x * 0.0).when(F.abs(x * unit) == float("inf"), x).otherwise(F.round(x * unit) / unit)


def leading(vector: Column | str, n: int) -> Column:
    """The first n components."""
    return F.slice(_c(vector), 1, n)


def run_stamp(ts: Column | str) -> Column:
    """A UTC time as yyyymmddThhmmssZ."""
    return F.date_format(_c(ts), "yyyyMMdd'T'HHmmss'Z'")


def pick(vector: Column | str, positions: list[int]) -> Column:
    """Components at positions (from 0); a position that is not an integer, repeated or negative fails."""
    if any(not isinstance(p, int) or isinstance(p, bool) or p < 0 for p in positions) or len(set(positions)) < len(positions):
        raise ValueError("positions must be different integers from 0")
    return F.transform(F.array(*[F.lit(p) for p in positions]), lambda i: F.get(_c(vector), i))


def argmax(vector: Column | str, n: int) -> Column:
    """Place (from 0) of the largest of the first n components, the first of equals."""
    head = F.slice(_c(vector), 1, n)
    return (F.array_position(head, F.array_max(head)) - 1).cast("int")
