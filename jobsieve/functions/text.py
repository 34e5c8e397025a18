"""Text expressions: fold/tokens (P10, P11), list/bool/timestamp parsing (S3-S7), URL encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c) -> Column:
    """P10: lower, German umlauts spelled out, non [a-z0-9] runs -> one space, trimmed."""
    v = F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    for src, dst in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        v = F.replace(v, F.lit(src), F.lit(dst))
    return F.trim(F.regexp_replace(v, r"[^a-z0-9]+", " "))


def tokens(c, min_len: int = 3) -> Column:
    """Distinct folded tokens of at least ``min_len`` characters (sorted, as a set)."""
    parts = F.split(fold(c), " ")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: F.length(t) >= min_len)))


def folded_tokens(folded, min_len: int = 3) -> Column:
    """P11 on text that is already folded."""
    parts = F.split(col(folded), " ")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: F.length(t) >= min_len)))


def split_list(c, sep: str = ";") -> Column:
    """S3: split on ``sep``, trim, drop blanks; null -> empty list."""
    parts = F.split(F.coalesce(col(c).cast("string"), F.lit("")), sep)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def decode_skills(c) -> Column:
    """JSON list when the text parses to a list, else ``;`` split; null/blank -> empty."""
    s = col(c).cast("string")
    as_json = F.when(F.trim(s).startswith("["), F.from_json(s, "array<string>"))
    return F.coalesce(as_json, split_list(s))


def encode_skills(c) -> Column:
    """S4 inverse: list -> compact JSON text; empty/null -> null."""
    return F.when(F.size(col(c)) > 0, F.to_json(col(c)))


def parse_bool(c, default: bool) -> Column:
    """``1/true/yes/y`` (case-insensitive) is true; null -> ``default``."""
    v = F.lower(F.trim(col(c).cast("string")))
    return F.when(col(c).isNull(), F.lit(default)).otherwise(v.isin("1", "true", "yes", "y"))


def parse_timestamp(c) -> Column:
    """ISO text with optional ``Z``/offset; naive -> UTC (session zone); bad text -> null."""
    s = F.trim(col(c).cast("string"))
    s = F.regexp_replace(s, "Z$", "+00:00")
    s = F.regexp_replace(s, "T", " ")
    return F.coalesce(
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSXXX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ssXXX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd")),
    )


def infer_city(location) -> Column:
    """Text before the first comma, trimmed; blank -> null."""
    return F.nullif(F.trim(F.split_part(F.coalesce(col(location), F.lit("")), F.lit(","), F.lit(1))), F.lit(""))


def infer_country(location, default: str = "Germany") -> Column:
    """Text after the last comma when there is a comma, else ``default``."""
    loc = F.coalesce(col(location), F.lit(""))
    last = F.trim(F.split_part(loc, F.lit(","), F.lit(-1)))
    return F.when(loc.contains(",") & (last != ""), last).otherwise(F.lit(default))


def quote_plus(c) -> Column:
    """``urllib.parse.quote_plus``: Java's form encoder differs only on ``*`` and ``~``."""
    e = F.url_encode(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.replace(F.replace(e, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def contains_ci(c, needle: str) -> Column:
    """Case-insensitive literal substring test (no LIKE wildcards); null value -> false."""
    return F.coalesce(F.lower(col(c).cast("string")).contains(needle.strip().lower()), F.lit(False))
