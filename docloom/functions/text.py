"""Text columns: strip, previews, paths, keyword tests, whitespace tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.strip() removes, as a regex class
# that Java and RE2 read alike.
WHITE_SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` removes spaces only)."""
    return F.regexp_replace(F.regexp_replace(text, f"^{WHITE_SPACE}+", ""), f"{WHITE_SPACE}+$", "")


def contains_any(text: Column, needles: list[str]) -> Column:
    """True when any needle is a substring of the lower-cased text."""
    return any_contained(F.lower(text), needles)


def any_contained(lowered: Column, needles: list[str]) -> Column:
    """True when any needle is a substring of the already lower-cased text."""
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(n)) for n in needles])


def count_contained(lowered: Column, needles: list[str]) -> Column:
    """How many of the needles occur in the already lower-cased text."""
    return reduce(
        lambda a, b: a + b, [F.contains(lowered, F.lit(n)).cast("int") for n in needles]
    )


def preview(text: Column, n: int) -> Column:
    """First ``n`` characters, with ``...`` only when something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def preview_always(text: Column, n: int) -> Column:
    """First ``n`` characters, always followed by ``...``."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def one_line(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    """The part before the last slash; empty when there is none."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def url_prefix(url: Column, marker: str) -> Column:
    """The part of ``url`` before ``marker`` (the whole url when it is absent)."""
    return F.split_part(url, F.lit(marker), F.lit(1))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^:/?#]+)", 1)


def swap_host(url: Column, host: str) -> Column:
    """Replace the host and keep scheme, port, path, query and fragment."""
    return F.regexp_replace(url, r"^(https?://)[^:/?#]+", "$1" + host)


def tokens(text: Column) -> Column:
    """Non-empty runs between white space."""
    return F.array_remove(F.split(text, r"\s+"), "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a column.

    Catalyst inlines a projected expression into a higher-order function that
    uses it, and would then evaluate it once per array element. Binding it as
    the variable of a one-element ``transform`` keeps it at one evaluation.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def numbered_rows(df: DataFrame, keep: list, array: Column, pos: str, value: str) -> DataFrame:
    """One row per array element with its 0-based position.

    For arrays that are costly to compute: a plain ``posexplode`` makes
    Catalyst infer a non-empty filter that computes the array a second time.
    """
    exploded = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return exploded.where(F.col(pos).isNotNull())


def number_text(value: Column) -> Column:
    """Thousands-separated integer."""
    return F.format_number(value, 0)
