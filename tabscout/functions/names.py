"""Rules on column names, written as expressions over a name column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabscout.functions import words as w


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_tokens(c: Column | str) -> Column:
    """Lower-cased alphanumeric pieces of a name."""
    return F.array_remove(F.split(F.lower(_as_col(c)), "[^a-z0-9]+"), "")


def name_has(c: Column | str, words: Iterable[str]) -> Column:
    """A piece equals one of the words, or a word of five or more letters is inside."""
    words = list(words)
    whole = F.arrays_overlap(name_tokens(c), F.array(*[F.lit(x) for x in words]))
    inside = [x for x in words if len(x) > 4]
    if not inside:
        return whole
    return whole | F.lower(_as_col(c)).rlike("|".join(inside))


def name_is_id(c: Column | str) -> Column:
    low = F.lower(F.trim(_as_col(c)))
    known = F.arrays_overlap(name_tokens(c), F.array(*[F.lit(x) for x in w.ID_WORDS]))
    return known | low.endswith("id") | low.startswith("id_")


def name_is_bad_axis(c: Column | str) -> Column:
    return name_is_id(c) | name_has(c, w.BAD_AXIS_WORDS)


def human_label(c: Column | str) -> Column:
    """Reader-friendly label, at most 64 characters."""
    text = F.trim(F.regexp_replace(F.trim(_as_col(c)), r"[_\-\s]+", " "))
    squeezed = F.lower(F.replace(text, F.lit(" "), F.lit("")))

    def word(x: Column) -> Column:
        shout = (F.length(x) <= 2) & (x == F.upper(x)) & (x != F.lower(x))
        capital = F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1000)))
        return F.when(F.lower(x).isin(*w.UPPER_WORDS), F.upper(x)).when(shout, x).otherwise(capital)

    label = F.substring(F.array_join(F.transform(F.split(text, " "), word), " "), 1, 64)
    fixed = F.create_map(*[F.lit(x) for pair in w.LABEL_FIXES.items() for x in pair])
    return F.coalesce(F.try_element_at(fixed, squeezed), label)


def default_agg(c: Column | str) -> Column:
    """Which aggregate suits a measure of this name: sum, mean or median."""
    return (
        F.when(name_has(c, w.SUM_WORDS), "sum")
        .when(name_has(c, w.MEAN_WORDS), "mean")
        .when(name_has(c, w.MEDIAN_WORDS), "median")
        .otherwise("mean")
    )


def agg_label(agg: Column | str) -> Column:
    """Reader-facing word for an aggregate."""
    agg = _as_col(agg)
    return F.when(agg == "sum", "Total").when(agg == "median", "Typical").otherwise("Average")
