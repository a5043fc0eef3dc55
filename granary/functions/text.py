"""Scalar text rules: codes, names, branches, delivery days, cities, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weekday names, Monday first.
WEEKDAYS = ["Senin", "Selasa", "Rabu", "Kamis", "Jumat", "Sabtu", "Minggu"]


def strip_ends(x: Column) -> Column:
    """Drop white space of any kind at both ends (trim drops blanks only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def parse_date(x: Column) -> Column:
    """'01 Jan 2024' to a date."""
    return F.to_date(strip_ends(x), "d MMM yyyy")


def parse_quantity(x: Column) -> Column:
    """A number with a comma or a dot as its decimal mark."""
    return F.replace(strip_ends(x), F.lit(","), F.lit(".")).cast("double")


def strip_prefix(x: Column) -> Column:
    """Drop one leading 'xxx.' of a retired code or name."""
    return F.regexp_replace(x, r"(?iU)^xxx\.\s*", "")


def unify_separator(x: Column) -> Column:
    """A dot between a letter and a digit becomes a hyphen."""
    return F.regexp_replace(x, r"(?<=[A-Za-z])\.(?=[0-9])", "-")


def comparable_name(x: Column) -> Column:
    """A name for comparison: no prefix, no closing parenthesis, single blanks, digits set off from units."""
    x = F.regexp_replace(strip_prefix(x), r"(?U)\s*\([^)]*\)\s*$", "")
    x = F.regexp_replace(x, r"(?<=[0-9])(?=[a-z])", " ")
    return strip_ends(F.regexp_replace(x, r"(?U)\s+", " "))


def branch_needle(x: Column) -> Column:
    """A branch name for matching: no 'KY<n> - ' in front, no closing parenthesis."""
    x = F.regexp_replace(x, r"(?iU)^KY\d+\s*-\s*", "")
    return strip_ends(F.regexp_replace(x, r"(?U)\s*\([^)]*\)\s*$", ""))


def delivery_days(x: Column) -> Column:
    """'Senin dan Kamis' or 'Senin, Kamis' to weekday numbers (Monday 0); an unknown name raises."""
    names = F.filter(F.transform(F.split(x, r"(?U)\s+dan\s+|,"), strip_ends), lambda d: d != "")
    number = F.create_map(*[F.lit(v) for i, d in enumerate(WEEKDAYS) for v in (d, i)])
    known = lambda d: F.coalesce(F.try_element_at(number, d), F.raise_error(F.concat(F.lit("unknown weekday: "), d)).cast("int"))
    return F.array_sort(F.array_distinct(F.transform(names, known)))


def city(override: Column, recorded: Column) -> Column:
    """The override unless blank, else the recorded city, else 'Unknown'."""
    return F.coalesce(F.nullif(strip_ends(override), F.lit("")), strip_ends(recorded), F.lit("Unknown"))


def yes(x: Column) -> Column:
    """'Yes' to true, any other text to false, null to null."""
    return F.lower(strip_ends(x)) == "yes"


def truth(x: Column) -> Column:
    """'true' in any case to true."""
    return F.lower(strip_ends(x.cast("string"))) == "true"
