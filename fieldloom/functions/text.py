"""Names, dates and fingerprints of a catalogue, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def photo_date(name: Column) -> Column:
    """ISO date of the first run of exactly eight digits, read as DDMMYYYY; null without one, or where its day or month is out of range. Not checked against a calendar."""
    day, month, year = (F.regexp_extract(name, r"(?<![0-9])([0-9]{2})([0-9]{2})([0-9]{4})(?![0-9])", i) for i in (1, 2, 3))
    return F.when(day.between("01", "31") & month.between("01", "12"), F.concat_ws("-", year, month, day))


def years_in_name(name: Column) -> Column:
    """Distinct years 19xx and 20xx that stand alone in a name, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(name, F.lit("(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"), F.lit(0)), lambda y: y.cast("int"))))


def derived_year(date: Column, years: Column) -> Column:
    """The date's year, else the smallest in the name."""
    return F.coalesce(F.substring(date, 1, 4).cast("int"), F.get(years, F.lit(0)))


def safe_stem(name: Column) -> Column:
    """A name with everything but letters, digits and . _ - replaced by _."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def head_hash(content: Column, nbytes: int = 8 << 20) -> Column:
    """First 16 hex digits of sha256 over the first bytes and the size."""
    size = F.octet_length(content).cast("string")
    return F.substring(F.sha2(F.concat(F.substring(content, 1, nbytes), F.encode(size, "UTF-8")), 256), 1, 16)


def url_quote(text: Column) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.regexp_replace(F.url_encode(text), r"\+", "%20")
