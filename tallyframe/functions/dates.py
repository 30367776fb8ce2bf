"""Month phrases in text, as half-open date ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and the abbreviations that are understood.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
_NAMES = "|".join(sorted(MONTHS, key=lambda name: (-len(name), name)))
MONTH_PHRASE = rf"(?i)(?<![A-Za-z0-9_])({_NAMES})\.?(\s*,\s*|\s+)([0-9]{{2,4}})(?![A-Za-z0-9_])"
_TITLES = [name.capitalize() for name in list(MONTHS)[:12]]


def month_references(text: Column) -> Column:
    """Array of month phrases: original, normalized, year, month, start_date, end_exclusive.

    A two-digit year counts only after a comma; up to 69 it lies in the 2000s.
    """
    phrases = F.regexp_extract_all(text, F.lit(MONTH_PHRASE), F.lit(0))
    parts = F.transform(phrases, lambda p: F.struct(*[F.regexp_extract(p, MONTH_PHRASE, i).alias(f"g{i}") for i in range(4)]))
    numbers = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    titles = F.array(*[F.lit(t) for t in _TITLES])

    def resolve(m: Column) -> Column:
        digits, year = F.length(m["g3"]), m["g3"].cast("int")
        century = F.when(year <= 69, 2000 + year).otherwise(1900 + year)
        full = F.when((digits == 4) & (year > 0), year).when((digits == 2) & m["g2"].contains(","), century)
        month = F.element_at(numbers, F.lower(m["g1"]))
        start = F.make_date(full, month, F.lit(1))
        return F.struct(
            m["g0"].alias("original"),
            F.concat_ws(" ", F.element_at(titles, month), full.cast("string")).alias("normalized"),
            full.alias("year"),
            month.alias("month"),
            start.alias("start_date"),
            F.add_months(start, 1).alias("end_exclusive"),
        )

    return F.filter(F.transform(parts, resolve), lambda r: r["year"].isNotNull())


def normalize_months(text: Column, references: Column) -> Column:
    """Rewrite each month phrase in the text to "Month YYYY"."""
    return F.aggregate(references, text, lambda t, r: F.replace(t, r["original"], r["normalized"]))
