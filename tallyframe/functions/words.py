"""Tokenising and inflection rules as column expressions.

Everything here is a narrow expression: no shuffle, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words ignored by the tokeniser.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "have", "has",
    "had", "how", "what", "which", "who", "whom", "when", "where", "why", "show", "list", "give", "get", "tell", "me", "we", "us", "our", "your",
    "their", "them", "this", "that", "these", "those", "by", "for", "to", "from", "in", "on", "at", "of", "with", "without",
)

# Marks the end of an acronym so that "SKUs" is not cut into "SK" and "Us".
_MARK = "\ue000"


def split_words(text: Column) -> Column:
    """Lower-case words of a text, with camelCase and ACRONYMWord cut apart."""
    text = F.translate(F.coalesce(text, F.lit("")), _MARK, " ")
    text = F.regexp_replace(text, r"(?<![A-Za-z0-9_])([A-Z]{2,})s(?![A-Za-z0-9_])", f"$1{_MARK}s")
    text = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    text = F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.split(F.translate(F.lower(text), _MARK, ""), "[^a-z0-9]+")
    return F.filter(words, lambda w: w != "")


def _cut(token: Column, n: int) -> Column:
    return F.substring(token, F.lit(1), F.length(token) - n)


def singular(token: Column) -> Column:
    size = F.length(token)
    return (
        F.when(size <= 3, token)
        .when(token.endswith("ies") & (size > 4), F.concat(_cut(token, 3), F.lit("y")))
        .when(token.rlike("(ches|shes|sses|xes|zes)$"), _cut(token, 2))
        .when(token.endswith("s") & ~token.endswith("ss"), _cut(token, 1))
        .otherwise(token)
    )


def _kept(token: Column) -> Column:
    return (F.length(token) > 1) & ~token.isin(*STOP_WORDS)


def normalize_tokens(text: Column) -> Column:
    """Distinct tokens in first-seen order, each followed by its singular form."""
    words = F.filter(split_words(text), _kept)
    both = F.flatten(F.transform(words, lambda w: F.array(w, singular(w))))
    return F.array_distinct(F.filter(both, _kept))


def _stems(base: Column) -> Column:
    long = F.length(base) > 4
    nothing = F.array().cast("array<string>")
    ing = F.when(long & base.endswith("ing"), F.array(_cut(base, 3), F.concat(_cut(base, 3), F.lit("e"))))
    ed = F.when(long & base.endswith("ed"), F.array(_cut(base, 2), _cut(base, 1)))
    er = F.when(long & base.endswith("ers"), F.array(_cut(base, 3), _cut(base, 2))).when(
        long & base.endswith("er"), F.array(_cut(base, 2), _cut(base, 1))
    )
    found = F.coalesce(ing, ed, er, nothing)
    return F.filter(found, lambda s: F.length(s) >= 4)


def token_variants(token: Column) -> Column:
    """The token, its singular, and its -ing / -ed / -er stems with and without a final e."""
    exact = F.filter(F.array_distinct(F.array(token, singular(token))), lambda t: F.length(t) >= 3)
    return F.array_distinct(F.concat(exact, F.flatten(F.transform(exact, _stems))))


def variant_set(tokens: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(tokens, token_variants)))


def search_text(text: Column) -> Column:
    """Lower-case text in which every run of other characters is one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def natural_key(text: Column) -> Column:
    """Sort key that ignores case and orders digit runs by value."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def part_key(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        size = F.lpad(F.length(digits).cast("string"), 6, "0")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), size, digits)).otherwise(p)

    return F.array_join(F.transform(parts, part_key), "")
