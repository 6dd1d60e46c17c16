"""Text expressions with PostgreSQL-like null and match behaviour, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def flatten_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def squeeze_blanks(text: Column) -> Column:
    """Collapse runs of blanks by three literal replaces.

    Not the same as a regex on `` +``: a blank before ``*`` and a literal ``^*`` go too.
    """
    marked = F.replace(text, F.lit(" "), F.lit("*^"))
    return F.replace(F.replace(marked, F.lit("^*"), F.lit("")), F.lit("*^"), F.lit(" "))


def normalise_note(text: Column) -> Column:
    """Front end of every biomarker and laboratory extractor."""
    return F.lower(squeeze_blanks(flatten_lines(text)))


def first_or_blank(text: Column, pattern: str, group: int = 1, needs: str | None = None) -> Column:
    """Captured group of the first match, blank (or NULL) without one.

    ``needs`` is a literal every match contains: a plain substring test is far cheaper
    than starting the regex engine on texts that cannot match.
    """
    found = F.regexp_extract(text, pattern, group)
    return F.when(F.contains(text, F.lit(needs)), found) if needs else found


def first_match(text: Column, pattern: str, group: int = 1, needs: str | None = None) -> Column:
    """As ``first_or_blank``, but NULL when nothing (or an empty group) matches."""
    return F.nullif(first_or_blank(text, pattern, group, needs), F.lit(""))


def all_matches(text: Column, pattern: str, group: int = 1, needs: str | None = None) -> Column:
    """Captured groups of all matches, an empty array when there are none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if needs:
        found = F.when(F.contains(text, F.lit(needs)), found)
    return F.coalesce(found, F.array().cast("array<string>"))


def match_count(text: Column, pattern: str, needs: str | None = None) -> Column:
    found = F.regexp_count(text, F.lit(pattern))
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(F.lit(0)) if needs else found


def first_present(*cols: Column) -> Column:
    """First column that is neither NULL nor empty, in priority order; every column is
    evaluated exactly once."""
    return F.try_element_at(F.filter(F.array(*cols), lambda c: F.length(c) > 0), F.lit(1))


def join_text(*cols: Column) -> Column:
    """Concatenation that skips NULL."""
    return F.concat_ws("", *cols)


def drop_chars(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def replace_many(text: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), text)


def to_number(text: Column) -> Column:
    """Text to double, NULL on junk or on an empty string."""
    return F.trim(text).try_cast("double")


def text_max(*cols: Column) -> Column:
    """Lexicographic maximum that skips NULL (so '9' beats '10')."""
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def split_token(text: Column, delimiter: str, position: int) -> Column:
    """1-based token; an empty string beyond the last one."""
    return F.split_part(text, F.lit(delimiter), F.lit(position))
