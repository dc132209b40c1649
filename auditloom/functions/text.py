"""Column functions over texts and numbers, with the results that a line-based audit expects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every line end that counts, as a regex of Java and of RE2.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def line_array(content: Column) -> Column:
    """The lines of a text; a last line end opens no further line, an empty or null text has none."""
    parts = F.split(content, LINE_END)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    return F.when(content.isNull() | (content == ""), F.expr("cast(array() as array<string>)")).when((F.size(parts) == 2) & (parts[0] == "") & (parts[1] == ""), F.array(F.lit(""))).otherwise(kept)


def matches_any(c: Column, patterns) -> Column:
    """Whether one of the literal regexes is found; the literals compile once."""
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(p)
    return found


def clean_version(c: Column) -> Column:
    """A version without the operators at its start."""
    return F.regexp_replace(c, r"^[\^~>=<!]+", "")


def severity_rank(c: Column) -> Column:
    """0 for critical to 4 for info, 5 for anything else; letter case does not matter."""
    from auditloom.plans.rules import SEVERITIES

    rank = F.lit(5)
    for i, s in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(F.lower(c) == s, i).otherwise(rank)
    return rank
