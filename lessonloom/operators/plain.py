"""Plain-text renderings of markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lessonloom.functions.text import DOT, WS, at_line_start, first_units, lines, trimmed


def excerpt(col: Column, n: int = 120) -> Column:
    """Stars, heading marks and dashes removed; the first ``n`` units and "..."."""
    bare = F.replace(col, F.lit("*"), F.lit(""))
    bare = F.regexp_replace(bare, rf"#{{1,3}}[{WS}]", "")
    bare = F.regexp_replace(bare, rf"{at_line_start('-')}[{WS}]", "")
    return F.concat(first_units(bare, n), F.lit("..."))


def plain_text(col: Column, variant: str) -> Column:
    """Variant ``a`` unwraps emphasis and code; ``b`` drops stars and blank lines."""
    if variant == "a":
        out = F.regexp_replace(col, rf"#{{1,6}}[{WS}]+", "")
        out = F.regexp_replace(out, rf"\*\*({DOT}+?)\*\*", "$1")
        out = F.regexp_replace(out, rf"\*({DOT}+?)\*", "$1")
        out = F.regexp_replace(out, rf"`({DOT}+?)`", "$1")
        return F.regexp_replace(out, rf"{at_line_start('[-*]')}[{WS}]+", "• ")
    if variant == "b":
        out = F.replace(col, F.lit("*"), F.lit(""))
        out = F.regexp_replace(out, rf"#{{1,3}}[{WS}]?", "")
        out = F.regexp_replace(out, rf"{at_line_start('-')}[{WS}]", "• ")
        kept = F.filter(F.transform(lines(out), trimmed), lambda t: t != "")
        return F.array_join(kept, "\n")
    raise ValueError(f"no such variant: {variant}")
