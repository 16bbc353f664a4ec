"""Column expressions with the string rules of ECMAScript.

The corpus was defined by ECMAScript string functions, which differ from
Spark's in what counts as white space, where a line ends and how length is
measured. Everything here stays a JVM expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line terminators of ECMAScript.
WS_CHARS = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set inside a Java character class, and "." spelled out.
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
DOT = r"[^\n\r\u2028\u2029]"


def at_line_start(char: str) -> str:
    """Pattern for one ``char`` (a class or literal) that begins a line.

    The look back comes after the character: tried first, it would run at
    every position of the text.
    """
    return rf"{char}(?<!{DOT}{char})"


def trimmed(col: Column) -> Column:
    """Both ends stripped of any white space, newlines and NBSP included."""
    return F.btrim(col, F.lit(WS_CHARS))


def missing(col: Column) -> Column:
    """Null or empty. White space alone is not missing."""
    return col.isNull() | (col == "")


def or_default(col: Column, default: Column | str) -> Column:
    """``col`` unless it is missing."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(col, F.lit("")), fallback)


def units(col: Column) -> Column:
    """Length in UTF-16 units; equals ``length`` except beyond the BMP."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")


def first_units(col: Column, n: int) -> Column:
    """The first ``n`` UTF-16 units; a pair cut in half is dropped."""
    head = F.substring(col, 1, n)
    raw = F.substring(F.encode(head, "UTF-16BE"), 1, 2 * n)
    last = F.hex(F.substring(raw, 2 * n - 1, 2))
    kept = F.when(last.between("D800", "DBFF"), F.substring(raw, 1, 2 * n - 2)).otherwise(raw)
    return F.when(
        head.rlike(r"[\x{10000}-\x{10FFFF}]"), F.decode(kept, "UTF-16BE")
    ).otherwise(head)


def one_line(col: Column) -> Column:
    """Whether no line terminator occurs, beyond "\\n" which lines are split at."""
    breaks = [col.contains(c) for c in ("\r", "\u2028", "\u2029")]
    return ~(breaks[0] | breaks[1] | breaks[2])


def lines(col: Column) -> Column:
    """Array of lines, empty ones kept."""
    return F.split(col, "\n")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Lambdas of higher-order functions may look at a whole array per element;
    binding it to a lambda variable keeps the optimizer from inlining the
    expression that builds it into the inner loop.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def islands(items: Column, marks: Column, pos: Callable, build: Callable) -> Column:
    """Cut ``items`` at ``marks`` without a window or a shuffle.

    ``marks`` is an ordered array, ``pos(mark)`` the 0-based index at which its
    island starts. Each island runs to the next mark; ``build(mark, island)``
    makes the output element. Every item is copied once, so cost is linear.
    """

    def cut(all_items: Column, all_marks: Column) -> Column:
        def one(mark: Column, i: Column) -> Column:
            end = F.coalesce(pos(F.get(all_marks, i + 1)), F.size(all_items))
            return build(mark, F.slice(all_items, pos(mark) + 1, end - pos(mark)))

        return F.transform(all_marks, one)

    return bind(items, lambda all_items: bind(marks, lambda m: cut(all_items, m)))


def strict_object(col: Column, ddl: str) -> Column:
    """Parse one JSON object strictly; null for anything else.

    ``from_json`` stops at the end of the first value, so text after it goes
    unseen. Inside a wrapping object trailing text breaks the parse, unless it
    closes the wrapper or adds a key to it. Only texts where an object is
    followed by a brace or a key can do that; they are parsed a second time
    inside brackets, which the same text cannot close.
    """
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    keyed = F.from_json(F.concat(F.lit('{"v":'), col, F.lit("}")), f"STRUCT<v: {ddl}>", options)
    suspect = col.rlike(r'\}\s*(?:\}|,\s*")')
    listed = F.from_json(F.concat(F.lit("["), col, F.lit("]")), f"ARRAY<{ddl}>", options)
    return F.when(suspect & ~F.coalesce(F.size(listed) == 1, F.lit(False)), None).otherwise(
        keyed["v"]
    )
