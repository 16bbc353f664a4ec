"""Markdown structure: math blocks, line kinds, inline tokens, code references.

All narrow: every row is produced from one document by explodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.functions.rows import each
from lessonloom.functions.text import DOT, WS, bind, lines, one_line, trimmed

# What may lead a line, and inline tokens. A lead needs white space
# and something behind it, so "####" or a lone "-" leads nothing.
LEAD = rf"^(#{{1,3}}|[-•]|\d+\.)[{WS}]+(?={DOT})"
INLINE = (
    r"([A-Z]\d+\.\d+\.\d+\.\d+|\$\$[^$]+\$\$|\$[^$]+\$|\*\*[^*]+\*\*|\*[^*]+\*)"
)
CODE = r"^[A-Z]\d+\.\d+\.\d+\.\d+\z"
CODE_WITH_SUFFIX = r"([A-Z]\d+\.\d+\.\d+\.\d+(?:-[A-Z]+)?)"


def md_math(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Pieces between ``$$``: odd ones are display math, even ones text.

    An unclosed ``$$`` makes the rest math.
    """
    pieces = each(df, [key], F.split(F.col(text), r"\$\$"), "piece_no", "_piece")
    math = F.col("piece_no") % 2 == 1
    return pieces.select(
        key,
        "piece_no",
        F.when(math, "math").otherwise("text").alias("kind"),
        F.when(math, trimmed(F.col("_piece"))).otherwise(F.col("_piece")).alias("body"),
    )


def md_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per line with its kind, number (numbered lines only) and content."""
    exploded = each(df, keys, lines(F.col(text)), "line_no", "_line")
    line, lead = F.col("_line"), F.col("_lead")
    # The first character spares most lines the pattern, which runs once per line: the
    # mark is the lead without its white space.
    may_lead = F.substring(line, 1, 1).rlike("[-#•0-9]")
    led = exploded.withColumn("_lead", F.when(may_lead, F.regexp_extract(line, LEAD, 0)).otherwise(""))
    mark = trimmed(lead)
    kind = (
        F.when(lead == "", F.when(trimmed(line) == "", "blank").otherwise("paragraph"))
        .when(mark == "###", "h3")
        .when(mark == "##", "h2")
        .when(mark == "#", "h1")
        .when(mark.isin("-", "•"), "bullet")
        .otherwise("numbered")
    )
    rest = F.substr(line, F.length(lead) + 1)
    first_line = F.when(one_line(line), rest).otherwise(F.regexp_extract(rest, rf"^{DOT}*", 0))
    kinds = led.withColumn("kind", kind)
    return kinds.select(
        *keys,
        "line_no",
        "kind",
        F.when(F.col("kind") == "numbered", F.rtrim(mark, F.lit("."))).alias("number"),
        F.when(F.col("kind") == "blank", "")
        .when(F.col("kind") == "paragraph", line)
        .otherwise(first_line)
        .alias("content"),
    )


def md_profile(classified: DataFrame) -> DataFrame:
    """Lines of each kind over the whole corpus."""
    return classified.groupBy("kind").agg(F.count(F.lit(1)).alias("lines"))


def _token(t: Column, depth: int) -> Column:
    kind = (
        F.when(t.rlike(CODE), "code")
        .when(t.startswith("$$"), "display_math")
        .when(t.startswith("$"), "math")
        .when(t.startswith("**"), "bold")
        .otherwise("italic")
    )
    return bind(
        kind,
        lambda k: F.struct(
            F.lit(depth).alias("depth"),
            k.alias("kind"),
            F.when(k == "code", t)
            .when(k.isin("display_math", "bold"), F.substr(t, F.lit(3), F.length(t) - 4))
            .otherwise(F.substr(t, F.lit(2), F.length(t) - 2))
            .alias("token"),
        ),
    )


def _tokens(col: Column, depth: int) -> Column:
    return F.transform(F.regexp_extract_all(col, F.lit(INLINE), 1), lambda t: _token(t, depth))


def inline_tokens(col: Column) -> Column:
    """Tokens of a line in order; those inside bold or italic follow their host.

    Neither body can hold an asterisk, so one pass over the bodies is complete.
    """

    def with_inner(token: Column) -> Column:
        inner = F.when(token["kind"].isin("bold", "italic"), _tokens(token["token"], 2))
        return F.concat(F.array(token), F.coalesce(inner, F.filter(F.array(token), lambda _: F.lit(False))))

    return F.flatten(F.transform(_tokens(col, 1), with_inner))


def md_tokens(df: DataFrame, key: str, text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """One row per inline token of every line outside display math."""
    carried = [key, *(extra or [])]
    pieces = each(df, carried, F.split(F.col(text), r"\$\$"), "piece_no", "_piece")
    text_pieces = pieces.where(F.col("piece_no") % 2 == 0)
    classified = md_lines(text_pieces, [*carried, "piece_no"], "_piece")
    content = F.col("content")
    found = F.when(content.rlike(r"[$*]|[A-Z]\d"), inline_tokens(content))
    return each(classified, [*carried, "piece_no", "line_no"], found, "p", "t").select(
        *carried,
        "piece_no",
        "line_no",
        (F.col("p") + 1).alias("token_no"),
        F.col("t.depth").alias("depth"),
        F.col("t.kind").alias("kind"),
        F.col("t.token").alias("token"),
    )


def resolve_citations(
    df: DataFrame, key: str, text: str = "text", citations: str = "citations", exact: bool = False
) -> DataFrame:
    """Code tokens of each document with the first of its own citations naming them.

    By default a citation matches when its text contains the token, so a code
    also finds longer ones and a suffix like ``-SC`` is not part of the token.
    ``exact`` takes the suffix in and compares whole codes. Citations travel in
    the document's row, hence no join and no pairs.
    """
    if exact:
        codes = F.regexp_extract_all(F.col(text), F.lit(CODE_WITH_SUFFIX), 1)
        found = each(df, [key, citations], codes, "p", "token")

        def names(c: Column) -> Column:
            return F.array_contains(
                F.regexp_extract_all(c["text"], F.lit(CODE_WITH_SUFFIX), 1), F.col("token")
            )

        where = [(F.col("p") + 1).alias("token_no")]
    else:
        found = md_tokens(df, key, text, [citations]).where(F.col("kind") == "code")

        def names(c: Column) -> Column:
            return c["text"].contains(F.col("token"))

        where = ["piece_no", "line_no", "token_no"]
    cited = F.get(F.filter(citations, names), F.lit(0))
    return found.select(
        key, *where, "token", cited["id"].alias("citation_id"), cited["text"].alias("citation_text")
    )
