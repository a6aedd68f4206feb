"""Text functions for the documentation search: slugs, sections, plain text, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slugify(text: Column) -> Column:
    """Lower-cased words joined by single dashes."""
    kept = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]", ""), F.lit(" \t\n\r\f\v"))
    return F.regexp_replace(kept, r"[-\s]+", "-")


def split_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per section of a Markdown text: position, number, title, body, and the H2/H3 headings of the body.

    Sections start at a line ``# <number>. <title>``. Every text is split whole; the result is exploded, so a long
    document becomes many rows.
    """
    pieces = df.select(key, F.posexplode(F.split(F.col(text), r"\n(?=# [0-9]+\. )")).alias("position", "raw"))
    trimmed = F.trim(F.col("raw"), F.lit(" \t\n\r\f\v"))
    pieces = pieces.withColumn("raw", trimmed).where(F.col("raw") != "")
    first = F.trim(F.substring_index("raw", "\n", 1), F.lit(" \t\r\f\v"))
    number = F.regexp_extract(first, r"^#\s*([0-9]+)\.\s*", 1)
    numbered = F.when(number != "", number.cast("bigint")).when(first.startswith("#"), F.lit(0))
    title = F.trim(F.regexp_replace(first, r"^#\s*([0-9]+\.\s*)?", ""))
    body = F.when(F.instr("raw", "\n") > 0, F.expr("substring(raw, instr(raw, '\n') + 1)")).otherwise("")
    lines = F.transform(F.split(body, "\n"), lambda line: F.trim(line, F.lit(" \t\r\f\v")))
    headings = F.filter(lines, lambda line: line.startswith("## ") | line.startswith("### "))
    plain_heading = F.transform(
        headings, lambda line: F.replace(F.trim(F.regexp_replace(line, r"^#+ ", "")), F.lit("`"), F.lit(""))
    )
    return pieces.select(
        key,
        F.col("position").cast("bigint").alias("position"),
        F.coalesce(numbered, F.col("position").cast("bigint")).alias("number"),
        F.replace(title, F.lit("`"), F.lit("")).alias("title"),
        body.alias("body"),
        plain_heading.alias("headings"),
    )


def plain_text(markdown: Column) -> Column:
    """Markdown without code fences and heading marks, blanks collapsed."""
    text = F.regexp_replace(markdown, r"(?s)```.*?```", "")
    text = F.regexp_replace(text, r"#+\s*", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def summary(plain: Column, title: Column) -> Column:
    """The first 160 characters of the first paragraph longer than 30, or a fixed sentence where there is none."""
    paragraphs = F.filter(
        F.transform(F.split(plain, "\n"), lambda p: F.trim(p)), lambda p: (F.length(p) > 30) & ~p.startswith("```")
    )
    first = F.get(paragraphs, F.lit(0))
    short = F.concat(F.substring(first, 1, 160), F.when(F.length(first) > 160, F.lit("...")).otherwise(F.lit("")))
    # Fixed value: the wording of the fallback.
    fallback = F.concat(F.lit("Technical documentation and specifications for "), title, F.lit("."))
    return F.coalesce(short, fallback)


def search_score(title: Column, text: Column, headings: Column, query: str) -> Column:
    """100 for an equal title, 50 for a title that contains the query, 20 for such a text; +35 for a heading."""
    wanted = query.strip().lower()
    base = (
        F.when(F.lower(title) == wanted, 100)
        .when(F.lower(title).contains(wanted), 50)
        .when(F.lower(text).contains(wanted), 20)
        .otherwise(0)
    )
    bonus = F.when(F.exists(headings, lambda h: F.lower(h).contains(wanted)), 35).otherwise(0)
    return (base + bonus).cast("bigint")
