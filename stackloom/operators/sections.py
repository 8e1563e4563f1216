"""Replies of a model taken apart (B14, C5, D9, E8).  A reply is one row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions import fixed
from stackloom.functions.text import excerpt, let, marker, strip
from stackloom.operators.rows import unfold


def sections(content: Column) -> Column:
    """The labelled sections of a reply in order, as array<struct<pos, title, body>>.

    A marker line opens a section that runs to the next one; what comes before the first is dropped.
    """

    def marked(lines: Column) -> Column:
        labels = F.transform(lines, lambda line, i: F.struct(i.alias("line"), marker(line).alias("title")))
        return F.filter(labels, lambda label: label["title"].isNotNull())

    def bodies(lines: Column, marks: Column) -> Column:
        def section(mark: Column, i: Column) -> Column:
            first = mark["line"] + 1
            last = F.coalesce(F.get(marks, i + 1)["line"], F.size(lines))
            return F.struct(
                i.alias("pos"),
                mark["title"].alias("title"),
                strip(F.array_join(F.slice(lines, first + 1, last - first), "\n")).alias("body"),
            )

        return F.transform(marks, section)

    return let(F.split(content, "\n"), lambda lines: let(marked(lines), lambda marks: bodies(lines, marks)))


def parse_sections(responses: DataFrame) -> DataFrame:
    """One row per reply and section."""
    return unfold(responses, sections(F.col("content")), "doc_id", position="_").select("doc_id", "item.*")


def summary(parsed: Column, label: str, max_bytes: int | None = None) -> Column:
    """Body of the last section with that title, cut at ``max_bytes`` if given; empty when there is none."""
    last = F.try_element_at(F.filter(parsed, lambda s: s["title"] == label), F.lit(-1))["body"]
    body = F.coalesce(last, F.lit(""))
    return body if max_bytes is None else excerpt(body, max_bytes)


def cause_fixes(responses: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Each reply with its ``cause`` and ``fixes``."""
    parsed = responses.withColumn("_sections", sections(F.col("content")))
    return (
        parsed.withColumn("cause", summary(F.col("_sections"), fixed.CAUSE_LABEL, max_bytes))
        .withColumn("fixes", summary(F.col("_sections"), fixed.FIXES_LABEL, max_bytes))
        .drop("_sections")
    )
