"""Section parsing of page texts, and page revision times.

A page is one row, so its text is parsed inside that row with array functions:
no shuffle, no sort, however many rows one source holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions.text import let, strip, strip_equals

# Sections left out of a page, inner spaces included.
EXCLUDED_SECTIONS = (" See also ", " References ", " External links ")

_PLACE = "array<struct<section:string,subsection:string>>"


def _marked(line: Column, i: Column) -> Column:
    """Position, level (1 section, 2 subsection, 0 body) and heading of a line."""
    level = (
        F.when(line.startswith("=== ") & line.endswith(" ==="), 2)
        .when(line.startswith("== ") & line.endswith(" =="), 1)
        .otherwise(0)
    )
    return F.struct(i.alias("pos"), level.alias("level"), strip_equals(line).alias("name"))


# Headings of a block: in a block places are carried one by one, between blocks by one summary each.
_BLOCK = 128


def _carried(heads: Column, section: Column, subsection: Column) -> Column:
    """Section and subsection in force after each heading, from those in force before the first."""
    start = F.struct(section.alias("section"), subsection.alias("subsection"), F.array().cast(_PLACE).alias("done"))

    def step(acc: Column, head: Column) -> Column:
        section = F.when(head["level"] == 1, head["name"]).otherwise(acc["section"])
        subsection = F.when(head["level"] == 2, head["name"]).otherwise(acc["subsection"])
        place = F.struct(section.alias("section"), subsection.alias("subsection"))
        return F.struct(
            section.alias("section"),
            subsection.alias("subsection"),
            F.concat(acc["done"], F.array(place)).alias("done"),
        )

    return F.aggregate(heads, start, step, lambda acc: acc["done"])


def _places(heads: Column) -> Column:
    """Section and subsection in force after each heading. A new section leaves
    the subsection as it was.

    What a block of headings does to the place is its last section and its last subsection, and this is associative: summaries of
    blocks are carried forward first (again in blocks), then each block is filled from the place before it. So the cost of a
    page is linear in its headings.
    """

    def last(block: Column, level: int) -> Column:
        return F.try_element_at(F.filter(block, lambda h: h["level"] == level), F.lit(-1))["name"]

    def blocks(items: Column) -> Column:
        return F.transform(_starts(items), lambda i: F.slice(items, i, _BLOCK))

    def summary(block: Column) -> Column:
        return F.struct(last(block, 1).alias("section"), last(block, 2).alias("subsection"))

    def before(sums: Column, enter: Column) -> Column:
        """The place before each block, from the place before the first."""
        start = F.struct(enter.alias("at"), F.array().cast(_PLACE).alias("done"))

        def step(acc: Column, s: Column) -> Column:
            return F.struct(_after(acc["at"], s).alias("at"), F.concat(acc["done"], F.array(acc["at"])).alias("done"))

        return F.aggregate(sums, start, step, lambda acc: acc["done"])

    def nowhere() -> Column:
        return F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("subsection"))

    def over(sums: Column) -> Column:
        """Places before blocks, themselves carried over blocks of blocks."""
        outer = F.transform(
            _starts(sums), lambda i: F.aggregate(F.slice(sums, i, _BLOCK), nowhere(), _after)
        )
        return let(before(outer, nowhere()), lambda enters: F.flatten(
            F.transform(enters, lambda e, n: before(F.slice(sums, n * _BLOCK + 1, _BLOCK), e))
        ))

    def fill(parts: Column) -> Column:
        return let(over(F.transform(parts, summary)), lambda enters: F.flatten(F.transform(
            parts, lambda b, n: _carried(b, F.element_at(enters, n + 1)["section"], F.element_at(enters, n + 1)["subsection"])
        )))

    return let(blocks(heads), fill)


def _starts(items: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(_BLOCK))


def _after(place: Column, summary: Column) -> Column:
    """The place after a block: a summary's null leaves it as it was."""
    return F.struct(
        F.coalesce(summary["section"], place["section"]).alias("section"),
        F.coalesce(summary["subsection"], place["subsection"]).alias("subsection"),
    )


def _segments(lines: Column) -> Column:
    """Runs of body lines between headings, each with its place."""
    marks = F.transform(lines, _marked)
    before = F.array(
        F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("name"))
    )
    heads = F.concat(before, F.filter(marks, lambda m: m["level"] > 0))

    def cut(hs: Column, places: Column) -> Column:
        def segment(head: Column, j: Column) -> Column:
            following = F.coalesce(F.try_element_at(hs, j + 2)["pos"], F.size(lines))
            place = F.element_at(places, j + 1)
            return F.struct(
                place["section"].alias("section"),
                place["subsection"].alias("subsection"),
                F.slice(lines, head["pos"] + 2, following - head["pos"] - 1).alias("lines"),
            )

        return F.transform(hs, segment)

    return let(heads, lambda hs: let(_places(hs), lambda ps: cut(hs, ps)))


def _islands(segments: Column) -> Column:
    """Join neighbouring segments of one place into one text."""

    def opens(kept: Column) -> Column:
        def decide(seg: Column, i: Column) -> Column:
            prev = F.element_at(kept, F.greatest(i, F.lit(1)))
            same = prev["section"].eqNullSafe(seg["section"]) & prev["subsection"].eqNullSafe(seg["subsection"])
            return F.when((i == 0) | ~same, i)

        return F.filter(F.transform(kept, decide), lambda i: i.isNotNull())

    def build(kept: Column, starts: Column) -> Column:
        def island(at: Column, j: Column) -> Column:
            end = F.coalesce(F.try_element_at(starts, j + 2), F.size(kept))
            members = F.slice(kept, at + 1, end - at)
            first = F.element_at(kept, at + 1)
            return F.struct(
                first["section"].alias("section"),
                first["subsection"].alias("subsection"),
                F.array_join(F.flatten(F.transform(members, lambda m: m["lines"])), " ").alias("content"),
            )

        return F.transform(starts, island)

    return let(segments, lambda kept: let(opens(kept), lambda starts: build(kept, starts)))


def section_array(content: Column, exclude: Sequence[str] = EXCLUDED_SECTIONS) -> Column:
    """`array<struct<section, subsection, content>>` of a page text.

    Empty lines go before white space is stripped, so a line of spaces stays as
    an empty body line. Left-out sections go before neighbours are joined, so
    `A / References / A` gives one row. A heading without body gives none.
    """
    lines = F.transform(F.filter(F.split(content, "\n", -1), lambda x: x != ""), strip)

    def wanted(segment: Column) -> Column:
        has_body = F.size(segment["lines"]) > 0
        if not exclude:
            return has_body
        return has_body & F.coalesce(~segment["section"].isin(*exclude), F.lit(True))

    return _islands(F.filter(let(lines, _segments), wanted))


def parse_sections(
    pages: DataFrame, content: str = "content", exclude: Sequence[str] = EXCLUDED_SECTIONS
) -> DataFrame:
    """One row per section of each page; other page columns are carried along.
    `section_no` is the place of the section in its page, from 0."""
    carried = [c for c in pages.columns if c != content]
    parsed = pages.select(*carried, F.posexplode(section_array(F.col(content), exclude)).alias("section_no", "_s"))
    return parsed.select(*carried, "section_no", "_s.section", "_s.subsection", "_s.content")


def revision_bounds(revisions: DataFrame, page: str = "page_id", time: str = "ts") -> DataFrame:
    """First and last revision time per page. Minimum and maximum are combined
    before the shuffle, so a page with most of the revisions costs one row per task."""
    return revisions.groupBy(F.col(page).alias("page_id")).agg(
        F.min(time).alias("creation_date"), F.max(time).alias("last_modified")
    )


def with_revision_times(pages: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pages with their revision times; pages without revisions drop out."""
    return pages.join(bounds, "page_id")
