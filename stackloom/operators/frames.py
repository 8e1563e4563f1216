"""Stack frames per language (C3a-C3g, C4, F3, F4, H2-H4).

As with groups, the frames of a document are an array column of its row.  Each language has one pattern that picks the
frame lines out of the whole text; they are then taken apart, all of them or the first ``limit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions import fixed
from stackloom.functions.dialect import LINE_SPACE, SPACE, java
from stackloom.functions.language import detect_language
from stackloom.functions.text import let, null_if_empty, strip, to_int
from stackloom.operators.rows import unfold

FRAMES_TYPE = "array<struct<file:string,line:bigint,function:string,module:string>>"


def _frame(file: Column, line: Column, function: Column | None = None, module: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        file.alias("file"),
        to_int(line).alias("line"),
        (nothing if function is None else null_if_empty(function)).alias("function"),
        (nothing if module is None else null_if_empty(module)).alias("module"),
    )


def _first(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def _matches(text: Column, pattern: str, limit: int | None) -> Column:
    """The first matches, or all, of a line pattern in a text."""
    return _first(F.regexp_extract_all(text, F.lit(java(pattern, per_line=True)), 0), limit)


def _line_frames(text: Column, pattern: str, limit: int | None, file: int, line: int, function: int, module: int = 0) -> Column:
    single = java(pattern)

    def part(match: Column, group: int) -> Column | None:
        return F.regexp_extract(match, single, group) if group else None

    return F.transform(
        _matches(text, pattern, limit), lambda m: _frame(part(m, file), part(m, line), part(m, function), part(m, module))
    )


def python_frames(text: Column, limit: int | None) -> Column:
    return _line_frames(text, fixed.PYTHON_FRAME, limit, file=1, line=2, function=3)


def java_frames(text: Column, limit: int | None) -> Column:
    return _line_frames(text, fixed.JAVA_FRAME, limit, file=3, line=4, function=2, module=1)


def ruby_frames(text: Column, limit: int | None) -> Column:
    return _line_frames(text, fixed.RUBY_FRAME, limit, file=1, line=2, function=3)


def dotnet_frames(text: Column, limit: int | None) -> Column:
    """C3g.  Lines are first cut behind their last ``:line n``, so that the two gaps of the pattern are found at once."""
    single = java(fixed.DOTNET_FRAME)
    cut = F.regexp_extract_all(text, F.lit(java(r"^\s*at .+:line \d+", per_line=True)), 0)
    return F.transform(
        _first(F.filter(cut, lambda m: m.rlike(single)), limit),
        lambda m: _frame(F.regexp_extract(m, single, 2), F.regexp_extract(m, single, 3), F.regexp_extract(m, single, 1)),
    )


def node_frames(text: Column, limit: int | None) -> Column:
    """C3d.  Every line of the form with a function also fits the form without one, so one pattern finds both.

    The form with a function is looked for in the line up to its last ``:n:n)``, for the reason given at C3g.
    """
    call, plain = java(fixed.NODE_CALL_FRAME), java(fixed.NODE_FRAME)

    def frame(line: Column, cut: Column) -> Column:
        return F.when(
            cut.rlike(call),
            _frame(F.regexp_extract(cut, call, 2), F.regexp_extract(cut, call, 3), F.regexp_extract(cut, call, 1)),
        ).otherwise(_frame(F.regexp_extract(line, plain, 1), F.regexp_extract(line, plain, 2)))

    return F.transform(
        _matches(text, fixed.NODE_FRAME + ".*", limit),
        lambda m: let(F.regexp_extract(m, r"(?d)^.*:\d+:\d+\)", 0), lambda cut: frame(m, cut)),
    )


def rust_frames(text: Column, limit: int | None) -> Column:
    """C3f/H2: the panic header, looked for on the first line only, then the frame lines.

    The header's file ends at the last ``.rs:n:n`` and begins behind the first blank, if there is one in front of it.
    Taking these two apart one after the other finds what the one pattern with its three gaps finds, in linear time.
    """
    single = java(fixed.RUST_FRAME)

    def header(behind: Column) -> Column:
        whole = F.regexp_extract(behind, single, 1)
        after_blank = F.regexp_extract(whole, rf"(?d)^[^{SPACE}]*[{SPACE}](.+\.rs)\z", 1)
        file = F.when(after_blank != "", after_blank).otherwise(whole)
        return F.when(whole != "", F.array(_frame(file, F.regexp_extract(behind, single, 2)))).otherwise(
            F.array().cast(FRAMES_TYPE)
        )

    head = let(F.regexp_extract(F.substring_index(text, "\n", 1), r"(?d)panicked at(.*)", 1), header)
    body = F.transform(
        _matches(text, fixed.RUST_FRAME, limit),
        lambda m: _frame(F.regexp_extract(m, single, 1), F.regexp_extract(m, single, 2)),
    )
    return _first(F.concat(head, body), limit)


def go_frames(text: Column, limit: int | None) -> Column:
    """A frame takes the call line before it, unless another frame came in between.

    With only call and frame lines left, that is the element in front of the frame.  The look-ahead for a closing
    parenthesis keeps the call pattern from backtracking over long lines that have none.
    """
    frame = java(fixed.GO_FRAME)
    call = fixed.GO_CALL[1:]
    either = rf"^(?:{fixed.GO_FRAME[1:]}|(?=.*\)[{LINE_SPACE}]*$){call})"
    found = F.regexp_extract_all(text, F.lit(java(either, per_line=True)), 0)

    def paired(hits: Column) -> Column:
        pairs = F.transform(
            hits, lambda hit, i: F.struct(hit.alias("hit"), F.coalesce(F.get(hits, i - 1), F.lit("\t")).alias("before"))
        )
        return _first(F.filter(pairs, lambda p: p["hit"].startswith("\t")), limit)

    def function(before: Column) -> Column:
        return F.when(~before.startswith("\t"), strip(F.regexp_replace(strip(before), r"\(\)\z", "")))

    return F.transform(
        let(found, paired),
        lambda p: _frame(F.regexp_extract(p["hit"], frame, 1), F.regexp_extract(p["hit"], frame, 2), function(p["before"])),
    )


def generic_frames(text: Column, limit: int | None) -> Column:
    """C4/H3: every distinct ``file.ext:n``.

    The pattern takes as much of a run of non-blanks as it can, so a run has at most one match, at its start.  The
    look-behind says so, which keeps a long run without a match linear.
    """
    pattern = f"(?d)(?<![^{SPACE}])" + java(fixed.GENERIC_FRAME)[4:]
    found = F.when(text.contains(":"), F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))).otherwise(
        F.array().cast("array<string>")
    )
    return F.transform(
        _first(found, limit),
        lambda m: _frame(F.regexp_extract(m, r"(?s)^(.*):\d+\z", 1), F.substring_index(m, ":", -1)),
    )


PARSERS = {
    "go": go_frames,
    "python": python_frames,
    "java": java_frames,
    "node": node_frames,
    "ruby": ruby_frames,
    "rust": rust_frames,
    "dotnet": dotnet_frames,
}


def stack_frames(text: Column, language: Column, limit: int | None = None) -> Column:
    """The frames of a text by its language, the generic sweep when that gives none."""
    own = F.array().cast(FRAMES_TYPE)
    for name, parser in PARSERS.items():
        own = F.when(language == name, parser(text, limit)).otherwise(own)
    return let(own, lambda found: F.when(F.size(found) > 0, found).otherwise(generic_frames(text, limit)))


def parse_frames(df: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per document and frame, in source order from 0; uses ``language`` when ``df`` has it."""
    if "language" not in df.columns:
        df = df.withColumn("language", detect_language(F.col("text")))
    frames = stack_frames(F.col("text"), F.col("language"), limit)
    return unfold(df, frames, "doc_id", "language").select("doc_id", "language", "pos", "item.*")


def frame_hotspots(df: DataFrame) -> DataFrame:
    """How often each file:line is hit over all documents; counts combine before the shuffle."""
    return parse_frames(df).groupBy("file", "line").agg(F.count(F.lit(1)).alias("hits"))
