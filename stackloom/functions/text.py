"""Column functions over text: byte-exact cuts, signatures, ids and small conversions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from stackloom.functions import fixed
from stackloom.functions.dialect import java

UNICODE_SPACE = r"\p{IsWhite_Space}"
# All runs of it but a single blank.
OTHER_SPACE = rf" {UNICODE_SPACE}+|[{UNICODE_SPACE}&&[^ ]]{UNICODE_SPACE}*"
#: So many texts are hashed at once at least; fewer take longer together than one by one.
FNV_TOGETHER = 32


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``.

    Higher-order functions run their body once per element, so an expression spelled inside one would be recomputed
    for every element.  Binding it to a lambda variable keeps it to one evaluation.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def null_if_empty(col: Column) -> Column:
    return F.when(col != "", col)


def strip(col: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(col, F.lit(fixed.WHITE_SPACE))


def to_int(col: Column) -> Column:
    """B2: digits to a number, 0 when they are none (or too many for 64 bits)."""
    return F.coalesce(col.try_cast("bigint"), F.lit(0).cast("bigint"))


def cut_bytes(col: Column, max_bytes: int) -> Column:
    """At most ``max_bytes`` bytes of UTF-8, never splitting a character.

    Only the four bytes around the cut are looked at: when the byte after it continues a character, the cut moves back
    to that character's first byte.
    """
    if max_bytes < 4:
        raise ValueError("max_bytes must be at least 4")
    raw = col.cast("binary")

    def continues(byte_no: int) -> Column:
        return F.hex(F.substring(raw, byte_no, 1)).rlike("^[89AB]")

    keep = (
        F.when(~continues(max_bytes + 1), max_bytes)
        .when(~continues(max_bytes), max_bytes - 1)
        .when(~continues(max_bytes - 1), max_bytes - 2)
        .otherwise(max_bytes - 3)
    )
    return F.when(F.octet_length(col) <= max_bytes, col).otherwise(F.substring(raw, F.lit(1), keep).cast("string"))


def excerpt(col: Column, max_bytes: int, ellipsis: str = fixed.ELLIPSIS) -> Column:
    """``cut_bytes`` plus an ellipsis where something was cut."""
    return F.when(F.octet_length(col) <= max_bytes, col).otherwise(
        F.concat(cut_bytes(col, max_bytes), F.lit(ellipsis))
    )


def normalize_all(texts: Column) -> Column:
    """B1: ``normalize`` of each text of an array.

    The steps are chained, one pass over the array each, and not put inside each other: what is bound to a variable of a lambda
    inside a lambda makes Spark ask for its type, for every element and through all levels, twice a level.

    A byte search decides whether a step's regular expression has to run at all; most texts need few of them.

    White space in front of a time would be searched anew from each line of a run of blank lines.  It is collapsed in the
    end anyway, so the pattern takes the blanks of the time's own line only, and gives none of them back.
    """

    def linear(pattern: str) -> str:
        start = r"(?m)^\s*"
        own_line = r"(?m)^[\t\f\r ]*+"
        return java(own_line + pattern[len(start) :]) if pattern.startswith(start) else java(pattern)

    for pattern, replacement, needle in fixed.SIGNATURE_STEPS:
        texts = F.transform(
            texts,
            lambda text: F.when(text.contains(needle), F.regexp_replace(text, linear(pattern), replacement)).otherwise(text),
        )
    return F.transform(texts, lambda text: F.btrim(F.regexp_replace(text, OTHER_SPACE, " ")))


def normalize(col: Column) -> Column:
    """B1: the signature of a log block, its volatile parts replaced and its white space collapsed."""
    return F.get(normalize_all(F.array(col)), F.lit(0))


def starts_block(line: Column) -> Column:
    """Does this line begin a new log entry?"""
    return line.rlike(f"^(?:{fixed.BLOCK_START})")


def _fnv(values: pa.Array) -> np.ndarray:
    """64-bit FNV-1a of each value, byte by byte for all values at once; the few that are longer than the rest on their own."""
    values = values.cast(pa.large_binary())
    if not len(values):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    order = np.argsort(offsets[:-1] - offsets[1:], kind="stable")  # long ones first
    starts, lengths = offsets[:-1][order], np.diff(offsets)[order]
    state = np.full(len(values), fixed.FNV_OFFSET_HIGH << 32 | fixed.FNV_OFFSET_LOW, np.uint64)
    prime = 1 << 40 | fixed.FNV_PRIME_LOW
    place, left = 0, int((lengths > 0).sum())
    while left >= FNV_TOGETHER:
        state[:left] = (state[:left] ^ data[starts[:left] + place]) * np.uint64(prime)
        place += 1
        while left and lengths[left - 1] <= place:
            left -= 1
    for row in range(left):
        hashed = int(state[row])
        for byte in data[starts[row] + place : starts[row] + lengths[row]].tobytes():
            hashed = (hashed ^ byte) * prime & 0xFFFFFFFFFFFFFFFF
        state[row] = hashed
    result = np.empty(len(values), np.uint64)
    result[order] = state
    return result


def _unsigned(values: pa.Array) -> pa.Array:
    """The hashes as decimals, whose 128 bits they are the lower half of; of NULL it is NULL."""
    wide = np.zeros((len(values), 2), "<u8")
    wide[:, 0] = _fnv(values)
    numbers = pa.Array.from_buffers(pa.decimal128(20, 0), len(values), [None, pa.py_buffer(wide.tobytes())])
    return pc.if_else(values.is_valid(), numbers, pa.scalar(None, pa.decimal128(20, 0)))


def sig_id(signature: Column) -> Column:
    """Unsigned 64-bit FNV-1a of the UTF-8 bytes as DECIMAL(20,0).

    Column functions take a text apart into its bytes and fold them one by one, at some microseconds a byte; a task does so for
    thousands of texts at a time.
    """
    return F.arrow_udf(_unsigned, "decimal(20,0)")(signature.cast("binary"))


def symbol_name(function: Column) -> Column:
    """Bare symbol of a frame's function: no receiver, no qualifier, no trailing ``()``."""
    name = strip(function)
    after = strip(F.regexp_extract(name, r"(?s)^.*\)(.*)$", 1))
    inside = F.regexp_extract(name, r"(?s)^\((.*)\)", 1)
    receiver = name.startswith("(") & name.contains(")")

    def bare(text: Column) -> Column:
        return F.regexp_replace(F.substring_index(text, ".", -1), r"\(\)\z", "")

    return (
        F.when(receiver & (after == ""), F.substring_index(inside, ".", -1))
        .when(receiver, bare(after))
        .otherwise(bare(name))
    )


def strip_container(path: Column) -> Column:
    """A trace path without its build or container root."""
    roots = "|".join(prefix.strip("/") for prefix in fixed.CONTAINER_PREFIXES)
    return F.regexp_replace(path, f"^/(?:{roots})/", "")


def join_ints(marks: Column) -> Column:
    """Distinct numbers, ascending, comma separated."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(marks)), lambda n: n.cast("string")), ",")


def marker(line: Column) -> Column:
    """The section label a reply line stands for, or NULL."""

    def label(title: Column) -> Column:
        found = F.lit(None).cast("string")
        for name in reversed(fixed.SECTION_LABELS):
            found = F.when((title == name) | title.startswith(name + " "), name).otherwise(found)
        return found

    return let(F.upper(F.rtrim(strip(F.ltrim(line, F.lit(" \t#*-"))), F.lit(":"))), label)


def rfc3339(ts: Column) -> Column:
    """Second precision UTC text of a timestamp."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day(ts: Column) -> Column:
    """The day of a timestamp."""
    return F.date_format(ts, "yyyy-MM-dd")


def payload(text: Column) -> Column:
    """A JSON payload as a variant, NULL when it is no JSON."""
    return F.try_parse_json(text)


def _field(parsed: Column, field: str, kinds: str) -> Column:
    """A top-level field as text if its own kind, not that of a field of that name further down, is one of ``kinds``."""
    kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
    return F.when(kind.rlike(f"^(?:{kinds})"), F.try_variant_get(parsed, f"$.{field}", "string"))


def payload_int(parsed: Column, field: str) -> Column:
    """Number in a payload; 0 when it is missing or no number."""
    raw = _field(parsed, field, "BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT")
    return F.coalesce(raw.try_cast("double").try_cast("bigint"), F.lit(0)).cast("bigint")


def payload_text(parsed: Column, field: str) -> Column:
    """String in a payload; empty when it is missing or no string."""
    return F.coalesce(_field(parsed, field, "STRING"), F.lit(""))


def payload_time(parsed: Column, field: str) -> Column:
    """RFC3339 time in a payload; NULL when it cannot be read."""
    text = payload_text(parsed, field)
    valid = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(valid, text.try_cast("timestamp"))
