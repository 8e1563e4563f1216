"""Rule-based language detection as one column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackloom.functions import fixed
from stackloom.functions.dialect import java


def is_plain(pattern: str, needle: str) -> bool:
    """Whether a pattern matches its needle and nothing else."""
    return re.sub(r"\\([\[\]().])", r"\1", pattern) == needle


def rule_pattern(pattern: str) -> str:
    """JVM form of a rule's pattern.

    Where two gaps stand next to each other, the first may as well end at its first chance: whether there is a match does not
    change, and the engine has nothing to try again on a long line.
    """
    for gap in (r".* \(", ".* in "):
        pattern = pattern.replace(gap + ".*", f"(?>.*?{gap[2:]}).*")
    return java(pattern, per_line=pattern.startswith("(?m)"))


def rule_matches(text: Column, pattern: str, needle: str) -> Column:
    """One rule.  The byte search for ``needle`` runs first, so most texts never reach the regular expression."""
    if is_plain(pattern, needle):
        return text.contains(needle)
    return text.contains(needle) & text.rlike(rule_pattern(pattern))


def language_scores(text: Column) -> dict[str, Column]:
    """Matching rules per language, in tie-break order."""
    return {
        language: sum(
            rule_matches(text, pattern, needle).cast("int")
            for owner, pattern, needle in fixed.LANGUAGE_RULES
            if owner == language
        )
        for language in fixed.LANGUAGE_PRIORITY
    }


def detect_language(text: Column) -> Column:
    """The language with most matching rules; ties go to the earlier language, no match to ``generic``."""
    ranked = [
        F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(language).alias("language"))
        for place, (language, score) in enumerate(language_scores(text).items())
    ]
    nothing = F.struct(F.lit(0).alias("score"), F.lit(1).alias("place"), F.lit(fixed.GENERIC).alias("language"))
    return F.greatest(nothing, *ranked)["language"]
