"""From RE2 patterns to the JVM's regular expressions.

``(?d)`` makes ``\\n`` the only line end, ``\\s`` is spelled out (the JVM's also takes VT), and ``\\b``, which the
patterns only use before an ASCII word character, becomes a look-behind because the JVM's counts accented letters in.
"""

WORD_START = "(?<![A-Za-z0-9_])"
SPACE = r"\t\n\f\r "
LINE_SPACE = r"\t\f\r "


def java(pattern: str, per_line: bool = False) -> str:
    """JVM form of an RE2 pattern.

    ``per_line`` matches each line of a whole text: ``^``/``$`` hold at every line and ``\\s`` stays inside the line,
    which also keeps a run of blank lines from being scanned once per line.
    """
    space = LINE_SPACE if per_line else SPACE
    body = pattern.replace(r"\b", WORD_START).replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
    if body.startswith("(?m)"):
        return "(?dm)" + body[4:]
    return ("(?dm)" if per_line else "(?d)") + body
