"""The registered queries once more, as plain SQL for an independent engine.

Patterns are the RE2 forms of ``fixed``; everything else is spelled in relational SQL (lines, windows, joins) and
shares no logic with the Spark expressions.
"""

from __future__ import annotations

import hashlib
import re

from stackloom.functions import fixed
from stackloom.operators.prompts import SYSTEM_PROMPT


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


WS = q(fixed.WHITE_SPACE)
WS_CLASS = r"[\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = "chr(10)"


def cut(col: str, n: int) -> str:
    """At most n bytes, whole characters."""
    hexed = f"hex(encode(left({col}, {n + 1})))"

    def continues(byte: int) -> str:
        return f"regexp_matches(substr({hexed}, {2 * byte - 1}, 1), '[89AB]')"

    keep = (
        f"CASE WHEN NOT {continues(n + 1)} THEN {n} WHEN NOT {continues(n)} THEN {n - 1} "
        f"WHEN NOT {continues(n - 1)} THEN {n - 2} ELSE {n - 3} END"
    )
    return f"CASE WHEN strlen({col}) <= {n} THEN {col} ELSE decode(unhex(left({hexed}, 2 * ({keep})))) END"


def excerpt(col: str, n: int) -> str:
    return f"CASE WHEN strlen({col}) <= {n} THEN {col} ELSE ({cut(col, n)}) || '{fixed.ELLIPSIS}' END"


def normalize(col: str) -> str:
    for pattern, replacement, _ in fixed.SIGNATURE_STEPS:
        col = f"regexp_replace({col}, {q(pattern)}, {q(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return f"trim(regexp_replace({col}, {q(WS_CLASS + '+')}, ' ', 'g'))"


def atoi(col: str) -> str:
    return f"coalesce(try_cast({col} AS BIGINT), 0)"


def stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%SZ')"


def choice(number: str, options: list[str]) -> str:
    cases = " ".join(f"WHEN {number} = {i} THEN {option}" for i, option in enumerate(options[:-1]))
    return f"CASE {cases} ELSE {options[-1]} END"


def _score(language: str) -> str:
    rules = [f"regexp_matches(text, {q(p)})::INT" for owner, p, _ in fixed.LANGUAGE_RULES if owner == language]
    return " + ".join(rules)


SCORES = ", ".join(f"{_score(name)} AS {name}_score" for name in fixed.LANGUAGE_PRIORITY)
BEST = "greatest(" + ", ".join(f"{name}_score" for name in fixed.LANGUAGE_PRIORITY) + ")"
LANGUAGE = (
    f"CASE WHEN {BEST} = 0 THEN 'generic' "
    + " ".join(f"WHEN {name}_score = {BEST} THEN '{name}'" for name in fixed.LANGUAGE_PRIORITY)
    + " END"
)


def _simple_frames(language: str, pattern: str, file: int, line: int, function: int = 0, module: int = 0) -> str:
    def part(group: int) -> str:
        return f"nullif(regexp_extract(line, {q(pattern)}, {group}), '')" if group else "NULL"

    return (
        f"SELECT doc_id, line_no, 0 AS idx, regexp_extract(line, {q(pattern)}, {file}) AS file, "
        f"{atoi(f'regexp_extract(line, {q(pattern)}, {line})')} AS line, {part(function)} AS function, {part(module)} AS module "
        f"FROM lang_lines WHERE language = '{language}' AND regexp_matches(line, {q(pattern)})"
    )


_GO = f"""
SELECT doc_id, line_no, 0 AS idx, regexp_extract(line, {q(fixed.GO_FRAME)}, 1) AS file,
  {atoi(f"regexp_extract(line, {q(fixed.GO_FRAME)}, 2)")} AS line,
  nullif(trim(regexp_replace(trim(call, {WS}), '\\(\\)$', ''), {WS}), '') AS function, NULL AS module
FROM (
  SELECT *, max_by(line, line_no) FILTER (WHERE is_call) OVER (PARTITION BY doc_id, seq) AS call
  FROM (
    SELECT *, coalesce(sum(is_frame::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq
    FROM (
      SELECT doc_id, line_no, line, regexp_matches(line, {q(fixed.GO_FRAME)}) AS is_frame,
        regexp_matches(line, {q(fixed.GO_CALL)}) AND NOT regexp_matches(line, {q(fixed.GO_FRAME)}) AS is_call
      FROM lang_lines WHERE language = 'go'
    )
  )
) WHERE is_frame"""

_NODE_CALL, _NODE = q(fixed.NODE_CALL_FRAME), q(fixed.NODE_FRAME)
_NODE_SQL = f"""
SELECT doc_id, line_no, 0 AS idx,
  CASE WHEN c THEN regexp_extract(line, {_NODE_CALL}, 2) ELSE regexp_extract(line, {_NODE}, 1) END AS file,
  {atoi(f"CASE WHEN c THEN regexp_extract(line, {_NODE_CALL}, 3) ELSE regexp_extract(line, {_NODE}, 2) END")} AS line,
  CASE WHEN c THEN regexp_extract(line, {_NODE_CALL}, 1) END AS function, NULL AS module
FROM (SELECT *, regexp_matches(line, {_NODE_CALL}) AS c FROM lang_lines WHERE language = 'node')
WHERE c OR regexp_matches(line, {_NODE})"""

_RUST_HEAD = f"""
SELECT doc_id, 0 AS line_no, 0 AS idx, regexp_extract(line, {q(fixed.RUST_PANIC)}, 1) AS file,
  {atoi(f"regexp_extract(line, {q(fixed.RUST_PANIC)}, 2)")} AS line, NULL AS function, NULL AS module
FROM lang_lines WHERE language = 'rust' AND line_no = 1 AND regexp_matches(line, {q(fixed.RUST_PANIC)})"""


def _event(parts: list[str]) -> str:
    return " || ".join(parts)


def _t(template: str) -> str:
    """A text with {expressions} as a SQL concatenation."""
    pieces = re.split(r"\{([^}]*)\}", template)
    sql = [q(p) if i % 2 == 0 else f"({p})::VARCHAR" for i, p in enumerate(pieces) if p != ""]
    return " || ".join(sql)


_TRACE_TEXTS = [
    "panic: runtime error: index out of range [{n % 9}]\n\ngoroutine {n} [running]:\nmain.{fn}(0x{lower(to_hex(n))})\n\t"
    "/workspace/src/doc_{file}.go:{line} +0x3a\nmain.{fn2}()\n\t/workspace/src/doc_{file + 14}.go:{line2} +0x12\n",
    'Traceback (most recent call last):\n  File "src/doc_{file}.py", line {line}, in {fn}\n    x[{n % 6}]\n'
    "IndexError: list index out of range",
    'Exception in thread "main" java.lang.NullPointerException\n\tat com.acme.Bar.{fn}(doc_{file}.java:{line})\n\t'
    "at java.base/java.lang.Thread.run(Thread.java:840)\nCaused by: java.io.IOException: pid={n}",
    "TypeError: Cannot read properties of null\n    at Object.{fn} (/home/ci/proj/src/doc_{file}.js:{line}:15)\n    "
    "at /home/ci/proj/src/doc_{file}.js:{line2}:3\n    at Module._compile (node:internal/modules/cjs/loader:1101:14)",
    "./src/doc_{file}.rb:{line}:in '{fn}'\nsrc/doc_{file}.rb:{line2}:in 'run': undefined method (NoMethodError)",
    "thread 'main' panicked at src/doc_{file}.rs:{line}:7:\nindex out of bounds\nstack backtrace:\n   0: rust_begin_unwind\n"
    "             at /rustc/abc/library/std/src/panicking.rs:645:5",
    "Unhandled exception. System.NullReferenceException: Object reference not set\n   at Acme.Program.{fn}() in "
    "/app/src/doc_{file}.cs:line {line}\n   at Acme.Program.Main() in /app/src/doc_{file + 14}.cs:line {line2}",
    "{event_type} failed near lib/part_{n % 25}.txt:{line} after helper.c:{line2}, code {n}",
]
_DEEP = (
    "('Traceback (most recent call last):' || chr(10) || array_to_string(list_transform(range(0, 30), lambda i: "
    "'  File \"src/doc_' || (7 * ((n + i) % 28) + 1) || '.py\", line ' || (1 + (n + i) % 40) || ', in f' || ((n + i) % 10)), chr(10)) "
    "|| chr(10) || 'KeyError: ' || n)"
)
_LATE = "(repeat('2024-01-01 00:00:00' || chr(10), 300) || chr(10) || chr(10) || 'E1')"
_LOG_TEXTS = [
    "connection {event_id % 97} refused pid={event_id}",
    "bad pointer 0x{lower(to_hex(event_id))} in unit {event_id % 89}",
    "worker [{event_id}] died at job.py:{event_id % 90}",
    "goroutine {event_id} stuck",
    "{event_type} failed at step {event_id % 83}",
]
_FILE_TEXTS = [
    "package p\n\nfunc {fn}(x int) {{\n{text}\n}}\n\nfunc (s *Server) {fn2}() {{\n}}\n",
    "import os\n\ndef {fn}(x):\n{text}\n\n    def {fn2}(y):\n",
    "public class Doc {{\npublic static int {fn} (int x) {{\n{text}\n}}\nvoid {fn2}() {{}}\n}}\n",
    "function {fn}(x) {{\n{text}\n}}\nconst my{fn2} = (y) => y;\n",
    "def {fn}(x)\n{text}\nend\n",
    "fn {fn}(x: i32) {{\n{text}\n}}\npub fn {fn2}() {{}}\n",
    "class Doc {{\npublic void {fn}() {{\n{text}\n}}\n}}\n",
]


def _f(template: str) -> str:
    """Like _t for templates whose own braces are doubled."""
    names = {"fn": "fn", "fn2": "fn2", "text": "text"}
    pieces = re.split(r"\{(fn|fn2|text)\}", template)
    sql = [
        names[p] if i % 2 else q(p.replace("{{", "{").replace("}}", "}")) for i, p in enumerate(pieces) if p != ""
    ]
    return " || ".join(sql)


def _path_case(prefixes: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(p, {q(x)}) THEN substr(p, {len(x) + 1})" for x in prefixes) + " END"


def clean(path: str) -> str:
    """No empty or '.' parts (the traces have no '..')."""
    return f"array_to_string(list_filter(string_split({path}, '/'), lambda x: x <> '' AND x <> '.'), '/')"


_GENERIC_BASES = ", ".join(q(b) for b in fixed.GENERIC_BASENAMES)
_GENERIC_SYMBOLS = ", ".join(q(s) for s in fixed.GENERIC_SYMBOLS)

# Definition patterns around a symbol, per language: text before and after it.
_WB = "([^a-zA-Z0-9_]|$)"
_MODIFIERS = "^(" + "|".join(fixed.DEFINITION_MODIFIERS) + ").*"
_QUOTED = r"regexp_replace(symbol, '([^A-Za-z0-9_])', '\\\1', 'g')"


def _defines() -> str:
    def pat(*parts: str) -> str:
        return " || ".join(_QUOTED if p == "@" else q(p) for p in parts)

    patterns = {
        "go": pat("^func ", "@", _WB + r"|^func \([^)]*\) ", "@", _WB),
        "python": pat(r"^[[:space:]]*def ", "@", _WB),
        "ruby": pat(r"^[[:space:]]*def ", "@", _WB),
        "rust": pat(r"^[[:space:]]*fn ", "@", _WB),
        "node": pat("function ", "@", r"\(|", "@", r" += +\("),
        "java": pat(_MODIFIERS, "@", r" *\("),
        "dotnet": pat(_MODIFIERS, "@", r" *\("),
    }
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in patterns.items()) + " END"


_EXT = "CASE language " + " ".join(f"WHEN '{k}' THEN '.{v}'" for k, v in fixed.DEFINITION_EXTENSION.items()) + " END"
_LABELS = "[" + ", ".join(q(x) for x in fixed.SECTION_LABELS) + "]"

def _logs(events: int) -> str:
    return f"""
SELECT 'log-' || log AS doc_id, string_agg(line, {NL} ORDER BY event_id) AS text, 'stdin' AS origin, max(ts) AS ts
FROM (
  SELECT event_id // {events} AS log, event_id, ts,
    strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'WARN' END || ' '
    || {choice("event_id % 5", [_t(x) for x in _LOG_TEXTS])}
    || CASE WHEN event_id % 35 = 0 THEN {q(chr(10) * 2 + "ERR 1" + chr(10))} WHEN event_id % 7 = 0 THEN {NL} ELSE '' END AS line
  FROM events
) GROUP BY log"""


def _lines(texts: str) -> str:
    return f"""
SELECT doc_id, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS line_no FROM {texts}"""


def _blocks(lines: str) -> str:
    return f"""
SELECT doc_id, block_no, string_agg(line, {NL} ORDER BY line_no) AS block
FROM (
  SELECT doc_id, line_no, line, sum((prev_blank OR starts)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS block_no
  FROM (
    SELECT *, lag(blank, 1, true) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev_blank
    FROM (
      SELECT *, trim(line, {WS}) = '' AS blank, regexp_matches(line, {q("^(?:" + fixed.BLOCK_START + ")")}) AS starts FROM {lines}
    )
  ) WHERE NOT blank
) GROUP BY doc_id, block_no"""


def _all_groups(blocks: str) -> str:
    return f"""
SELECT doc_id, signature, count(*) AS n, min(block_no) AS first_block, arg_min(rep, block_no) AS rep
FROM (SELECT doc_id, block_no, trim(block, {WS}) AS rep, {normalize(f"trim(block, {WS})")} AS signature FROM {blocks})
WHERE signature <> '' GROUP BY doc_id, signature"""


CTES: dict[str, str] = {
    # --- the derived inputs ---
    "logs": _logs(40),
    "traces": f"""
SELECT 'trace-' || n AS doc_id, n, CASE WHEN n % 40 = 1 THEN {_DEEP} WHEN n % 56 = 7 THEN {_LATE}
  ELSE {choice("n % 8", [_t(x) for x in _TRACE_TEXTS])} END AS text, 'inline' AS origin, ts, 'r' || (file % 2) AS repo
FROM (
  SELECT event_id AS n, event_type, ts, 7 * (event_id % 28) + event_id % 8 AS file, 1 + event_id % 40 AS line,
    3 + event_id % 17 AS line2, 'f' || (event_id % 10) AS fn, 'f' || ((event_id + 3) % 10) AS fn2
  FROM events
)""",
    "texts": """
SELECT 'doc-' || doc_id AS doc_id, text, 'logs/' || source || '.log' AS origin,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS ts
FROM documents""",
    "errors": """
SELECT doc_id, text, origin, ts FROM logs UNION ALL SELECT doc_id, text, origin, ts FROM traces
UNION ALL SELECT doc_id, text, origin, ts FROM texts""",
    "responses": f"""
SELECT 'trace-' || n AS doc_id, 'm1' AS model, CASE WHEN n % 13 = 0 THEN {_t(chr(110) + "o idea about {n}" + chr(10) + "EVIDENCE: none")}
  ELSE {_t("Sure.{chr(10)}WHAT HAPPENED:{chr(10)}event {n} failed{chr(10)}{chr(10)}PROBABLE CAUSE:{chr(10)}cause {n % 10}{chr(10)}{chr(10)}")}
  || {_t("## Evidence:{chr(10)}line {n % 40}{chr(10)}{chr(10)}- INVESTIGATE{chr(10)}check {event_type}{chr(10)}{chr(10)}")}
  || CASE WHEN n % 11 = 0 THEN {_t("PROBABLE CAUSE:{chr(10)}second cause {n % 4}{chr(10)}{chr(10)}")} ELSE '' END
  || {_t("**Potential fixes:{chr(10)}- fix {n % 3}{chr(10)}- retry{chr(10)}")} END AS content
FROM (SELECT event_id AS n, event_type FROM events)""",
    "replies": """
SELECT doc_id, content, model FROM responses
UNION ALL SELECT 'turn-' || conv_id || '-' || turn AS doc_id, text AS content, 'm0' AS model FROM conversations""",
    "files": f"""
SELECT 'r' || (n % 2) AS repo, 'src/doc_' || n || '.' || {choice("n % 7", [q(x) for x in ("go", "py", "java", "js", "rb", "rs", "cs")])} AS path,
  {choice("n % 7", [_f(x) for x in _FILE_TEXTS])} AS content
FROM (SELECT doc_id AS n, CASE WHEN doc_id % 500 = 0 THEN repeat(text || chr(10), 2200000 // (strlen(text) + 1) + 1) ELSE text END AS text, 'f' || (doc_id % 10) AS fn, 'f' || ((doc_id + 1) % 10) AS fn2 FROM documents)""",
    "file_lines": f"""
SELECT repo, path, unnest(string_split(content, {NL})) AS text, generate_subscripts(string_split(content, {NL}), 1) AS line_no
FROM files""",
    "file_sizes": f"SELECT repo, path, len(string_split(content, {NL})) AS n_lines FROM files",
    "priors_of": """
SELECT vec_id, 'trace-' || vec_id AS doc_id, embedding::DOUBLE[] AS e,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(vec_id) AS seen FROM embeddings""",
    "timed": """
SELECT vec_id, doc_id, e, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(vec_id // 5) AS at_time FROM priors_of""",
    # --- texts ---
    "lines": _lines("errors"),
    "blocks": _blocks("lines"),
    "all_groups": _all_groups("blocks"),
    "big_logs": _logs(4000),
    "big_lines": _lines("big_logs"),
    "thousands": _logs(1000),
    "thousand_lines": _lines("thousands"),
    "big_blocks": _blocks("big_lines"),
    "big_groups": _all_groups("big_blocks"),
    "groups": f"""
SELECT doc_id, rank, signature, n AS count, rep AS representative
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_block) AS rank FROM all_groups
  WHERE n > 1 OR strlen(rep) >= {fixed.NOISE_BYTES})""",
    "signatures": f"""
SELECT e.doc_id, e.ts, coalesce(g.signature, {normalize("e.text")}) AS signature, coalesce(g.representative, e.text) AS representative
FROM errors e LEFT JOIN (SELECT * FROM groups WHERE rank = 1) g ON e.doc_id = g.doc_id""",
    # --- language and frames ---
    "scores": f"SELECT doc_id, {SCORES} FROM errors",
    "languages": f"SELECT doc_id, {LANGUAGE} AS language FROM scores",
    "lang_lines": "SELECT l.doc_id, l.line_no, l.line, g.language FROM lines l JOIN languages g ON l.doc_id = g.doc_id",
    "own_frames": " UNION ALL ".join(
        [
            _GO,
            _simple_frames("python", fixed.PYTHON_FRAME, 1, 2, 3),
            _simple_frames("java", fixed.JAVA_FRAME, 3, 4, 2, 1),
            _NODE_SQL,
            _simple_frames("ruby", fixed.RUBY_FRAME, 1, 2, 3),
            _RUST_HEAD,
            _simple_frames("rust", fixed.RUST_FRAME, 1, 2),
            _simple_frames("dotnet", fixed.DOTNET_FRAME, 2, 3, 1),
        ]
    ),
    "swept_frames": f"""
SELECT doc_id, min(spot).line_no AS line_no, min(spot).idx AS idx, file, line, NULL AS function, NULL AS module
FROM (
  SELECT doc_id, {{'line_no': line_no, 'idx': idx}} AS spot, regexp_extract(hit, '(?s)^(.*):\\d+$', 1) AS file,
    {atoi("regexp_extract(hit, ':(\\d+)$', 1)")} AS line
  FROM (
    SELECT doc_id, line_no, unnest(regexp_extract_all(line, {q(fixed.GENERIC_FRAME)})) AS hit,
      generate_subscripts(regexp_extract_all(line, {q(fixed.GENERIC_FRAME)}), 1) AS idx
    FROM lang_lines WHERE doc_id NOT IN (SELECT doc_id FROM own_frames)
  )
) GROUP BY doc_id, file, line""",
    "frames": f"""
SELECT f.doc_id, g.language, pos::INT AS pos, file, line, function, module
FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, idx) - 1 AS pos
  FROM (SELECT * FROM own_frames UNION ALL SELECT * FROM swept_frames)
) f JOIN languages g ON f.doc_id = g.doc_id""",
    "json_contexts": """
SELECT e.doc_id, CASE WHEN g.language = 'generic' AND f.j IS NULL AND r.j IS NULL THEN '' ELSE
  '{"language":"' || g.language || '"' || coalesce(',"stack_frames":[' || f.j || ']', '')
  || coalesce(',"error_groups":[' || r.j || ']', '') || '}' END AS context_json
FROM errors e JOIN languages g ON e.doc_id = g.doc_id
LEFT JOIN (
  SELECT doc_id, string_agg('{"file":' || to_json(file)::VARCHAR || ',"line":' || line
    || coalesce(',"function":' || to_json(function)::VARCHAR, '') || coalesce(',"module":' || to_json(module)::VARCHAR, '')
    || '}', ',' ORDER BY pos) AS j FROM frames GROUP BY doc_id
) f ON e.doc_id = f.doc_id
LEFT JOIN (
  SELECT doc_id, string_agg('{"signature":' || to_json(signature)::VARCHAR || ',"count":' || count || ',"representative":'
    || to_json(representative)::VARCHAR || '}', ',' ORDER BY rank) AS j FROM groups GROUP BY doc_id
) r ON e.doc_id = r.doc_id""",
    # --- repository ---
    "trace_frames": "SELECT f.*, t.repo FROM frames f JOIN traces t ON f.doc_id = t.doc_id",
    "base_candidates": f"""
SELECT repo, file, doc_id, pos, kind, name, ord FROM (
  SELECT repo, file, doc_id, pos, 'path' AS kind, {clean(_path_case(fixed.CONTAINER_PREFIXES))} AS name, -2 AS ord FROM (SELECT *, trim(file, {WS}) AS p FROM trace_frames)
  UNION ALL SELECT repo, file, doc_id, pos, 'path', {clean("p")}, -1 FROM (SELECT *, trim(file, {WS}) AS p FROM trace_frames)
  UNION ALL SELECT repo, file, doc_id, pos, 'path', {clean("array_to_string(string_split(p, '/')[i + 1:], '/')")}, i FROM (
    SELECT *, unnest(range(1, len(string_split(p, '/')))) AS i FROM (SELECT *, trim(file, {WS}) AS p FROM trace_frames))
  UNION ALL SELECT repo, file, doc_id, pos, 'base', regexp_extract(p, '([^/]*)/*$', 1), 1000 FROM (SELECT *, trim(file, {WS}) AS p FROM trace_frames)
) WHERE name IS NOT NULL AND name <> '' AND (kind = 'path' OR name NOT IN ({_GENERIC_BASES}))""",
    "single_names": """
SELECT repo, regexp_extract(path, '([^/]*)$', 1) AS name, min(path) AS path FROM files GROUP BY ALL HAVING count(*) = 1""",
    "resolved": """
SELECT c.doc_id, c.repo, c.pos, c.file, arg_min(coalesce(f.path, b.path), c.ord) AS path
FROM base_candidates c
LEFT JOIN files f ON c.kind = 'path' AND f.repo = c.repo AND f.path = c.name
LEFT JOIN single_names b ON c.kind = 'base' AND b.repo = c.repo AND b.name = c.name
WHERE coalesce(f.path, b.path) IS NOT NULL
GROUP BY c.doc_id, c.repo, c.pos, c.file""",
    "symbol_rows": f"""
SELECT doc_id, repo, language, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS seq, symbol FROM (
  SELECT doc_id, repo, language, symbol, min(pos) AS first FROM (
    SELECT doc_id, repo, language, pos, regexp_replace(string_split(trim(function, {WS}), '.')[-1], '\\(\\)$', '') AS symbol
    FROM trace_frames WHERE function IS NOT NULL
  ) WHERE symbol <> '' AND lower(symbol) NOT IN ({_GENERIC_SYMBOLS}) GROUP BY ALL
)""",
    "mentions": f"""
SELECT s.*, l.path, l.line_no, l.text
FROM (SELECT DISTINCT repo, language, symbol, {_EXT} AS ext FROM symbol_rows WHERE language <> 'generic') s
JOIN file_lines l ON l.repo = s.repo AND ends_with(l.path, s.ext) AND contains(l.text, s.symbol)""",
    "definitions": f"""
SELECT repo, language, symbol, min(spot).path AS path, min(spot).line_no AS line_no FROM (
  SELECT repo, language, symbol, {{'path': path, 'line_no': line_no}} AS spot FROM mentions WHERE regexp_matches(text, {_defines()})
) GROUP BY repo, language, symbol""",
    "frame_marks": """
SELECT r.doc_id, r.repo, 0 AS kind, r.pos, r.path, f.line FROM resolved r JOIN frames f ON r.doc_id = f.doc_id AND r.pos = f.pos""",
    "symbol_hits": """
SELECT s.doc_id, s.repo, 1 AS kind, s.seq AS pos, d.path, d.line_no AS line
FROM symbol_rows s JOIN definitions d ON s.repo = d.repo AND s.language = d.language AND s.symbol = d.symbol""",
    "marks": """
SELECT doc_id, repo, kind, pos, path, line FROM frame_marks UNION ALL SELECT doc_id, repo, kind, pos, path, line FROM symbol_hits""",
    "windows": f"""
SELECT w.doc_id, w.repo, w.file_rank, w.path, w.marked, greatest(w.lo - w.half, 1) AS start_line, least(w.hi + w.half, s.n_lines) AS end_line
FROM (
  SELECT doc_id, repo, path, list_sort(list(DISTINCT line)) AS marked, min(line) AS lo, max(line) AS hi,
    max(CASE WHEN kind = 0 THEN {fixed.CONTEXT_LINES} ELSE {fixed.SYMBOL_LINES} END) AS half,
    row_number() OVER (PARTITION BY doc_id ORDER BY min(kind * 1000 + pos)) AS file_rank
  FROM marks GROUP BY doc_id, repo, path
) w JOIN file_sizes s ON s.repo = w.repo AND s.path = w.path""",
    "window_texts": f"""
SELECT w.doc_id, w.file_rank, '### ' || w.path || ' (lines ' || w.start_line || '-' || w.end_line || '; marked: '
  || array_to_string(w.marked, ',') || ')' || {NL}
  || coalesce(string_agg(CASE WHEN list_contains(w.marked, l.line_no) THEN '> ' ELSE '  ' END
  || CASE WHEN l.line_no < 10000 THEN lpad(l.line_no::VARCHAR, 4, ' ') ELSE l.line_no::VARCHAR END || ' | ' || l.text || {NL}, '' ORDER BY l.line_no), '') AS block
FROM windows w LEFT JOIN file_lines l ON l.repo = w.repo AND l.path = w.path AND l.line_no BETWEEN w.start_line AND w.end_line
GROUP BY w.doc_id, w.file_rank, w.path, w.start_line, w.end_line, w.marked""",
    # --- recall ---
    "scored": """
SELECT a.doc_id, a.seen AS asked_at, b.vec_id AS id, b.seen, list_cosine_similarity(a.e, b.e) AS score FROM priors_of a, priors_of b""",
    "priors": """
SELECT doc_id, rank, id, score, 1 + id % 5 AS count, seen + INTERVAL 1 DAY AS last_seen, 'cause ' || (id % 10) AS cause,
  CASE WHEN id % 4 = 0 THEN '' ELSE '- fix ' || (id % 3) END AS fixes
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, id) AS rank FROM scored WHERE round(score, 12) >= 0.3)
WHERE rank <= 3""",
    "priors_before": """
SELECT doc_id, rank, id, score, 1 + id % 5 AS count, seen + INTERVAL 1 DAY AS last_seen, 'cause ' || (id % 10) AS cause,
  CASE WHEN id % 4 = 0 THEN '' ELSE '- fix ' || (id % 3) END AS fixes
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, id) AS rank FROM scored
  WHERE round(score, 12) >= 0.3 AND seen < asked_at) WHERE rank <= 3""",
    # sides of random planes; a key is the sum of 2 ** bit over the planes a vector is on the upper side of
    "key_bits": "SELECT least(40, greatest(1, ceil(log2(count(*) / 32))))::BIGINT AS bits FROM priors_of",
    "sides": """
SELECT v.vec_id, p.t, p.b, round(list_sum(list_transform(v.e, lambda x, d: x * p.signs[d])) / sqrt(list_sum(list_transform(v.e, lambda x: x * x))), 9) AS away
FROM priors_of v, (
  SELECT t, b, list_transform(range(0, 64), lambda d: CASE WHEN ('0x' || substr(md5(t || ',' || b || ',' || d), 1, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS signs
  FROM (SELECT unnest(range(0, 8)) AS t), (SELECT unnest(range(0, bits)) AS b FROM key_bits)
) p""",
    "own_keys": "SELECT vec_id, t, sum(CASE WHEN away >= 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS key FROM sides GROUP BY vec_id, t",
    "probe_keys": """
SELECT k.vec_id, k.t, xor(k.key, coalesce(list_sum(list_transform(range(1, len(n.near) + 1), lambda i: CASE WHEN (c.c >> (i - 1)) % 2 = 1 THEN 1::BIGINT << n.near[i] ELSE 0 END)), 0)::BIGINT) AS key
FROM own_keys k JOIN (
  SELECT vec_id, t, list(b ORDER BY place) AS near
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, t ORDER BY abs(away), b) AS place FROM sides) WHERE place <= 3 GROUP BY vec_id, t
) n ON n.vec_id = k.vec_id AND n.t = k.t, (SELECT unnest(range(0, 8)) AS c) c""",
    "met": "SELECT DISTINCT a.vec_id AS asked, b.vec_id AS id FROM probe_keys a JOIN own_keys b ON a.t = b.t AND a.key = b.key",
    "priors_met": """
SELECT doc_id, rank, id, score, 1 + id % 5 AS count, seen + INTERVAL 1 DAY AS last_seen, 'cause ' || (id % 10) AS cause,
  CASE WHEN id % 4 = 0 THEN '' ELSE '- fix ' || (id % 3) END AS fixes
FROM (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(score, 12) DESC, s.id) AS rank
  FROM scored s JOIN met m ON s.doc_id = 'trace-' || m.asked AND s.id = m.id WHERE round(score, 12) >= 0.3)
WHERE rank <= 3""",
    "prior_texts": f"""
SELECT doc_id, {q(fixed.PRIORS_OPEN)} || string_agg('[' || rank || '] similarity ' || format('{{:.2f}}', score) || ', seen ' || count
  || ' time(s), last ' || strftime(last_seen, '%Y-%m-%d') || {NL}
  || CASE WHEN cause <> '' THEN 'PROBABLE CAUSE: ' || cause || {NL} ELSE '' END
  || CASE WHEN fixes <> '' THEN 'POTENTIAL FIXES: ' || fixes || {NL} ELSE '' END, '' ORDER BY rank) || {q(fixed.PRIORS_CLOSE)} AS prior_block
FROM priors GROUP BY doc_id""",
    # --- history ---
    "seen": f"""
SELECT s.doc_id, s.ts, s.signature, s.representative, g.language, 'cause of ' || s.doc_id AS cause, '- fix' AS fixes, 'm1' AS model,
  (strlen(e.text) % 10)::DOUBLE AS v1
FROM signatures s JOIN languages g ON s.doc_id = g.doc_id JOIN errors e ON e.doc_id = s.doc_id""",
    "sections": f"""
SELECT doc_id, (section - 1)::INT AS pos, max(label) AS title,
  coalesce(trim(string_agg(line, {NL} ORDER BY line_no) FILTER (WHERE label IS NULL), {WS}), '') AS body
FROM (
  SELECT *, count(label) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM (
    SELECT doc_id, line, line_no,
      list_filter({_LABELS}, lambda x: title = x OR starts_with(title, x || ' '))[1] AS label
    FROM (
      SELECT *, upper(rtrim(trim(ltrim(line, ' ' || chr(9) || '#*-'), {WS}), ':')) AS title FROM (
        SELECT doc_id, unnest(string_split(content, {NL})) AS line, generate_subscripts(string_split(content, {NL}), 1) AS line_no FROM replies
      )
    )
  )
) WHERE section > 0 GROUP BY doc_id, section""",
    "summaries": f"""
SELECT r.doc_id, r.model, coalesce(c.body, '') AS cause, coalesce(f.body, '') AS fixes
FROM replies r
LEFT JOIN (SELECT doc_id, arg_max(body, pos) AS body FROM sections WHERE title = '{fixed.CAUSE_LABEL}' GROUP BY doc_id) c ON r.doc_id = c.doc_id
LEFT JOIN (SELECT doc_id, arg_max(body, pos) AS body FROM sections WHERE title = '{fixed.FIXES_LABEL}' GROUP BY doc_id) f ON r.doc_id = f.doc_id""",
}

# 64-bit FNV-1a with 128-bit arithmetic.
FNV = (
    "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), "
    "lambda b: ('0x' || b)::INT::UHUGEINT)), "
    "lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::VARCHAR"
)


def _history(rows: str) -> str:
    """SQL for the fold of occurrences."""
    return f"""
SELECT {FNV.format("signature")} AS sig_id, signature, spot.representative AS representative, spot.language AS language, spot.cause AS cause,
  spot.fixes AS fixes, spot.model AS model, n AS count, {stamp("first_seen")} AS first_seen, {stamp("last_seen")} AS last_seen, spot.v1 AS embedding_1
FROM (
  SELECT signature, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen,
    arg_max({{'representative': representative, 'language': language, 'cause': cause, 'fixes': fixes, 'model': model, 'v1': v1}},
      {{'ts': ts, 'doc': doc_id}}) AS spot
  FROM ({rows}) WHERE signature <> '' GROUP BY signature
)"""


def _priors(cte: str) -> str:
    return f"""SELECT doc_id, rank::INT AS rank, id::VARCHAR AS sig_id, round(score, 6) AS score, count,
  strftime(last_seen, '%Y-%m-%d') AS last_seen, cause, fixes FROM {cte}"""


def _source(max_bytes: int) -> str:
    return f"""
SELECT doc_id, CASE WHEN count(block) FILTER (WHERE total <= {max_bytes}) = 0 THEN '' ELSE
    rtrim(string_agg(block || {NL}, '' ORDER BY file_rank) FILTER (WHERE total <= {max_bytes}), {NL})
    || CASE WHEN max(total) > {max_bytes} THEN {q(fixed.SOURCE_TRUNCATED)} ELSE '' END END AS source_block,
  (count(block) FILTER (WHERE total <= {max_bytes}))::INT AS files, coalesce(max(total) FILTER (WHERE total <= {max_bytes}), 0)::BIGINT AS bytes,
  max(total) > {max_bytes} AS truncated
FROM (SELECT *, sum(strlen(block)) OVER (PARTITION BY doc_id ORDER BY file_rank) AS total FROM window_texts)
GROUP BY doc_id"""


_TRACES = "doc_id LIKE 'trace-%'"
_OCCURRENCE = f"""
SELECT doc_id, ts, signature, row_number() OVER w AS occurrence, lag(ts) OVER w AS previous_ts
FROM seen WHERE {_TRACES} WINDOW w AS (PARTITION BY signature ORDER BY ts, doc_id)"""

SELECTS: dict[str, str] = {
    "literal_texts": "SELECT n_nationkey::VARCHAR AS doc_id, n_name AS text, 'inline' AS origin, false AS truncated FROM nation",
    "error_files": "SELECT substr(doc_id, 5)::BIGINT AS log, (strlen(text) + 1)::BIGINT AS bytes, md5(text || chr(10)) AS text_md5, false AS truncated FROM thousands",
    "stream_error_files": "SELECT substr(doc_id, 5)::BIGINT AS log, (strlen(text) + 1)::BIGINT AS bytes, md5(text || chr(10)) AS text_md5, false AS truncated FROM thousands",
    "cap_input": f"SELECT doc_id, origin, strlen(text) > 2000 AS truncated, {cut('text', 2000)} AS text FROM errors",
    "source_lines": "SELECT repo, path, line_no, text FROM file_lines",
    "excerpt_bytes": f"SELECT doc_id, {excerpt('text', 500)} AS excerpt FROM errors",
    "normalize_signature": f"SELECT doc_id, {normalize('text')} AS signature FROM errors",
    "signature_id": f"SELECT DISTINCT signature, {FNV.format('signature')} AS sig_id FROM signatures",
    "numbered_lines": "SELECT doc_id, line_no, line FROM lines",
    "split_blocks": "SELECT doc_id, block_no::INT AS block_no, block FROM blocks",
    "error_groups": "SELECT doc_id, rank::INT AS rank, signature, count, representative FROM groups",
    "error_groups_top": f"SELECT doc_id, rank::INT AS rank, signature, count, {excerpt('representative', 500)} AS representative FROM groups WHERE rank <= 20",
    "log_file_groups": f"""
SELECT substr(doc_id, 5)::BIGINT AS log, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_block))::INT AS rank, signature, n AS count,
  rep AS representative
FROM big_groups WHERE n > 1 OR strlen(rep) >= {fixed.NOISE_BYTES}""",
    "log_groups_merged": f"""
SELECT substr(doc_id, 5)::BIGINT AS log, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_block))::INT AS rank, {cut("signature", 50)} AS signature,
  n AS count, {cut("rep", 50)} AS representative
FROM big_groups WHERE n > 1 OR strlen(rep) >= {fixed.NOISE_BYTES}""",
    "doc_signature": "SELECT doc_id, signature, representative FROM signatures",
    "embed_text": """SELECT e.doc_id, coalesce(g.representative, e.text) AS embed_text
FROM errors e LEFT JOIN (SELECT * FROM groups WHERE rank = 1) g ON e.doc_id = g.doc_id""",
    "error_families": f"""SELECT signature, sum(n)::BIGINT AS occurrences, count(*) AS documents, {stamp("min(ts)")} AS first_seen,
  {stamp("max(ts)")} AS last_seen FROM all_groups g JOIN errors e ON g.doc_id = e.doc_id GROUP BY signature
HAVING sum(n) > 1 OR max(strlen(rep)) >= 8""",
    "detect_language": "SELECT doc_id, language FROM languages",
    "language_scores": "SELECT * FROM scores",
    "rule_scores": "SELECT * FROM scores",
    "rule_language": "SELECT doc_id, language FROM languages",
    "language_mix": "SELECT language, count(*) AS documents FROM languages GROUP BY language",
    "parse_frames": "SELECT doc_id, language, pos, file, line, function, module FROM frames",
    **{
        f"frames_{name}": f"SELECT doc_id, pos, file, line, function, module FROM frames WHERE language = '{name}'"
        for name in (*fixed.LANGUAGE_PRIORITY, fixed.GENERIC)
    },
    "frame_hotspots": "SELECT file, line, count(*) AS hits FROM frames GROUP BY file, line",
    "context_json": "SELECT doc_id, context_json FROM json_contexts",
    "path_candidates": """SELECT doc_id, pos, (row_number() OVER (PARTITION BY doc_id, pos ORDER BY ord) - 1)::INT AS priority, kind, name
FROM base_candidates""",
    "unique_basenames": "SELECT repo, name, path FROM single_names",
    "resolve_paths": """SELECT r.doc_id, r.repo, r.pos, r.file, f.line, r.path, s.n_lines::INT AS n_lines FROM resolved r
JOIN frames f ON r.doc_id = f.doc_id AND r.pos = f.pos JOIN file_sizes s ON s.repo = r.repo AND s.path = r.path""",
    "resolve_indexed": """SELECT r.doc_id, r.repo, r.pos, r.file, f.line, r.path, s.n_lines::INT AS n_lines FROM resolved r
JOIN frames f ON r.doc_id = f.doc_id AND r.pos = f.pos JOIN file_sizes s ON s.repo = r.repo AND s.path = r.path""",
    "unresolved_frames": """SELECT t.doc_id, t.repo, t.pos, t.file, t.line FROM trace_frames t
WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.doc_id = t.doc_id AND r.pos = t.pos)""",
    "docs_with_source": f"SELECT doc_id, {stamp('ts')} AS ts FROM traces WHERE doc_id IN (SELECT doc_id FROM resolved)",
    "frame_symbols": f"""SELECT doc_id, pos, function, coalesce(regexp_replace(string_split(trim(function, {WS}), '.')[-1], '\\(\\)$', ''), '') AS symbol
FROM trace_frames""",
    "collect_symbols": "SELECT doc_id, repo, language, seq, symbol FROM symbol_rows",
    "symbol_defs": "SELECT repo, language, symbol, path, line_no::INT AS line_no FROM definitions",
    "source_windows": """SELECT doc_id, file_rank::INT AS file_rank, path, array_to_string(marked, ',') AS marked, start_line::BIGINT AS start_line,
  end_line::BIGINT AS end_line FROM windows""",
    "source_blocks": _source(2**62),
    "source_budget": f"SELECT doc_id, files, bytes, truncated FROM ({_source(4000)})",
    "recall_topk": _priors("priors"),
    "recall_blocked": _priors("priors"),
    "recall_tree": _priors("priors"),
    "recall_approx": _priors("priors_met"),
    "recall_as_of": _priors("priors_before"),
    "recall_in_turn": f"""
SELECT doc_id, rank::INT AS rank, round(score, 6) AS score, count, strftime(seen, '%Y-%m-%d') AS last_seen, cause, fixes FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC) AS rank FROM (
    SELECT q.doc_id, list_cosine_similarity(q.e, v.e) AS score, v.count, v.at_time AS seen, 'cause ' || (v.vec_id % 10) AS cause,
      CASE WHEN v.vec_id % 4 = 0 THEN '' ELSE '- fix ' || (v.vec_id % 3) END AS fixes
    FROM timed q JOIN (
      SELECT p.*, row_number() OVER w AS count, lead(at_time) OVER w AS next_time, lead(doc_id) OVER w AS next_doc
      FROM timed p JOIN embeddings m ON m.vec_id = p.vec_id WINDOW w AS (PARTITION BY m.label ORDER BY at_time, doc_id)
    ) v ON (v.at_time < q.at_time OR (v.at_time = q.at_time AND v.doc_id < q.doc_id))
      AND (v.next_time IS NULL OR v.next_time > q.at_time OR (v.next_time = q.at_time AND v.next_doc >= q.doc_id))
  ) WHERE round(score, 12) >= 0.3
) WHERE rank <= {fixed.RECALL_K}""",
    "recall_threshold": f"""SELECT doc_id, rank::INT AS rank, id::VARCHAR AS sig_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC, id) AS rank FROM (
    SELECT 'near-' || a.vec_id AS doc_id, b.vec_id AS id, list_cosine_similarity(
      list_transform(a.e, lambda x, i: x + ((a.vec_id + i - 1) % 5 - 2) * 0.02::DOUBLE), b.e) AS score FROM priors_of a, priors_of b)
  WHERE round(score, 12) >= {fixed.RECALL_THRESHOLD}) WHERE rank <= {fixed.RECALL_K}""",
    "dimension_check": "SELECT len(embedding)::INT AS dim, count(*) AS vectors FROM embeddings GROUP BY 1",
    "hash_embed": """SELECT * FROM (
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM errors),
b AS (SELECT doc_id, ('0x' || substr(md5(unnest(words)), 1, 8))::BIGINT % 64 AS place FROM w),
c AS (SELECT doc_id, place, count(*) AS n FROM b GROUP BY 1, 2),
v AS (SELECT doc_id, map_from_entries(list((place, n))) AS m, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1)
SELECT w.doc_id, CASE WHEN v.m IS NULL THEN 0 ELSE 64 END AS dim, CASE WHEN v.m IS NULL THEN '' ELSE
  array_to_string(list_transform(range(0, 64), lambda i: round(coalesce(m[i], 0) / norm * 1000000)::BIGINT::VARCHAR), ',') END AS millionths
FROM w LEFT JOIN v ON v.doc_id = w.doc_id)""",
    "prior_blocks": "SELECT doc_id, prior_block FROM prior_texts",
    "history_new": _history(f"SELECT * FROM seen WHERE {_TRACES}"),
    "history_upsert": _history("SELECT * FROM seen UNION ALL SELECT * FROM seen WHERE doc_id LIKE 'log-%'"),
    "history_keyed": _history("SELECT * FROM seen UNION ALL SELECT * FROM seen WHERE doc_id LIKE 'log-%'"),
    "history_lookup": f"""SELECT * FROM ({_history("SELECT * FROM seen UNION ALL SELECT * FROM seen WHERE doc_id LIKE 'log-%'")})
WHERE signature IN (SELECT signature FROM seen WHERE {_TRACES})""",
    "history_payloads": f"""SELECT event_id::VARCHAR AS sig_id, 'family ' || (event_id % 100) AS signature, 'r' AS representative, 'go' AS language,
  CASE WHEN event_id % 12 = 5 THEN '' ELSE 'cause ' || (event_id % 10) END AS cause, CASE WHEN event_id % 8 = 0 THEN '' ELSE '- fix' END AS fixes, 'm1' AS model,
  CASE WHEN event_id % 6 IN (0, 1) THEN 0 ELSE event_id % 50 END AS count,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE {stamp("ts")} END AS first_seen, {stamp("ts")} AS last_seen, (event_id % 10)::DOUBLE AS embedding_1
FROM events""",
    "history_rejected": """SELECT doc_id, CASE WHEN signature = '' THEN 'refusing to store an empty signature' ELSE 'empty vector' END AS reason
FROM seen WHERE signature = '' OR length(cause) % 2 = 0""",
    "occurrence_number": f"SELECT doc_id, signature, occurrence, {stamp('previous_ts')} AS previous_ts FROM ({_OCCURRENCE})",
    "recurrence_gap": f"""SELECT signature, count(*) AS recurrences, round(min(gap), 3) AS min_gap_sec, round(max(gap), 3) AS max_gap_sec FROM (
  SELECT signature, (epoch_us(ts) - epoch_us(previous_ts)) / 1000000 AS gap FROM ({_OCCURRENCE}) WHERE previous_ts IS NOT NULL
) GROUP BY signature""",
    "parse_sections": "SELECT doc_id, pos, title, body FROM sections",
    "cause_fixes": "SELECT doc_id, model, cause, fixes FROM summaries",
    "build_prompts": f"""SELECT t.doc_id, '{hashlib.md5(SYSTEM_PROMPT.encode()).hexdigest()}' AS instruction_md5,
  CASE t.n % 4 WHEN 0 THEN {q(fixed.NOTE_STDIN)} WHEN 1 THEN {q(fixed.NOTE_FILE)} || 'logs/' || t.n || '.log' ELSE {q(fixed.NOTE_INLINE)} END
  || CASE WHEN t.n % 6 = 0 THEN {q(fixed.NOTE_TRUNCATED)} ELSE '' END || {NL} || {NL}
  || CASE WHEN c.context_json <> '' THEN {q(fixed.CONTEXT_OPEN)} || c.context_json || {q(fixed.CONTEXT_CLOSE)} ELSE '' END
  || CASE WHEN s.source_block <> '' THEN {q(fixed.SOURCE_OPEN)} || s.source_block || {q(fixed.SOURCE_CLOSE)} ELSE '' END
  || coalesce(p.prior_block || {NL} || {NL}, '') || {q(fixed.INPUT_OPEN)} || t.text || {q(fixed.INPUT_CLOSE)} AS user_prompt
FROM traces t JOIN json_contexts c ON t.doc_id = c.doc_id LEFT JOIN ({_source(2**62)}) s ON s.doc_id = t.doc_id
LEFT JOIN prior_texts p ON p.doc_id = t.doc_id""",
    "explained_history": _history(
        f"SELECT s.* EXCLUDE (cause, fixes, model), m.cause, m.fixes, m.model FROM seen s JOIN summaries m ON s.doc_id = m.doc_id WHERE s.{_TRACES}"
    ),
    "stream_analysis": f"SELECT doc_id, language, pos, file, line, function, module FROM frames WHERE {_TRACES}",
    "stream_family_counts": f"""SELECT {stamp("date_trunc('hour', ts)")} AS window_start, signature, sum(g.n)::BIGINT AS occurrences, count(*) AS documents
FROM all_groups g JOIN traces e ON g.doc_id = e.doc_id GROUP BY ALL HAVING sum(g.n) > 1 OR max(strlen(rep)) >= 8""",
    "stream_history": _history(f"SELECT * FROM seen WHERE {_TRACES}"),
    "stream_occurrence_number": f"SELECT doc_id, signature, occurrence, {stamp('previous_ts')} AS previous_ts FROM ({_OCCURRENCE})",
    "stream_log_lines": """SELECT substr(doc_id, 5)::BIGINT AS log,
  coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", line
FROM thousand_lines""",
    "stream_recall": f"""
SELECT doc_id, rank::INT AS rank, round(score, 6) AS score, count, strftime(seen, '%Y-%m-%d') AS last_seen, cause, fixes FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 12) DESC) AS rank FROM (
    SELECT q.doc_id, list_cosine_similarity(q.e, v.e) AS score, t.count, v.at_time AS seen, 'cause ' || (v.vec_id % 10) AS cause,
      CASE WHEN v.vec_id % 4 = 0 THEN '' ELSE '- fix ' || (v.vec_id % 3) END AS fixes
    FROM timed q JOIN (
      SELECT turn, m.label, count(*) AS count, arg_max(p.vec_id, {{'at': p.at_time, 'id': p.doc_id}}) AS last
      FROM timed p JOIN embeddings m ON m.vec_id = p.vec_id, (SELECT unnest(range(0, 4)) AS turn)
      WHERE p.vec_id % 4 < turn GROUP BY turn, m.label
    ) t ON t.turn = q.vec_id % 4 JOIN timed v ON v.vec_id = t.last
  ) WHERE round(score, 12) >= 0.3
) WHERE rank <= {fixed.RECALL_K}""",
}


def _with(select: str) -> str:
    """The select with the views it needs, in the order they build on each other."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", sql):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(select)
    views = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name].strip()})" for name in needed)
    return f"WITH {views}\n{select.strip()}" if views else select


ORACLES: dict[str, str] = {name: _with(select) for name, select in SELECTS.items()}
