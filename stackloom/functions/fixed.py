"""Values that results depend on.

Everything in this module is a FIXED VALUE: limits, word lists, labels and patterns that must be exactly these for
results to be right.  Patterns are written in RE2 syntax; ``dialect.java`` turns them into the JVM dialect.
"""

# --- fixed values: limits and defaults of recall and of windows ------------------------------------------------------
NOISE_BYTES = 8
CONTEXT_LINES = 10
SYMBOL_LINES = 5
RECALL_K = 3
RECALL_THRESHOLD = 0.85
ELLIPSIS = "…"

# --- fixed values: language rules (language, pattern, text every match contains) -------------------------------------
LANGUAGE_RULES = (
    ("go", r"\bpanic:\s", "panic:"),
    ("go", r"\bgoroutine\s+\d+\s", "goroutine"),
    ("go", r"\[recovered\]", "[recovered]"),
    ("go", r"/usr/local/go/src/", "/usr/local/go/src/"),
    ("go", r"\bcreated by ", "created by "),
    ("go", r"\.go:\d+", ".go:"),
    ("python", r"Traceback \(most recent call last\):", "Traceback (most recent call last):"),
    ("python", r'(?m)^\s*File ".*", line \d+, in', '", line '),
    ("python", r"(?m)^\s*\w+Error:", "Error:"),
    ("python", r"\bError:\s", "Error:"),
    ("java", r"Exception in thread", "Exception in thread"),
    ("java", r"(?m)^\s*at [\w.$]+\(", "at "),
    ("java", r"Caused by:", "Caused by:"),
    ("java", r"\.java:\d+\)", ".java:"),
    ("node", r"(?m)^\s*at .+:\d+:\d+", "at "),
    ("node", r"node:internal/", "node:internal/"),
    ("node", r"\bthrow err;", "throw err;"),
    ("node", r"(?m)^\s*at .* \(.*:\d+:\d+\)", "at "),
    ("ruby", r"\.rb:\d+:in ", ".rb:"),
    ("ruby", r"(?m)^.*:\d+:in ['\"]", ":in "),
    ("rust", r"panicked at ", "panicked at "),
    ("rust", r"stack backtrace:", "stack backtrace:"),
    ("rust", r"\.rs:\d+:\d+", ".rs:"),
    ("dotnet", r"(?m)^\s*at .* in .*:line \d+", ":line "),
    ("dotnet", r"Unhandled exception", "Unhandled exception"),
    ("dotnet", r"System\.\w+Exception", "System."),
)

# --- fixed values: earlier wins a tie --------------------------------------------------------------------------------
LANGUAGE_PRIORITY = ("go", "python", "java", "rust", "ruby", "node", "dotnet")
GENERIC = "generic"

# --- fixed values: frame patterns ------------------------------------------------------------------------------------
GO_CALL = r"""^([A-Za-z0-9_./\-(*)"'\]]+)\(.*\)\s*$"""
GO_FRAME = r"^\t(.+\.go):(\d+)(?:\s.*)?$"
PYTHON_FRAME = r'^\s*File "(.+)", line (\d+), in (.+)'
JAVA_FRAME = r"^\s*at (?:([\w.$]+)\.)?([\w$<>]+)\(([\w$]+\.java):(\d+)\)"
NODE_CALL_FRAME = r"^\s*at (.+) \((.+):(\d+):(\d+)\)"
NODE_FRAME = r"^\s*at (.+):(\d+):(\d+)"
RUBY_FRAME = r"""^(.+):(\d+):in ['"](.+)"""
RUST_FRAME = r"^(.+\.rs):(\d+):\d+"
RUST_PANIC = r"panicked at(?:.*?\s)?(.+\.rs):(\d+):(\d+)"
DOTNET_FRAME = r"^\s*at (.+) in (.+):line (\d+)"
GENERIC_FRAME = r"(\S+\.[A-Za-z][A-Za-z0-9]*):(\d+)"

# --- fixed values: signature template (pattern, replacement, text every match contains), applied in this order ------
SIGNATURE_STEPS = (
    (r"(?m)^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?Z?\s*", "", ":"),
    (r"(?m)^\s*\d{2}:\d{2}:\d{2}\s*", "", ":"),
    (r"0x[0-9a-fA-F]+", "0xADDR", "0x"),
    (r"\[\d+\]", "[PID]", "["),
    (r"\bpid=\d+", "pid=N", "pid="),
    (r"goroutine \d+", "goroutine N", "goroutine "),
    (r"\.([A-Za-z][A-Za-z0-9]*):(\d+)", ".$1:N", ":"),
)

# --- fixed values: what starts a new log block -----------------------------------------------------------------------
BLOCK_START = (
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\d{2}:\d{2}:\d{2}"
    r"|ERROR|WARN|panic:|Traceback|FATAL|Exception|goroutine \d+|Caused by:"
)

# --- fixed values: section labels of a reply, in order ---------------------------------------------------------------
SECTION_LABELS = ("WHAT HAPPENED", "PROBABLE CAUSE", "EVIDENCE", "INVESTIGATE", "POTENTIAL FIXES")
CAUSE_LABEL = "PROBABLE CAUSE"
FIXES_LABEL = "POTENTIAL FIXES"

# --- fixed values: path and symbol word lists ------------------------------------------------------------------------
CONTAINER_PREFIXES = ("/workspace/", "/app/", "/build/", "/src/", "/repo/", "/root/")
GENERIC_BASENAMES = ("main.go", "index.js", "index.ts", "Makefile", "go.mod", "setup.py", "package.json", "app.py")
GENERIC_SYMBOLS = ("main", "init", "run", "handle", "do", "call", "start", "stop", "new")

# --- fixed values: where definitions of a language are looked up -----------------------------------------------------
DEFINITION_EXTENSION = {
    "go": "go", "python": "py", "ruby": "rb", "rust": "rs", "node": "js", "java": "java", "dotnet": "java",
}
DEFINITION_MODIFIERS = ("public", "private", "protected", "static", "final", "internal", "virtual")

# --- fixed values: 64-bit FNV-1a -------------------------------------------------------------------------------------
FNV_OFFSET_HIGH = 0xCBF29CE4
FNV_OFFSET_LOW = 0x84222325
FNV_PRIME_LOW = 0x1B3

# --- fixed values: texts the prompt is put together from -------------------------------------------------------------
NOTE_INLINE = "The text below was handed over directly."
NOTE_STDIN = "The text below came from a stream, such as the error output of a command or a log."
NOTE_FILE = "The text below is the content of "
NOTE_TRUNCATED = "\nOnly its beginning is given, as the whole was too long."
CONTEXT_OPEN, CONTEXT_CLOSE = "--- PARSED CONTEXT ---\n", "\n--- END CONTEXT ---\n\n"
SOURCE_OPEN, SOURCE_CLOSE = "--- RELEVANT SOURCE ---\n", "\n--- END SOURCE ---\n\n"
PRIORS_OPEN, PRIORS_CLOSE = "--- PRIOR OCCURRENCES ---\n", "--- END PRIOR OCCURRENCES ---"
INPUT_OPEN, INPUT_CLOSE = "--- INPUT START ---\n", "\n--- INPUT END ---"
SOURCE_TRUNCATED = "\n\n(more source was found than the budget allows)"

# --- fixed values: Unicode White_Space characters --------------------------------------------------------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
