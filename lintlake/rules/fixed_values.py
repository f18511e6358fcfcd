"""Fixed values of the built-in rules: metadata, output texts and detection patterns.

They must be exactly these for results to be right, so they are listed plainly here and
nowhere else. ``{1}`` and ``{2}`` in a text stand for values taken from the code.
Patterns are ECMAScript patterns with ``\\z`` for the end of the line. A ``+`` after a
quantifier (possessive) never changes what matches; it keeps long runs of white space
from being tried again and again.
"""

# Severities, worst first.
SEVERITIES = ("critical", "high", "medium", "low")

TS, JS, PY, JAVA, GO, RUST = "typescript", "javascript", "python", "java", "go", "rust"
RUBY, PHP, CSHARP, KOTLIN, SWIFT, CPP, C = "ruby", "php", "csharp", "kotlin", "swift", "cpp", "c"

# id, name, category, severity, languages; in the order rules run.
RULES = (
    ("ERR001", "empty-catch-block", "error-handling", "critical",
     (TS, JS, JAVA, CSHARP, KOTLIN, SWIFT, PHP, CPP)),
    ("ERR002", "catch-only-logs", "error-handling", "high",
     (TS, JS, JAVA, CSHARP, KOTLIN, PHP)),
    ("ERR003", "promise-no-catch", "error-handling", "high",
     (TS, JS)),
    ("ERR004", "generic-catch-rethrow", "error-handling", "medium",
     (TS, JS, JAVA, CSHARP, KOTLIN, PHP)),
    ("ERR005", "async-no-error-handling", "error-handling", "medium",
     (TS, JS)),
    ("ERR006", "optional-chain-on-critical-path", "error-handling", "medium",
     (TS, JS)),
    ("SEC001", "eval-usage", "security", "critical",
     (TS, JS, PY, PHP)),
    ("SEC002", "innerhtml-assignment", "security", "high",
     (TS, JS)),
    ("SEC003", "hardcoded-secrets", "security", "critical",
     (TS, JS, PY, JAVA, GO, RUBY, PHP, CSHARP, RUST, KOTLIN, SWIFT)),
    ("SEC004", "sql-injection", "security", "critical",
     (TS, JS, PY, JAVA, PHP, RUBY, GO, CSHARP)),
    ("SEC005", "command-injection", "security", "critical",
     (TS, JS, PY, RUBY, PHP)),
    ("SEC010", "unsafe-deserialization", "security", "critical",
     (PY,)),
    ("QA001", "console-left-behind", "code-quality", "low",
     (TS, JS)),
    ("QA002", "todo-fixme-hack", "code-quality", "low",
     (TS, JS, PY, JAVA, GO, RUST, RUBY, PHP, CSHARP, KOTLIN, SWIFT, CPP, C)),
    ("QA003", "magic-numbers", "code-quality", "low",
     (TS, JS, PY, JAVA, GO, CSHARP, KOTLIN)),
    ("QA004", "deep-nesting", "code-quality", "medium",
     (TS, JS, JAVA, CSHARP, GO, RUST, CPP, C, KOTLIN, SWIFT, PHP)),
    ("QA005", "long-function", "code-quality", "medium",
     (TS, JS, JAVA, CSHARP, GO, RUST, CPP, C, KOTLIN, SWIFT, PHP, PY)),
    ("QA006", "unused-import", "code-quality", "low",
     (TS, JS)),
    ("QA007", "duplicate-condition", "code-quality", "medium",
     (TS, JS, JAVA, CSHARP, GO, KOTLIN, PHP)),
    ("SEC006", "fail-open-env", "security", "high",
     (TS, JS, PY)),
    ("SEC007", "debug-flag-default", "security", "medium",
     (TS, JS, PY)),
    ("SEC008", "permissive-cors", "security", "high",
     (TS, JS, PY, JAVA, GO, RUBY, PHP)),
    ("SEC009", "weak-crypto", "security", "high",
     (TS, JS, PY, JAVA, GO, RUBY, PHP, CSHARP)),
)

# rule -> (confidence, message, suggestion) of each thing it reports.
TEXTS = {
    "ERR001": (
        (95, "Empty catch block silently swallows errors",
         "Log the error or re-throw with context"),
        (90, "Empty catch block silently swallows errors",
         "Log the error or re-throw with context"),
    ),
    "ERR002": (
        (85, "Catch block only logs the error without handling it — error is swallowed after logging",
         "Re-throw the error, return an error result, or add recovery logic"),
    ),
    "ERR003": (
        (80, "Promise chain has .then() without .catch() — unhandled rejection possible",
         "Add .catch() handler or use await with try/catch"),
    ),
    "ERR004": (
        (75, "Catch block re-throws the same error without adding context",
         "Either remove the try/catch or wrap in a new Error with context"),
    ),
    "ERR005": (
        (65, "Async function uses await but has no try-catch — unhandled rejection possible",
         "Wrap await calls in try-catch or ensure the caller handles errors"),
    ),
    "ERR006": (
        (60, "Optional chaining on security/auth path — may silently return undefined instead of throwing",
         "Validate auth objects explicitly and throw if missing"),
    ),
    "SEC001": (
        (90, "eval() usage detected — potential code injection vulnerability",
         "Replace with a safe alternative (JSON.parse or structured parsing)"),
        (85, "Dynamic Function constructor — potential code injection",
         "Avoid dynamic code generation; use structured alternatives"),
    ),
    "SEC002": (
        (85, "innerHTML assignment — XSS vulnerability if value contains user input",
         "Use textContent, or sanitize with DOMPurify before assigning"),
        (80, "dangerouslySetInnerHTML — XSS risk if content is not sanitized",
         "Sanitize content with DOMPurify or use a markdown renderer"),
    ),
    "SEC003": (
        (85, "Hardcoded {1} detected — credentials should not be in source code",
         "Use environment variables or a secrets manager"),
    ),
    "SEC004": (
        (85, "SQL query uses string interpolation — SQL injection risk",
         "Use parameterized queries or prepared statements"),
        (80, "SQL query uses string concatenation — SQL injection risk",
         "Use parameterized queries or prepared statements"),
        (85, "SQL query uses f-string interpolation — SQL injection risk",
         "Use parameterized queries with cursor.execute(sql, params)"),
    ),
    "SEC005": (
        (85, "Shell command with dynamic input — command injection risk",
         "Use execFile() with argument arrays, or sanitize input"),
        (80, "Shell command with potential user input — command injection risk",
         "Use subprocess.run() with shell=False and argument lists"),
    ),
    "SEC010": (
        (90, "yaml.load() without SafeLoader — allows arbitrary code execution during deserialization",
         "Use yaml.safe_load() or pass Loader=yaml.SafeLoader"),
        (90, "Unsafe deserialization — allows arbitrary code execution from untrusted data",
         "Use JSON or a safe serialization format"),
    ),
    "QA001": (
        (70, "console.log/debug/info left in code — likely debugging artifact",
         "Remove or replace with a proper logging utility"),
    ),
    "QA002": (
        (95, "{1} comment found{2}", None),
    ),
    "QA003": (
        (60, "Magic number {1} — consider extracting to a named constant",
         "Extract to a named constant for readability"),
    ),
    "QA004": (
        (75, "Deeply nested control flow (depth {1}) — consider extracting to a function or using early returns",
         "Use early returns, guard clauses, or extract to helper functions"),
    ),
    "QA005": (
        (70, 'Function "{1}" is {2} lines long (max recommended: 50)',
         "Break into smaller functions with clear responsibilities"),
    ),
    "QA006": (
        (75, 'Import "{1}" appears unused in the rest of the file',
         'Remove unused import "{1}" or verify it is needed'),
    ),
    "QA007": (
        (85, 'Duplicate condition "{1}" — same as if on line {2}',
         "Remove the duplicate else-if branch or fix the condition"),
    ),
    "SEC006": (
        (85, "Environment variable {1} falls back to hardcoded secret — fails open if env is missing",
         "Throw an error if required secrets are missing instead of using fallback values"),
        (85, "Environment variable {1} falls back to hardcoded secret — fails open if env is missing",
         "Use os.environ[key] to raise KeyError when secrets are missing"),
    ),
    "SEC007": (
        (80, "DEBUG mode enabled by default — should be disabled in production",
         "Set DEBUG = False by default and enable via environment variable"),
        (80, "Debug flag enabled in configuration — should be disabled in production",
         "Set debug: false by default and control via environment variable"),
        (80, "NODE_ENV defaults to development — app runs in dev mode if env is missing",
         'Default to "production" or throw if NODE_ENV is not set'),
    ),
    "SEC008": (
        (85, "CORS allows all origins (*) — any website can make requests to this API",
         "Restrict CORS to specific trusted origins"),
    ),
    "SEC009": (
        (80, "Weak hash algorithm (MD5/SHA1) — vulnerable to collision attacks",
         'Use SHA-256 or stronger: createHash("sha256") / hashlib.sha256()'),
        (80, "ECB mode detected — leaks patterns in encrypted data",
         "Use AES-GCM or AES-CBC with proper IV"),
        (80, "Weak cipher algorithm detected — DES/RC4 are cryptographically broken",
         "Use AES-256-GCM or ChaCha20-Poly1305"),
    ),
}

# Patterns. A keyword and what follows anywhere after it would be tried from every keyword
# to the end of the line. Only the first keyword of a stretch without line ends (or without
# closing brackets) can matter, so a stretch is entered once, at its start.
_IN_LINE = r"[^\n\r\u2028\u2029]"
_LINE_START = r"(?:^|[\n\r\u2028\u2029])"


def _then(keyword: str, tail: str) -> str:
    """``keyword.*tail``, in time that grows with the line only."""
    return rf"{_LINE_START}(?>{_IN_LINE}*?{keyword}){_IN_LINE}*?{tail}"


def _spaced_then(keyword: str, tail: str) -> str:
    r"""``keyword\s+.*tail``; the space may hold line ends, and the tail starts with none."""
    over = rf"{keyword}(?:(?![\n\r\u2028\u2029])\s)*+[\n\r\u2028\u2029]\s*+{_IN_LINE}*?{tail}"
    return _then(rf"{keyword}(?=\s)", tail) + "|" + over


def _catch(tail: str) -> str:
    """``catch``, with or without a bracket that ends, and what follows."""
    return rf"(?:^|\))(?>[^)]*?catch\s*+\()[^)]*+\){tail}|catch{tail}"


CATCH_EMPTY = _catch(r"\s*+\{\s*+\}")
CATCH_AT_END = _catch(r"\s*+\{?+\s*+\z")
CATCH_OPENS = _catch(r"\s*+\{")
CATCH_GENERIC = r"catch\s*+\(\s*+(?:e|err|error|ex|exception)\s*+\)\s*+\{"
LOG_CALL = r"^console\.(?:log|warn|error|info|debug)\("
BARE_THROW = r"^throw\s+(?:e|err|error|ex|exception)\s*+;?+\s*+\z"
CALL_AT_END = r"(?:^|\))(?>[^)]*?\w\()[^)]*+\)\s*+;?+\s*+\z"
ASYNC_FUNCTION = r"async\s+function\s+\w|async\s*+\(|async\s*+\w++\s*+=>"
AWAIT = r"\bawait\b"
TRY = r"\btry\b"
AUTH_WORD = r"(?i)\b(?:auth|permissions?|roles?|sessions?|tokens?|credentials?|acl|access)\b"

EVAL_CALL = r"\beval\s*\("
NEW_FUNCTION = r"new\s+Function\s*\("
INNER_HTML = r"\.innerHTML\s*="
# What a secret is called in the message, and how it looks.
SECRETS = (
    ("API key", r"""(?i)(?:api[_-]?key|apikey)\s*[:=]\s*['"][A-Za-z0-9_\-]{20,}['"]"""),
    ("secret/password", r"""(?i)(?:secret|password|passwd|pwd)\s*[:=]\s*['"][^'"]{8,}['"]"""),
    ("token", r"""(?i)(?:token)\s*[:=]\s*['"][A-Za-z0-9_\-\.]{20,}['"]"""),
    ("AWS access key", r"""(?i)(?:aws_access_key_id)\s*[:=]\s*['"]AKIA[A-Z0-9]{16}['"]"""),
    ("private key", r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----"),
)
SQL_WORD = r"(?:SELECT|INSERT|UPDATE|DELETE|DROP)"
SQL_TEMPLATE = _spaced_then(SQL_WORD, r"\$\{")
SQL_CONCAT = _spaced_then(SQL_WORD, r"""['"]\s*+\+""")
SQL_FSTRING = _spaced_then(rf"""f['"]{SQL_WORD}""", r"\{")
SHELL_EXEC = r"exec\s*\(\s*`"
PY_SYSTEM = r"os\.system\s*\("
PY_SUBPROCESS = r"""subprocess\.call\s*\(\s*['"`f]"""
YAML_LOAD = r"yaml\.load\s*\("
YAML_SAFE_LOAD = r"yaml\.safe_load\s*\("
PICKLE_LOAD = r"pickle\.loads?\s*\("

SECRET_NAME = r"(?i)(?:secret|password|passwd|pwd|token|api_key|apikey|private_key|auth)"
JS_ENV_FALLBACK = r"""process\.env\.(\w+)\s*(?:\|\||\?\?)\s*['"`]"""
PY_ENVIRON_GET = r"""os\.environ\.get\(\s*['"](\w+)['"]\s*,\s*['"`]"""
PY_GETENV_OR = r"""os\.getenv\(\s*['"](\w+)['"]\s*\)\s+or\s+['"`]"""
DEBUG_ASSIGN = r"\bDEBUG\s*=\s*(?:True|true)\b"
DEBUG_OPTION = r"\bdebug\s*:\s*true\b"
NODE_ENV_DEV = _then("NODE_ENV", r"""(?:\|\||\?\?)\s*+['"]development['"]""")
CORS_HEADER = r"""Access-Control-Allow-Origin['"]\s*[,:]\s*['"]\s*\*"""
CORS_OPTION = r"""(?:^|\})(?>[^}]*?cors\s*+\(\s*+\{)[^}]*?origin\s*+:\s*+['"]\*['"]"""
CORS_ORIGINS = _then("(?:ALLOWED_ORIGINS|allowed_origins|allowedOrigins)", r"""['"]\*['"]""")
JS_WEAK_HASH = r"""(?i)createHash\s*\(\s*['"](?:md5|sha1)['"]\s*\)"""
PY_WEAK_HASH = r"(?i)hashlib\.(?:md5|sha1)\s*\("
ECB_MODE = r"""(?i)(?:AES\.MODE_ECB|AES/ECB|mode\s*[:=]\s*['"]?ECB)"""
WEAK_CIPHER = r"\b(?:DES|RC4|RC2)\b"

CONSOLE_CALL = r"console\.(?:log|debug|info)\("
TAG = r"(?i)\b(TODO|FIXME|HACK|XXX|WORKAROUND)\b:?\s*(.*)"
MEDIUM_TAGS = ("FIXME", "HACK")
DECLARATION = r"^\s*(?:const|let|var|export)\s"
RETURN = r"^\s*return\s"
# A number of two digits or more that is not 100 or 1000, not the last thing on the line,
# and has no quote before it.
MAGIC_NUMBER = (
    r"""^[^'"`]*?(?<![A-Za-z0-9_$.])(?!(?:100|1000)(?!\w))"""
    r"(\d{2,}+)(?!\w)(?!\s*+[;:,\]})]?+\s*+\z)"
)
INDENT = r"^(\s*+)"
CONTROL_FLOW = r"^(?:if|else|for|while|switch|case)[\s(]"
MAX_DEPTH = 4
MAX_FUNCTION_LINES = 50
FUNCTION_KEYWORD = r"^(?:export\s+)?(?:async\s+)?function\s+\w"
FUNCTION_VARIABLE = r"^(?:export\s+)?(?:const|let|var)\s+\w++\s*+=\s*+(?:async\s+)?\("
PY_FUNCTION = r"^(?:async\s+)?def\s+\w"
# A method's head up to its parenthesis; what may stand before the method's name.
METHOD_HEAD = r"^([\w\s]*+)\([^)]*+\)\s*+[{:]"
METHOD_MODIFIER = r"public|private|protected|static|\s+"
NAMED_FUNCTION = r"function\s+(\w+)"
NAME_BEFORE = r"(?<!\w)(\w++)\s*+[=(]"
ANONYMOUS = "anonymous"
TYPE_IMPORT = r"^import\s+type\s"
STAR_IMPORT = r"^import\s+\*\s+as\s"
BARE_IMPORT = r"""^import\s+['"]"""
NAMED_IMPORT = r"^import\s+(?:\w+\s*,\s*)?\{([^}]+)\}\s+from\s"
IMPORT_ALIAS = r"\s+as\s+"
IF_LINE = r"^if\s*\((.+)\)\s*+\{?+\s*+\z"
ELSE_IF_LINE = r"^(?:\}\s*)?else\s+if\s*\((.+)\)\s*+\{?+\s*+\z"
