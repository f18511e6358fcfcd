"""Built-in rules that need one line only."""

from __future__ import annotations

from ..functions.folds import let
from ..functions.text import (
    RARE_SPACE_CLASS,
    any_of,
    contains,
    contains_any,
    extract,
    matches,
    one_of,
    starts_with,
    trim,
)
from . import fixed_values as fv
from .model import (
    CONTENT,
    LOWERED,
    SKIP_STRINGS,
    SKIP_TEST_AND_CONFIG_PATHS,
    SKIP_TEST_PATHS,
    TEXT,
    TRIMMED,
    Test,
)

# Marks that many candidates share.
CALLS = contains(TEXT, "(")
QUOTES = contains_any(TEXT, ("'", '"', "`"))


def _has(*needles: str) -> dict:
    """Files and lines that contain one of the texts."""
    return dict(needs=contains_any(CONTENT, needles), candidate=contains_any(TEXT, needles))


def _lower_has(*needles: str) -> str:
    """Lines that contain one of the texts in any case."""
    return let("low", f"lower({TEXT})", contains_any("low", needles))


SECRET_WORDS = ("key", "secret", "passw", "pwd", "token")
TAG_WORDS = ("todo", "fixme", "hack", "xxx", "workaround")
CRYPTO_WORDS = ("DES", "RC4", "RC2")
CRYPTO_CALLS = ("createhash", "hashlib.", "ecb")

# Deep indents hold a tab or ten blanks, unless some rarer white space is among them.
DEEP_INDENT = any_of(
    (
        contains_any(CONTENT, ("\t", " " * 10, "\r", "\f", "\x0b")),
        f"(octet_length({CONTENT}) <> length({CONTENT}) "
        f"AND {matches(CONTENT, RARE_SPACE_CLASS)})",
    )
)


def _secrets() -> tuple[Test, ...]:
    return tuple(
        Test(0, matches(TRIMMED, pattern), f"'{name}'") for name, pattern in fv.SECRETS
    )


def _tag_tests() -> tuple[Test, ...]:
    # Report 0 carries the rule's own severity, report 1 the raised one.
    tag = f"upper({extract(TEXT, fv.TAG, 1)})"
    found = f"substring({trim(extract(TEXT, fv.TAG, 2))}, 1, 80)"
    said = f"if({found} <> '', concat(': ', {found}), '')"
    return (
        Test(1, one_of(tag, fv.MEDIUM_TAGS), tag, said),
        Test(0, f"{tag} <> ''", tag, said),
    )


def _depth() -> str:
    indent = extract(TEXT, fv.INDENT)
    tabs = f"length({indent}) - length(replace({indent}, '\\t', ''))"
    return f"if(contains({indent}, '\\t'), {tabs}, length({indent}) DIV 2)"


def _fallbacks() -> tuple[Test, ...]:
    patterns = ((0, fv.JS_ENV_FALLBACK), (1, fv.PY_ENVIRON_GET), (1, fv.PY_GETENV_OR))
    return tuple(
        Test(report, matches(extract(TEXT, pattern), fv.SECRET_NAME), extract(TEXT, pattern))
        for report, pattern in patterns
    )


# rule -> how it is run; metadata and texts come from the fixed values.
LINE_RULES = {
    "ERR003": dict(
        mark=CALLS,
        **_has(".then("),
        tests=(
            Test(
                0,
                f"contains({TRIMMED}, '.then(') AND NOT contains({TRIMMED}, '.catch(') "
                f"AND NOT {starts_with(TRIMMED, 'await ', 'return ')} "
                f"AND {matches(TRIMMED, fv.CALL_AT_END)}",
            ),
        ),
    ),
    "ERR006": dict(
        **_has("?."),
        tests=(Test(0, f"contains({TRIMMED}, '?.') AND {matches(TRIMMED, fv.AUTH_WORD)}"),),
    ),
    "SEC001": dict(
        mark=CALLS,
        **_has("eval", "Function"),
        tests=(Test(0, matches(TRIMMED, fv.EVAL_CALL)), Test(1, matches(TRIMMED, fv.NEW_FUNCTION))),
        first_only=False,
    ),
    "SEC002": dict(
        **_has(".innerHTML", "dangerouslySetInnerHTML"),
        tests=(
            Test(0, matches(TRIMMED, fv.INNER_HTML)),
            Test(1, contains(TRIMMED, "dangerouslySetInnerHTML")),
        ),
        first_only=False,
    ),
    "SEC003": dict(
        needs=f"{contains_any(LOWERED, SECRET_WORDS)} OR {contains(CONTENT, 'PRIVATE KEY')}",
        candidate=f"({QUOTES} AND {_lower_has(*SECRET_WORDS)}) OR {contains(TEXT, 'PRIVATE KEY')}",
        tests=_secrets(),
        skip_paths=SKIP_TEST_PATHS,
        snippet=f"if(length({TEXT}) > 80, concat(substring({TEXT}, 1, 80), '...'), {TEXT})",
    ),
    "SEC004": dict(
        mark=contains_any(TEXT, ("{", "+")),
        **_has("SELECT", "INSERT", "UPDATE", "DELETE", "DROP"),
        tests=(
            Test(0, f"{contains(TEXT, '${')} AND {matches(TRIMMED, fv.SQL_TEMPLATE)}"),
            Test(1, f"contains({TEXT}, '+') AND {matches(TRIMMED, fv.SQL_CONCAT)}"),
            Test(2, f"contains({TEXT}, '{{') AND {matches(TRIMMED, fv.SQL_FSTRING)}"),
        ),
        first_only=False,
    ),
    "SEC005": dict(
        mark=CALLS,
        **_has("exec", "os.system", "subprocess.call"),
        tests=(
            Test(0, matches(TRIMMED, fv.SHELL_EXEC)),
            Test(
                1,
                f"{matches(TRIMMED, fv.PY_SYSTEM)} OR {matches(TRIMMED, fv.PY_SUBPROCESS)}",
            ),
        ),
        first_only=False,
    ),
    "SEC010": dict(
        mark=CALLS,
        **_has("yaml.load", "pickle.load"),
        tests=(
            Test(
                0,
                f"{matches(TRIMMED, fv.YAML_LOAD)} AND NOT {matches(TRIMMED, fv.YAML_SAFE_LOAD)}",
            ),
            Test(1, matches(TRIMMED, fv.PICKLE_LOAD)),
        ),
        first_only=False,
        skip_paths=SKIP_TEST_PATHS,
    ),
    "QA001": dict(
        mark=CALLS,
        **_has("console."),
        tests=(
            Test(
                0,
                f"{matches(TRIMMED, fv.CONSOLE_CALL)} "
                f"AND NOT contains({TRIMMED}, 'eslint-disable')",
            ),
        ),
        skip_paths=SKIP_TEST_PATHS,
    ),
    "QA002": dict(
        needs=contains_any(LOWERED, TAG_WORDS),
        candidate=_lower_has(*TAG_WORDS),
        tests=_tag_tests(),
        skip_lines=SKIP_STRINGS,
    ),
    "QA003": dict(
        needs=matches(CONTENT, r"\d\d"),
        candidate=matches(TEXT, r"\d\d"),
        tests=(
            Test(
                0,
                f"NOT {matches(TEXT, fv.DECLARATION)} AND NOT {matches(TEXT, fv.RETURN)} "
                f"AND {extract(TRIMMED, fv.MAGIC_NUMBER)} <> ''",
                extract(TRIMMED, fv.MAGIC_NUMBER),
            ),
        ),
        skip_paths=SKIP_TEST_AND_CONFIG_PATHS,
    ),
    "QA004": dict(
        needs=DEEP_INDENT,
        # More than four tabs or ten blanks, so at least five characters of white space.
        candidate=matches(f"substring({TEXT}, 1, 5)", r"^\s{5}"),
        tests=(
            Test(
                0,
                f"{matches(TRIMMED, fv.CONTROL_FLOW)} AND {_depth()} > {fv.MAX_DEPTH}",
                _depth(),
            ),
        ),
    ),
    "SEC006": dict(
        mark=QUOTES,
        **_has("process.env.", "os.environ.get(", "os.getenv("),
        tests=_fallbacks(),
    ),
    "SEC007": dict(
        mark=contains_any(TEXT, ("=", ":", "'", '"')),
        **_has("DEBUG", "debug", "NODE_ENV"),
        tests=(
            Test(0, matches(TEXT, fv.DEBUG_ASSIGN)),
            Test(1, matches(TEXT, fv.DEBUG_OPTION)),
            Test(2, matches(TEXT, fv.NODE_ENV_DEV)),
        ),
        skip_paths=SKIP_TEST_PATHS,
    ),
    "SEC008": dict(
        mark=QUOTES,
        **_has(
            "Access-Control-Allow-Origin", "cors",
            "ALLOWED_ORIGINS", "allowed_origins", "allowedOrigins",
        ),
        tests=(
            Test(
                0,
                " OR ".join(
                    matches(TEXT, p) for p in (fv.CORS_HEADER, fv.CORS_OPTION, fv.CORS_ORIGINS)
                ),
            ),
        ),
    ),
    "SEC009": dict(
        needs=f"{contains_any(CONTENT, CRYPTO_WORDS)} OR {contains_any(LOWERED, CRYPTO_CALLS)}",
        candidate=f"{contains_any(TEXT, CRYPTO_WORDS)} OR {_lower_has(*CRYPTO_CALLS)}",
        tests=(
            Test(0, f"{matches(TEXT, fv.JS_WEAK_HASH)} OR {matches(TEXT, fv.PY_WEAK_HASH)}"),
            Test(1, matches(TEXT, fv.ECB_MODE)),
            Test(2, matches(TEXT, fv.WEAK_CIPHER)),
        ),
        skip_paths=SKIP_TEST_PATHS,
    ),
}
