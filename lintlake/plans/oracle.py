"""SQL with the same results as the registered queries, for DuckDB.

Written apart from the Spark plans on purpose: where those fold arrays inside a row, the
SQL uses recursive steps, window functions and joins on lines, and RE2 patterns.
Fixed values: patterns, messages and lists in it are what results must agree with.
"""

from __future__ import annotations

from ..functions.text import (
    CONFIG_PATH_PARTS,
    PARSER_LANGUAGES,
    REVIEW_LANGUAGES,
    TEST_PATH_PARTS,
    WHITESPACE,
)
from ..operators.blocks import BRACE_LANGUAGES
from ..rules import fixed_values as fv
from . import corpus

SPACE = r"\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
ANY = r"[^\n\r\x{2028}\x{2029}]"


def text(value: str | None) -> str:
    """A SQL string; control characters and the like by code point."""
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    parts, plain = [], ""
    for ch in value:
        if ch.isprintable() and (ch == " " or ch not in WHITESPACE):
            plain += ch.replace("'", "''")
        else:
            if plain:
                parts.append(f"'{plain}'")
                plain = ""
            parts.append(f"chr({ord(ch)})")
    if plain or not parts:
        parts.append(f"'{plain}'")
    return parts[0] if len(parts) == 1 else "(" + "||".join(parts) + ")"


def re2(pattern: str) -> str:
    """A pattern as SQL text: ``~`` stands for any ECMAScript white space, ``@`` for any character."""
    pattern = pattern.replace("[~", f"[{SPACE}").replace("~", f"[{SPACE}]").replace("@", ANY)
    return "'" + pattern.replace("'", "''") + "'"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {re2(pattern)})"


def got(column: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({column}, {re2(pattern)}, {group})"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(r) + ")" for r in rows) + ")"


def _any(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(p)})" for p in parts) + ")"


WS = text(WHITESPACE)
NL = "chr(10)"
BACKTICK = "chr(96)"
BACKSLASH = "chr(92)"


def _language(path: str, languages: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in languages.items())
    return f"CASE regexp_extract({path}, '\\.[^.]*$') {cases} ELSE 'unknown' END"


PATHS = _values(
    [str(i), text(p), text(s)] for i, (p, s) in enumerate(corpus.PATHS)
)
CODE = _values([str(i), text(c)] for i, c in enumerate(corpus.CODE))

# Whole documents and pages as files.
FILES = f"""
paths(j, prefix, suffix) AS MATERIALIZED (SELECT * FROM {PATHS}),
code(i, code) AS MATERIALIZED (SELECT * FROM {CODE}),
files AS MATERIALIZED (
  SELECT doc_id * 2 AS file_seq, prefix || 'source/' || doc_id || suffix AS path,
         code || {NL} || text AS content
  FROM documents JOIN paths ON j = doc_id % {len(corpus.PATHS)}
  JOIN code ON i = doc_id % {len(corpus.CODE)}
  UNION ALL
  SELECT page_id * 2 + 1, 'site/' || page_id || suffix, html
  FROM pages JOIN paths ON j = page_id % {len(corpus.PATHS)}
)"""

# Files as they are reviewed; lines with their context.
LINES = f"""
f AS MATERIALIZED (
  SELECT *, {_language('path', REVIEW_LANGUAGES)} AS language,
         {_any('path', TEST_PATH_PARTS)} AS is_test,
         {_any('path', CONFIG_PATH_PARTS)} AS is_config
  FROM files
),
raw_lines AS MATERIALIZED (
  SELECT file_seq, path, language, is_test, is_config,
         unnest(string_split(content, {NL})) AS text,
         generate_subscripts(string_split(content, {NL}), 1) AS line
  FROM f
),
marked AS MATERIALIZED (
  SELECT *, trim(text, {WS}) AS t,
         (len(replace(text, {BACKSLASH} || {BACKTICK}, ''))
          - len(replace(replace(text, {BACKSLASH} || {BACKTICK}, ''), {BACKTICK}, ''))) % 2 = 1 AS odd
  FROM raw_lines
),
kinds AS MATERIALIZED (
  SELECT *, contains(t, '*/') AS block_end,
         contains(t, '\"\"\"') OR contains(t, '''''''') AS doc_end,
         CASE WHEN t LIKE '//%' OR t LIKE '#%' THEN 'line comment'
              WHEN t LIKE '/*%' THEN 'block comment'
              WHEN language = 'python' AND (t LIKE '\"\"\"%' OR t LIKE '''''''%') THEN 'docstring'
              ELSE 'code' END AS kind
  FROM marked
),
walk AS (
  WITH RECURSIVE states(file_seq, line, state) AS (
    SELECT file_seq, 1::BIGINT, 'normal' FROM f
    UNION ALL
    SELECT k.file_seq, k.line + 1,
      CASE s.state
        WHEN 'block' THEN CASE WHEN block_end THEN 'normal' ELSE 'block' END
        WHEN 'block in template' THEN CASE WHEN block_end THEN 'template' ELSE s.state END
        WHEN 'doc' THEN CASE WHEN doc_end THEN 'normal' ELSE 'doc' END
        WHEN 'template' THEN CASE WHEN odd THEN 'normal' ELSE 'template' END
        ELSE CASE kind
          WHEN 'line comment' THEN 'normal'
          WHEN 'block comment' THEN
            CASE WHEN NOT block_end OR t LIKE '%/*' THEN 'block' ELSE 'normal' END
          WHEN 'docstring' THEN
            CASE WHEN contains(substr(t, 4), '\"\"\"') OR contains(substr(t, 4), '''''''')
                 THEN 'normal' ELSE 'doc' END
          ELSE CASE WHEN contains(t, '/*') AND NOT block_end AND odd THEN 'block in template'
                    WHEN contains(t, '/*') AND NOT block_end THEN 'block'
                    WHEN odd THEN 'template' ELSE 'normal' END
          END
      END
    FROM states s JOIN kinds k ON k.file_seq = s.file_seq AND k.line = s.line
  )
  SELECT * FROM states
),
x AS MATERIALIZED (
  SELECT k.file_seq, k.path, k.language, k.is_test, k.is_config, k.line, k.text, k.t,
         CASE WHEN w.state IN ('block', 'doc', 'block in template') THEN 'comment'
              WHEN w.state = 'template' THEN 'string'
              WHEN k.kind <> 'code' THEN 'comment'
              WHEN k.odd THEN 'string' ELSE 'plain' END AS flag,
         len(replace(k.text, '}}', '')) - len(replace(k.text, '{{', '')) AS delta,
         count(*) OVER (PARTITION BY k.file_seq) AS n_lines,
         lead(k.t) OVER (PARTITION BY k.file_seq ORDER BY k.line) AS next_t,
         coalesce(min(CASE WHEN k.t LIKE '}}%' THEN k.line END) OVER (
             PARTITION BY k.file_seq ORDER BY k.line
             ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
           count(*) OVER (PARTITION BY k.file_seq) + 1) AS next_close
  FROM kinds k JOIN walk w ON w.file_seq = k.file_seq AND w.line = k.line
),
cum AS MATERIALIZED (
  SELECT *, sum(delta) OVER (PARTITION BY file_seq ORDER BY line)::BIGINT AS depth,
         sum(delta) OVER (PARTITION BY file_seq ORDER BY line)::BIGINT - delta AS depth_before
  FROM x
)"""
_LANGUAGES = {r[0]: r[4] for r in fv.RULES}


def _speaks(rule: str) -> str:
    return "language IN (" + ", ".join(text(v) for v in _LANGUAGES[rule]) + ")"


def _line_hit(rule, when, report=0, seq=0, a1=None, skip=None, flag="flag = 'plain'") -> str:
    where = [_speaks(rule), flag, when]
    if skip == "tests":
        where.append("NOT is_test")
    elif skip:
        where.append("NOT is_test AND NOT is_config")
    return (
        f"SELECT file_seq, line, NULL::BIGINT AS end_line, '{rule}' AS rule, {report} AS report, "
        f"{seq} AS seq, {a1 or 'NULL::VARCHAR'} AS a1, NULL::VARCHAR AS a2 FROM x WHERE "
        + " AND ".join(f"({w})" for w in where)
    )


def _first(rule, tests, **options) -> list[str]:
    """(when, report, value) tests of which only the first true one reports."""
    hits, before = [], "true"
    for when, report, value in tests:
        hits.append(_line_hit(rule, f"{before} AND ({when})", report, a1=value, **options))
        before += f" AND NOT ({when})"
    return hits


def _rule_hits() -> dict[str, list[str]]:
    hits = {}
    catch = r"catch~*(\([^)]*\))?~*"
    hits["ERR001"] = _first(
        "ERR001",
        [
            (has("t", catch + r"\{~*\}"), 0, None),
            (has("t", catch + r"\{?~*$") + " AND (next_t = '}' OR next_t LIKE '} catch%')", 1, None),
        ],
    )

    def body(test: str) -> str:
        return (
            "EXISTS (SELECT 1 FROM x b WHERE b.file_seq = x.file_seq AND b.line > x.line "
            f"AND b.line < x.next_close AND {test})"
        )

    log = has("b.t", r"^console\.(log|warn|error|info|debug)\(")
    hits["ERR002"] = [
        _line_hit(
            "ERR002",
            has("t", catch + r"\{") + " AND " + body(log) + " AND NOT "
            + body(f"b.t <> '' AND b.t NOT LIKE '//%' AND NOT {log}"),
        )
    ]
    hits["ERR003"] = [
        _line_hit(
            "ERR003",
            has("t", r"\w+\([^)]*\)~*;?~*$")
            + " AND t NOT LIKE 'await %' AND t NOT LIKE 'return %'"
            + " AND contains(t, '.then(') AND NOT contains(t, '.catch(')",
        )
    ]
    names = "(e|err|error|ex|exception)"
    hits["ERR004"] = [
        _line_hit(
            "ERR004",
            has("t", rf"catch~*\(~*{names}~*\)~*\{{") + " AND "
            + body(has("b.t", rf"^throw~+{names}~*;?~*$")),
        )
    ]
    async_head = has("t", r"async~+function~+\w+|async~*\(|async~*\w+~*=>")
    hits["ERR005"] = [
        f"""SELECT h.file_seq, h.line, NULL::BIGINT, 'ERR005', 0, 0, NULL::VARCHAR, NULL::VARCHAR
        FROM (
          SELECT o.*, coalesce((SELECT min(c.line) FROM cum c WHERE c.file_seq = o.file_seq
              AND c.line >= o.opened AND c.depth = o.depth_before), n_lines) AS ending
          FROM (
            SELECT cum.*, (SELECT min(c.line) FROM cum c WHERE c.file_seq = cum.file_seq
                AND c.line >= cum.line AND contains(c.text, '{{')) AS opened
            FROM cum WHERE {_speaks('ERR005')} AND flag = 'plain' AND {async_head}
          ) o WHERE opened IS NOT NULL
        ) h
        WHERE EXISTS (SELECT 1 FROM x b WHERE b.file_seq = h.file_seq
                AND b.line BETWEEN h.opened AND h.ending AND {has('b.text', r'\bawait\b')})
          AND NOT EXISTS (SELECT 1 FROM x b WHERE b.file_seq = h.file_seq
                AND b.line BETWEEN h.opened AND h.ending AND {has('b.text', r'\btry\b')})"""
    ]
    hits["ERR006"] = [
        _line_hit(
            "ERR006",
            "contains(t, '?.') AND " + has(
                "t",
                r"(?i)\b(auth|permissions?|roles?|sessions?|tokens?|credentials?|acl|access)\b",
            ),
        )
    ]
    hits["SEC001"] = [
        _line_hit("SEC001", has("t", r"\beval~*\("), 0, 0),
        _line_hit("SEC001", has("t", r"new~+Function~*\("), 1, 1),
    ]
    hits["SEC002"] = [
        _line_hit("SEC002", has("t", r"\.innerHTML~*="), 0, 0),
        _line_hit("SEC002", "contains(t, 'dangerouslySetInnerHTML')", 1, 1),
    ]
    secrets = (
        (r"""(?i)(?:api[_-]?key|apikey)~*[:=]~*['"][A-Za-z0-9_\-]{20,}['"]""", "API key"),
        (r"""(?i)(?:secret|password|passwd|pwd)~*[:=]~*['"][^'"]{8,}['"]""", "secret/password"),
        (r"""(?i)(?:token)~*[:=]~*['"][A-Za-z0-9_\-\.]{20,}['"]""", "token"),
        (r"""(?i)(?:aws_access_key_id)~*[:=]~*['"]AKIA[A-Z0-9]{16}['"]""", "AWS access key"),
        (r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----", "private key"),
    )
    hits["SEC003"] = _first(
        "SEC003", [(has("t", p), 0, text(name)) for p, name in secrets], skip="tests"
    )
    sql = "(?:SELECT|INSERT|UPDATE|DELETE|DROP)"
    hits["SEC004"] = [
        _line_hit("SEC004", has("t", sql + r"~+@*\$\{"), 0, 0),
        _line_hit("SEC004", has("t", sql + r"""~+@*['"]~*\+"""), 1, 1),
        _line_hit("SEC004", has("t", r"""f['"]""" + sql + r"~+@*\{"), 2, 2),
    ]
    hits["SEC005"] = [
        _line_hit("SEC005", has("t", r"exec~*\(~*`"), 0, 0),
        _line_hit(
            "SEC005",
            has("t", r"os\.system~*\(") + " OR "
            + has("t", r"""subprocess\.call~*\(~*['"`f]"""), 1, 1,
        ),
    ]
    hits["SEC010"] = [
        _line_hit(
            "SEC010",
            has("t", r"yaml\.load~*\(") + " AND NOT " + has("t", r"yaml\.safe_load~*\("),
            0, 0, skip="tests",
        ),
        _line_hit("SEC010", has("t", r"pickle\.loads?~*\("), 1, 1, skip="tests"),
    ]
    hits["QA001"] = [
        _line_hit(
            "QA001",
            has("t", r"console\.(log|debug|info)\(") + " AND NOT contains(t, 'eslint-disable')",
            skip="tests",
        )
    ]
    tag = r"(?i)\b(TODO|FIXME|HACK|XXX|WORKAROUND)\b:?~*(@*)"
    said = f"left(trim({got('text', tag, 2)}, {WS}), 80)"
    value = f"upper({got('text', tag, 1)})"
    hits["QA002"] = [
        f"SELECT file_seq, line, NULL::BIGINT, 'QA002', "
        f"CASE WHEN {value} IN ('FIXME', 'HACK') THEN 1 ELSE 0 END, 0, {value}, "
        f"CASE WHEN {said} <> '' THEN ': ' || {said} ELSE '' END "
        f"FROM x WHERE {_speaks('QA002')} AND flag <> 'string' AND {has('text', tag)}"
    ]
    # No look-around here: drop a number that ends the line, keep what stands before the
    # first quote, double the separators, and take numbers between two of them.
    head = (
        "regexp_extract(regexp_replace(t, " + re2(r"(\d{2,})~*[;:,\]})]?~*$") + ", ''), "
        + re2(r"""^[^'"`]*""") + ")"
    )
    numbers = (
        "list_filter(regexp_extract_all(regexp_replace(" + head + ", "
        + re2(r"([^A-Za-z0-9_$.])") + r", '\1\1', 'g'), "
        + re2(r"(?:^|[^A-Za-z0-9_$.])(\d{2,})(?:[^A-Za-z0-9_]|$)")
        + ", 1), lambda n: n NOT IN ('100', '1000'))"
    )
    hits["QA003"] = [
        _line_hit(
            "QA003",
            f"len({numbers}) > 0 AND NOT " + has("text", r"^~*(const|let|var|export)~")
            + " AND NOT " + has("text", r"^~*return~"),
            a1=f"{numbers}[1]",
            skip="tests and config",
        )
    ]
    indent = got("text", r"^(~*)")
    depth = (
        f"CASE WHEN contains({indent}, chr(9)) "
        f"THEN len({indent}) - len(replace({indent}, chr(9), '')) ELSE len({indent}) // 2 END"
    )
    hits["QA004"] = [
        _line_hit(
            "QA004",
            f"{depth} > 4 AND " + has("t", r"^(if|else|for|while|switch|case)~*[~(]"),
            a1=f"({depth})::VARCHAR",
        )
    ]
    starts = " OR ".join(
        has("t", p)
        for p in (
            r"^~*(export~+)?(async~+)?function~+\w+",
            r"^~*(export~+)?(const|let|var)~+\w+~*=~*(async~+)?\(",
            r"^~*(public|private|protected|static|~)*(async~+)?\w+~*\([^)]*\)~*(\{|:)",
            r"^~*(async~+)?def~+\w+",
        )
    )
    ending = (
        "(SELECT min(c.line) FROM cum c WHERE c.file_seq = h.file_seq AND c.line > h.line "
        "AND c.depth - h.depth_before <= 0)"
    )
    hits["QA005"] = [
        f"""SELECT g.file_seq, g.line, g.ending, 'QA005', 0, 0,
          coalesce(nullif({got('x.t', r'function~+(\w+)')}, ''),
                   nullif({got('x.t', r'(\w+)~*[=(]')}, ''), 'anonymous'),
          (g.ending - g.line + 1)::VARCHAR
        FROM (
          WITH RECURSIVE heads AS (
            SELECT file_seq, line, depth_before FROM cum WHERE {_speaks('QA005')} AND ({starts})
          ),
          ended AS (SELECT h.*, {ending} AS ending FROM heads h),
          chain AS (
            SELECT * FROM ended e
            WHERE line = (SELECT min(line) FROM ended o WHERE o.file_seq = e.file_seq)
            UNION ALL
            SELECT e.* FROM chain c JOIN ended e ON e.file_seq = c.file_seq
              AND e.line = (SELECT min(line) FROM ended o
                            WHERE o.file_seq = c.file_seq AND o.line > c.ending)
          )
          SELECT * FROM chain WHERE ending - line + 1 > 50
        ) g JOIN x ON x.file_seq = g.file_seq AND x.line = g.line"""
    ]
    named = r"^import~+(?:\w+~*,~*)?\{~*([^}]+)\}~+from~"
    hits["QA006"] = [
        f"""SELECT n.file_seq, n.line, NULL::BIGINT, 'QA006', 0, n.seq - 1, n.name, NULL::VARCHAR
        FROM (
          SELECT file_seq, line, unnest(names) AS name, generate_subscripts(names, 1) AS seq
          FROM (
            SELECT file_seq, line, list_filter(list_transform(
                string_split({got('t', named)}, ','),
                lambda p: trim(coalesce(regexp_split_to_array(trim(p, {WS}), {re2('~+as~+')})[2],
                               trim(p, {WS})), {WS})), lambda p: p <> '') AS names
            FROM x WHERE {_speaks('QA006')} AND flag = 'plain' AND {has('t', named)}
              AND NOT {has('t', '^import~+type~')} AND NOT {has('t', r'^import~+[*]~+as~')}
          )
        ) n JOIN (
          SELECT file_seq,
            string_agg(CASE WHEN t NOT LIKE 'import %' THEN text END, {NL} ORDER BY line) AS rest
          FROM x GROUP BY file_seq
        ) r ON r.file_seq = n.file_seq
        WHERE NOT regexp_matches(coalesce(rest, ''), '\\b' || regexp_escape(name) || '\\b')"""
    ]
    if_line = r"^if~*\((@+)\)~*\{?~*$"
    else_line = r"^(?:\}~*)?else~+if~*\((@+)\)~*\{?~*$"
    hits["QA007"] = [
        f"""SELECT file_seq, line, NULL::BIGINT, 'QA007', 0, 0, was, was_line::VARCHAR FROM (
          SELECT *,
            last_value(cond IGNORE NULLS) OVER up AS was,
            last_value(CASE WHEN cond IS NOT NULL THEN line END IGNORE NULLS) OVER up AS was_line
          FROM (
            SELECT file_seq, line,
              CASE WHEN {has('t', if_line)} THEN trim({got('t', if_line)}, {WS}) END AS cond,
              CASE WHEN {has('t', else_line)} THEN trim({got('t', else_line)}, {WS}) END AS other
            FROM x WHERE {_speaks('QA007')} AND flag = 'plain'
          )
          WINDOW up AS (PARTITION BY file_seq ORDER BY line
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ) WHERE other = was"""
    ]
    keyword = r"(?i)(?:secret|password|passwd|pwd|token|api_key|apikey|private_key|auth)"
    env = (
        (r"""process\.env\.(\w+)~*(?:\|\||\?\?)~*['"`]""", 0),
        (r"""os\.environ\.get\(~*['"](\w+)['"]~*,~*['"`]""", 1),
        (r"""os\.getenv\(~*['"](\w+)['"]~*\)~+or~+['"`]""", 1),
    )
    hits["SEC006"] = _first(
        "SEC006", [(has(got("text", p), keyword), report, got("text", p)) for p, report in env]
    )
    hits["SEC007"] = _first(
        "SEC007",
        [
            (has("text", r"\bDEBUG~*=~*(?:True|true)\b"), 0, None),
            (has("text", r"\bdebug~*:~*true\b"), 1, None),
            (has("text", r"""NODE_ENV@*(?:\|\||\?\?)~*['"]development['"]"""), 2, None),
        ],
        skip="tests",
    )
    hits["SEC008"] = [
        _line_hit(
            "SEC008",
            " OR ".join(
                has("text", p)
                for p in (
                    r"""Access-Control-Allow-Origin['"]~*[,:]~*['"]~*\*""",
                    r"""cors~*\(~*\{[^}]*origin~*:~*['"]\*['"]""",
                    r"""(?:ALLOWED_ORIGINS|allowed_origins|allowedOrigins)@*['"]\*['"]""",
                )
            ),
        )
    ]
    weak_hash = (
        has("text", r"""(?i)createHash~*\(~*['"](?:md5|sha1)['"]~*\)""")
        + " OR " + has("text", r"(?i)hashlib\.(?:md5|sha1)~*\(")
    )
    hits["SEC009"] = _first(
        "SEC009",
        [
            (weak_hash, 0, None),
            (has("text", r"""(?i)(?:AES\.MODE_ECB|AES/ECB|mode~*[:=]~*['"]?ECB)"""), 1, None),
            (has("text", r"\b(?:DES|RC4|RC2)\b"), 2, None),
        ],
        skip="tests",
    )
    return hits


RULE_HITS = _rule_hits()
RULE_IDS = tuple(r[0] for r in fv.RULES)


def _texts(order: dict[str, int]) -> str:
    rows = []
    for rule, _, category, severity, _ in fv.RULES:
        reports = list(fv.TEXTS[rule])
        severities = [severity] * len(reports)
        if rule == "QA002":
            reports.append(reports[0])
            severities.append("medium")
        for number, ((confidence, message, suggestion), level) in enumerate(
            zip(reports, severities)
        ):
            rows.append(
                [
                    text(rule), str(number), text(category), text(level),
                    str(fv.SEVERITIES.index(level)), str(confidence), text(message),
                    text(suggestion), str(order.get(rule, 0)),
                ]
            )
    return _values(rows)


FINDING = (
    "file_seq, file, line, end_line, rule, category, severity, confidence, message, snippet, "
    "suggestion, severity_rank, rule_seq, emit_seq"
)


def _findings(rules=RULE_IDS, keys: str = "file_seq") -> str:
    """CTE ``findings`` of some rules over ``x`` and ``cum``."""
    hits = "\nUNION ALL\n".join(h for rule in rules for h in RULE_HITS[rule])
    texts = _texts({rule: i for i, rule in enumerate(rules)})
    return f"""
hits(file_seq, line, end_line, rule, report, seq, a1, a2) AS ({hits}),
texts(rule, report, category, severity, severity_rank, confidence, m, s, rule_seq)
  AS (SELECT * FROM {texts}),
findings AS (
  SELECT x.file_seq, x.path AS file, h.line::INT AS line, h.end_line::INT AS end_line, h.rule,
    category, severity, confidence::INT AS confidence,
    string_split(string_split(m, '{{1}}')[1], '{{2}}')[1]
      || CASE WHEN contains(m, '{{1}}') THEN coalesce(a1, '') ELSE '' END
      || CASE WHEN contains(m, '{{1}}') THEN string_split(string_split(m, '{{1}}')[2], '{{2}}')[1]
              ELSE '' END
      || CASE WHEN contains(m, '{{2}}') THEN coalesce(a2, '') || string_split(m, '{{2}}')[2]
              ELSE '' END AS message,
    CASE h.rule WHEN 'QA005' THEN NULL
      WHEN 'SEC003' THEN left(x.text, 80) || CASE WHEN len(x.text) > 80 THEN '...' ELSE '' END
      ELSE x.text END AS snippet,
    CASE WHEN contains(s, '{{1}}')
         THEN string_split(s, '{{1}}')[1] || a1 || string_split(s, '{{1}}')[2]
         ELSE s END AS suggestion,
    severity_rank::INT AS severity_rank, rule_seq::INT AS rule_seq, h.seq::INT AS emit_seq
  FROM hits h JOIN texts USING (rule, report)
  JOIN x ON x.file_seq = h.file_seq AND x.line = h.line
)"""


def _review(select: str, rules=RULE_IDS, files: str = FILES, lines: str = LINES, more: str = "") -> str:
    return f"WITH {files},{lines},{_findings(rules)}{more}\n{select}"


def _counts(prefix: str = "") -> str:
    return f"count({prefix}severity) AS total_findings, " + ", ".join(
        f"count(*) FILTER ({prefix}severity = '{s}') AS {s}" for s in fv.SEVERITIES
    )


def _applied(rules=RULE_IDS) -> str:
    return " + ".join(f"({_speaks(rule)})::BIGINT" for rule in rules)


NO_CONTEXT = LINES.replace("WHEN w.state IN", "WHEN true THEN 'plain' WHEN w.state IN")


# Diffs.
def _fill(template: str) -> str:
    return f"replace(replace({text(template)}, '{{id}}', doc_id::VARCHAR), '{{s}}', suffix)"


_SIGNS = "[" + ", ".join(text(s) for s in corpus.DIFF_SIGNS) + "]"
DIFFS = f"""
paths(j, prefix, suffix) AS MATERIALIZED (SELECT * FROM {PATHS}),
code(i, code) AS MATERIALIZED (SELECT * FROM {CODE}),
diffs AS MATERIALIZED (
  SELECT doc_id AS diff_id, {_fill(corpus.DIFF_HEAD)}
    || array_to_string(list_transform(string_split(code, {NL}), lambda l: '+' || l), {NL})
    || {_fill(corpus.DIFF_SECOND_HUNK)}
    || array_to_string(list_transform(string_split(text, {NL}),
         lambda l, i: {_SIGNS}[(i - 1) % {len(corpus.DIFF_SIGNS)} + 1] || l), {NL})
    || {_fill(corpus.DIFF_OTHER_FILES)} AS raw
  FROM documents JOIN paths ON j = doc_id % {len(corpus.PATHS)}
  JOIN code ON i = doc_id % {len(corpus.CODE)}
),
dl AS MATERIALIZED (
  SELECT diff_id, unnest(string_split(raw, {NL})) AS l,
         generate_subscripts(string_split(raw, {NL}), 1) AS pos
  FROM diffs
),
df AS MATERIALIZED (
  SELECT *, sum((l LIKE 'diff --git%')::INT) OVER (PARTITION BY diff_id ORDER BY pos) - 1 AS fs
  FROM dl
),
dh AS MATERIALIZED (
  SELECT *, sum((l LIKE '@@%')::INT) OVER (PARTITION BY diff_id, fs ORDER BY pos) - 1 AS hs
  FROM df WHERE fs >= 0
),
dfiles AS MATERIALIZED (
  SELECT diff_id, fs,
    coalesce(arg_max(substr(l, 7), pos) FILTER (l LIKE '+++ b/%'),
             max({got('l', r'^diff --git a/(@+) b/(@+)$', 2)}) FILTER (l LIKE 'diff --git%')) AS path,
    arg_max(CASE WHEN l LIKE '--- a/%' THEN substr(l, 7) ELSE chr(0) END, pos)
      FILTER (l LIKE '--- a/%' OR l LIKE 'new file%' OR l LIKE '--- /dev/null%') AS set_old,
    nullif(max({got('l', r'^diff --git a/(@+) b/(@+)$', 1)}) FILTER (l LIKE 'diff --git%'), '')
      AS head_old,
    max({got('l', r'^diff --git a/(@+) b/(@+)$', 2)}) FILTER (l LIKE 'diff --git%') AS head_new,
    arg_max(CASE WHEN l LIKE 'new file%' OR l LIKE '--- /dev/null%' THEN 'added' ELSE 'deleted' END,
            pos)
      FILTER (l LIKE 'new file%' OR l LIKE '--- /dev/null%' OR l LIKE 'deleted file%'
              OR l LIKE '+++ /dev/null%') AS set_status
  FROM dh WHERE hs = -1 GROUP BY diff_id, fs
),
dstatus AS MATERIALIZED (
  SELECT diff_id, fs, path,
    coalesce(set_status, CASE WHEN head_old <> head_new THEN 'renamed' ELSE 'modified' END) AS status,
    CASE WHEN set_status = 'added' OR set_old = chr(0) THEN NULL
         ELSE coalesce(set_old, head_old) END AS old_path
  FROM dfiles
),
hunk_heads AS MATERIALIZED (
  SELECT diff_id, fs, hs, pos,
    {has('l', r'^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@')} AS fine,
    {got('l', r'^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 1)} AS g1,
    {got('l', r'^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 2)} AS g2,
    {got('l', r'^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 3)} AS g3,
    {got('l', r'^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 4)} AS g4
  FROM dh WHERE l LIKE '@@%'
),
hunks AS MATERIALIZED (
  SELECT diff_id, fs, hs,
    CASE WHEN fine THEN g1::BIGINT ELSE 0 END AS old_start,
    CASE WHEN NOT fine THEN 0 WHEN g2 = '' THEN 1 ELSE g2::BIGINT END AS old_count,
    CASE WHEN fine THEN g3::BIGINT ELSE 0 END AS new_start,
    CASE WHEN NOT fine THEN 0 WHEN g4 = '' THEN 1 ELSE g4::BIGINT END AS new_count
  FROM hunk_heads
),
body AS MATERIALIZED (
  SELECT diff_id, fs, hs, pos, l,
    CASE WHEN l LIKE '+%' THEN 'add' WHEN l LIKE '-%' THEN 'remove'
         WHEN l LIKE ' %' OR l = '' THEN 'context' WHEN left(l, 1) = chr(92) THEN 'skip'
         ELSE 'stop' END AS kind
  FROM dh WHERE hs >= 0 AND l NOT LIKE '@@%'
),
dlines AS MATERIALIZED (
  SELECT b.diff_id, b.fs, b.hs, b.pos, kind, substr(l, 2) AS content,
    row_number() OVER w - 1 AS line_seq,
    old_start + coalesce(sum((kind <> 'add')::INT) OVER before, 0) AS old_at,
    new_start + coalesce(sum((kind <> 'remove')::INT) OVER before, 0) AS new_at
  FROM (
    SELECT *, max((kind = 'stop')::INT) OVER (PARTITION BY diff_id, fs, hs ORDER BY pos) AS stopped
    FROM body
  ) b JOIN hunks USING (diff_id, fs, hs)
  WHERE stopped = 0 AND kind <> 'skip'
  WINDOW w AS (PARTITION BY diff_id, fs, hs ORDER BY pos),
    before AS (PARTITION BY diff_id, fs, hs ORDER BY pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
kept AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY diff_id, fs ORDER BY pos) AS line
  FROM dlines WHERE kind <> 'remove'
),
dreview AS MATERIALIZED (
  SELECT s.diff_id, s.fs, s.path, coalesce(string_agg(k.content, {NL} ORDER BY k.pos), '') AS content
  FROM dstatus s LEFT JOIN kept k ON k.diff_id = s.diff_id AND k.fs = s.fs
  WHERE s.status <> 'deleted' GROUP BY s.diff_id, s.fs, s.path
),
files AS MATERIALIZED (
  SELECT diff_id * 1000 + fs AS file_seq, path, content FROM dreview
)"""
_DIFF_FINDING = FINDING.replace(
    "file_seq,", "(file_seq // 1000)::BIGINT AS diff_id, (file_seq % 1000)::INT AS file_seq,", 1
)


def _regions() -> str:
    return f"""
coded AS MATERIALIZED (
  SELECT file_seq, line, t, flag, path, n_lines,
    sum(CASE WHEN flag = 'plain' THEN delta ELSE 0 END)
      OVER (PARTITION BY file_seq ORDER BY line)::BIGINT AS depth,
    sum(CASE WHEN flag = 'plain' THEN delta ELSE 0 END)
      OVER (PARTITION BY file_seq ORDER BY line)::BIGINT
      - CASE WHEN flag = 'plain' THEN delta ELSE 0 END AS depth_before,
    coalesce(regexp_matches(lead(t) OVER (PARTITION BY file_seq ORDER BY line),
             '^(catch|finally)\\b'), false) AS continues
  FROM x WHERE t <> ''
),
tries AS MATERIALIZED (
  SELECT h.file_seq, h.line, coalesce((SELECT min(c.line) FROM coded c WHERE c.file_seq = h.file_seq
      AND c.line > h.line AND c.flag = 'plain' AND c.depth = h.depth_before AND NOT c.continues),
      h.n_lines) AS ending
  FROM coded h WHERE h.flag = 'plain' AND {has('h.t', r'(^|[^A-Za-z0-9_])try~*[{]')}
),
regions AS (
  WITH RECURSIVE chain AS (
    SELECT * FROM tries e
    WHERE line = (SELECT min(line) FROM tries o WHERE o.file_seq = e.file_seq)
    UNION ALL
    SELECT e.* FROM chain c JOIN tries e ON e.file_seq = c.file_seq
      AND e.line = (SELECT min(line) FROM tries o WHERE o.file_seq = c.file_seq AND o.line > c.ending)
  )
  SELECT * FROM chain
)"""


def _imports() -> str:
    def hit(pattern):
        return f"nullif({got('t', pattern)}, '')"

    return f"""
imported AS (
  SELECT file_seq, path, line::INT AS line, coalesce(
    {hit(r'''from~+['"]([^'"]+)['"]''')},
    {hit(r'''require\(~*['"]([^'"]+)['"]~*\)''')},
    CASE WHEN NOT contains(t, 'from') AND NOT contains(t, '{{') THEN {hit(r'^import~+(\w+)')} END,
    {hit(r'^from~+(\w+)')}) AS module
  FROM x WHERE flag <> 'comment' AND t <> ''
    AND (t LIKE 'import %' OR t LIKE 'import(%' OR t LIKE 'from %' OR contains(t, 'require('))
)"""


def _file_type() -> str:
    p = "lower(path)"
    return (
        f"CASE WHEN {_any(p, TEST_PATH_PARTS)} THEN 'test' "
        f"WHEN {_any(p, [*CONFIG_PATH_PARTS, '.env'])} OR {p} LIKE '%.rc' OR {p} LIKE '%rc.ts' "
        f"OR {p} LIKE '%rc.js' THEN 'config' "
        f"WHEN {_any(p, ['migration', 'migrate'])} THEN 'migration' "
        f"WHEN {_any(p, ['.generated.', '.gen.'])} THEN 'generated' ELSE 'source' END"
    )


_BRACES = f"""
braces AS MATERIALIZED (
  SELECT file_seq, line, idx, b,
    sum(CASE b WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY file_seq ORDER BY line, idx) AS depth
  FROM (
    SELECT file_seq, line, unnest(regexp_extract_all(text, '[{{}}]')) AS b,
           generate_subscripts(regexp_extract_all(text, '[{{}}]'), 1) AS idx
    FROM x
  )
),
spans AS (
  SELECT file_seq, line AS end_line, idx, b, depth,
    max(CASE WHEN b = '{{' AND depth = 1 THEN line END)
      OVER (PARTITION BY file_seq ORDER BY line, idx) AS start_line
  FROM braces
)"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    all_rows = f"SELECT {FINDING} FROM findings"
    sql = {}
    sql["lines"] = (
        f"WITH {FILES},{LINES} SELECT file_seq, path, line::INT AS line, text FROM raw_lines"
    )
    sql["language_counts"] = (
        f"WITH {FILES},{LINES} SELECT language, count(*) AS files FROM f GROUP BY language"
    )
    sql["language_full"] = (
        f"WITH {FILES} SELECT file_seq, path, {_language('path', PARSER_LANGUAGES)} AS language "
        "FROM files"
    )
    sql["file_types"] = (
        f"WITH {FILES} SELECT file_seq, path, {_file_type()} AS file_type FROM files"
    )
    sql["line_context"] = (
        f"WITH {FILES},{LINES} SELECT file_seq, path, line::INT AS line, text, "
        "flag = 'comment' AS is_comment, flag = 'string' AS is_string, "
        "flag <> 'comment' AND t <> '' AND (t LIKE 'import %' OR t LIKE 'import(%' "
        "OR t LIKE 'from %' OR contains(t, 'require(')) AS is_import, t = '' AS is_blank FROM x"
    )
    sql["imports"] = (
        f"WITH {FILES},{LINES},{_imports()} SELECT * FROM imported WHERE module IS NOT NULL"
    )
    sql["import_module_counts"] = (
        f"WITH {FILES},{LINES},{_imports()} SELECT module, count(*) AS imports FROM imported "
        "WHERE module IS NOT NULL GROUP BY module"
    )
    sql["try_regions"] = (
        f"WITH {FILES},{LINES},{_regions()} SELECT r.file_seq, f.path, r.line::INT AS start_line, "
        "r.ending::INT AS end_line FROM regions r JOIN f USING (file_seq)"
    )
    block_columns = (
        "s.file_seq, f.path, f.language, (row_number() OVER (PARTITION BY s.file_seq ORDER BY "
        "s.start_line, s.end_line{more}) - 1)::INT AS block_seq, s.start_line::INT AS start_line, "
        "s.end_line::INT AS end_line, array_to_string(string_split(f.content, chr(10))"
        "[s.start_line:s.end_line], chr(10)) AS content"
    )
    brace_languages = ", ".join(text(v) for v in BRACE_LANGUAGES)
    sql["brace_blocks"] = (
        f"WITH {FILES},{LINES},{_BRACES} SELECT {block_columns.replace('{more}', ', s.idx')} "
        f"FROM spans s JOIN f USING (file_seq) WHERE f.language IN ({brace_languages}) "
        "AND s.b = '}' AND s.depth = 0"
    )
    sql["indent_blocks"] = (
        f"""WITH {FILES},{LINES},
        defs AS MATERIALIZED (
          SELECT file_seq, line, n_lines, ltrim(text, {WS}) AS code,
            len(text) - len(ltrim(text, {WS})) AS indent,
            {has(f"ltrim(text, {WS})", '^(def |class |async def )')} AS starts
          FROM x WHERE language = 'python'
        ),
        spans AS (
          SELECT d.file_seq, d.line AS start_line, coalesce((SELECT min(e.line) FROM defs e
            WHERE e.file_seq = d.file_seq AND e.line > d.line
              AND (e.starts OR (e.code <> '' AND e.indent <= d.indent))) - 1, d.n_lines) AS end_line
          FROM defs d WHERE starts
        )
        SELECT {block_columns.replace('{more}', '')} FROM spans s JOIN f USING (file_seq)"""
    )
    sql["code_blocks"] = (
        f"SELECT * FROM ({sql['brace_blocks']}) UNION ALL SELECT * FROM ({sql['indent_blocks']})"
    )
    sql["diff_files"] = (
        f"WITH {DIFFS} SELECT diff_id, fs::INT AS file_seq, path, old_path, status FROM dstatus"
    )
    sql["diff_hunks"] = (
        f"WITH {DIFFS} SELECT diff_id, fs::INT AS file_seq, hs::INT AS hunk_seq, old_start, "
        "old_count, new_start, new_count FROM hunks"
    )
    sql["diff_lines"] = (
        f"WITH {DIFFS} SELECT diff_id, fs::INT AS file_seq, hs::INT AS hunk_seq, "
        "line_seq::INT AS line_seq, kind AS type, content, "
        "CASE WHEN kind <> 'add' THEN old_at END::BIGINT AS old_line, "
        "CASE WHEN kind <> 'remove' THEN new_at END::BIGINT AS new_line FROM dlines"
    )
    sql["diff_review_text"] = (
        f"WITH {DIFFS} SELECT diff_id, fs::INT AS file_seq, path, content FROM dreview"
    )
    sql["diff_findings"] = _review(f"SELECT {_DIFF_FINDING} FROM findings", files=DIFFS)
    mapped = _DIFF_FINDING.replace("(file_seq", "(d.file_seq").replace(" line,", " d.line,", 1)
    sql["diff_findings_mapped"] = _review(
        f"SELECT {mapped}, k.new_at::BIGINT AS new_line, (k.kind = 'add') AS is_added "
        "FROM findings d LEFT JOIN kept k ON k.diff_id = d.file_seq // 1000 "
        "AND k.fs = d.file_seq % 1000 AND k.line = d.line",
        files=DIFFS,
    )
    sql["diff_summary"] = _review(
        f"SELECT a.diff_id, {_counts('d.')}, a.files_reviewed, a.rules_applied FROM (SELECT "
        f"(file_seq // 1000)::BIGINT AS diff_id, count(*) AS files_reviewed, max({_applied()}) AS rules_applied "
        "FROM f GROUP BY 1) a LEFT JOIN findings d ON d.file_seq // 1000 = a.diff_id "
        "GROUP BY a.diff_id, a.files_reviewed, a.rules_applied",
        files=DIFFS,
    )
    for rule in RULE_IDS:
        sql[f"rule_{rule}"] = _review(all_rows, rules=(rule,))
    sql["findings_all"] = _review(all_rows)
    sql["findings_sorted"] = _review(
        all_rows + " ORDER BY severity_rank, confidence DESC, file_seq, rule_seq, line, emit_seq"
    )
    sql["findings_no_context"] = _review(all_rows, lines=NO_CONTEXT)
    sql["findings_min_conf_80"] = _review(all_rows + " WHERE confidence >= 80")
    sql["findings_security"] = _review(all_rows + " WHERE category = 'security'")
    medium = [text(r[0]) for r in fv.RULES if r[3] == "medium"]
    sql["findings_rule_severity_medium"] = _review(
        all_rows + f" WHERE rule IN ({', '.join(medium)})"
    )
    sql["check_error_handling"] = _review(all_rows + " WHERE category = 'error-handling'")
    sql["summary"] = _review(
        f"SELECT {_counts()}, (SELECT count(*) FROM f) AS files_reviewed, "
        f"(SELECT max({_applied()}) FROM f) AS rules_applied FROM findings"
    )
    sql["summary_by_file"] = _review(
        f"SELECT f.file_seq, f.path, {_counts('d.')}, 1::BIGINT AS files_reviewed, "
        f"{_applied()} AS rules_applied FROM f LEFT JOIN findings d ON d.file_seq = f.file_seq "
        "GROUP BY f.file_seq, f.path, f.language"
    )
    sql["summary_by_source"] = _review(
        f"SELECT s.source, s.lang, {_counts('d.')}, s.files_reviewed, s.rules_applied FROM "
        f"(SELECT source, lang, count(*) AS files_reviewed, max({_applied()}) AS rules_applied "
        "FROM f JOIN documents ON doc_id * 2 = file_seq GROUP BY source, lang) s "
        "LEFT JOIN (SELECT source, lang, severity FROM findings JOIN documents "
        "ON doc_id * 2 = file_seq) d ON d.source IS NOT DISTINCT FROM s.source "
        "AND d.lang IS NOT DISTINCT FROM s.lang "
        "GROUP BY s.source, s.lang, s.files_reviewed, s.rules_applied"
    )
    sql["severity_groups"] = _review(
        f"SELECT {FINDING}, count(*) OVER (PARTITION BY severity) AS group_size FROM findings"
    )
    rules = _values(
        [str(i), text(r[0]), text(r[1]), text(r[2]), text(r[3]),
         text(", ".join(r[4][:3]) + ("..." if len(r[4]) > 3 else "")),
         "[" + ", ".join(text(v) for v in r[4]) + "]"]
        for i, r in enumerate(fv.RULES)
    )
    sql["rule_coverage"] = (
        f"WITH {FILES},{LINES} SELECT rule_seq::INT AS rule_seq, id, name, category, severity, "
        "languages, (SELECT count(*) FROM f WHERE list_contains(spoken, f.language)) AS files "
        f"FROM {rules} r(rule_seq, id, name, category, severity, languages, spoken)"
    )
    sql["custom_rules"] = (
        f"""WITH {FILES},{LINES}
        SELECT file_seq, path AS file, line::INT AS line, CASE WHEN k = 1 THEN n_lines END::INT AS end_line,
          CASE k WHEN 0 THEN 'DOC001' ELSE 'DOC002' END AS rule, 'test-coverage' AS category,
          CASE k WHEN 0 THEN 'low' ELSE 'high' END AS severity, CASE k WHEN 0 THEN 50 ELSE 70 END::INT AS confidence,
          CASE k WHEN 0 THEN 'Line of ' || len(text) || ' characters'
                 ELSE 'File of ' || n_lines || ' lines' END AS message,
          text AS snippet, CASE k WHEN 1 THEN 'Split the file' END AS suggestion,
          CASE k WHEN 0 THEN 3 ELSE 1 END::INT AS severity_rank, k::INT AS rule_seq, 0::INT AS emit_seq
        FROM (SELECT 0 AS k, * FROM x WHERE len(text) > 1000 AND flag = 'plain'
              UNION ALL SELECT 1, * FROM x WHERE n_lines > 40 AND line = 1)"""
    )
    sql["line_context_chunked"] = sql["line_context"]
    sql["try_regions_chunked"] = sql["try_regions"]
    sql["brace_spans_chunked"] = (
        f"SELECT file_seq, path, block_seq, start_line, end_line FROM ({sql['brace_blocks']})"
    )
    sql["streaming_review"] = sql["findings_all"]
    sql["directory_files"] = (
        f"WITH {FILES} SELECT file_seq, false AS is_empty_twin, length(content)::INT AS n_chars, "
        f"len(string_split(content, {NL}))::INT AS n_lines FROM files "
        "UNION ALL SELECT file_seq, true, 0, 1 FROM files"
    )
    sql["directory_review"] = sql["streaming_directory_review"] = sql["findings_all"]
    sql["streaming_summary_by_source"] = sql["summary_by_source"]
    sql["streaming_severity_sizes"] = " UNION ALL ".join(
        f"SELECT '{s}' AS severity, sum({s})::BIGINT AS group_size FROM ({sql['summary_by_source']}) HAVING sum({s}) > 0"
        for s in fv.SEVERITIES
    )
    sql["streaming_diff_review"] = sql["diff_findings"]
    sql["findings_sink"] = _review(
        "SELECT severity, rule, count(*) AS findings FROM findings GROUP BY severity, rule"
    )
    return sql
