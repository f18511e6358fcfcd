"""SQL for DuckDB with the results of the queries that SQL can express."""

from __future__ import annotations

from . import decontamination, hard_negatives, host_rules


def _host_rules() -> str:
    rules = host_rules._failures()
    word = r"[^\x20\x09-\x0D]+"
    sums = ", ".join(f"sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS f_{name}" for name, rule in rules.items())
    means = ", ".join(f"sum(f_{r}) / sum(n) AS m_{r}" for r in rules)
    between = ", ".join(
        f"(SELECT sum(n * (f_{r} / n - m_{r}) ** 2) FROM hosts) / total - m_{r} * (1 - m_{r}) * n_hosts / total AS v_{r}" for r in rules
    )
    weights = ", ".join(
        f"CASE WHEN v_{r} <= 0 THEN {host_rules.MOST_WEIGHT} ELSE least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, "
        f"{host_rules.LEAST_WEIGHT}), {host_rules.MOST_WEIGHT}) END AS w_{r}"
        for r in rules
    )
    rates = ", ".join(f"(f_{r} + m_{r} * w_{r}) / (n + w_{r}) AS r_{r}" for r in rules)
    base = " OR ".join(f"({host_rules.RULES[r]})" for r in host_rules.BASE)
    usual = " OR ".join(f"(r_{r} > 0.5 AND ({rule}))" for r, rule in host_rules.RULES.items())
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents),
    words AS (
        SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
        FROM (SELECT row_id, regexp_extract_all(text, '{word}') AS w FROM docs)
    ),
    windows AS (
        SELECT row_id, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram
        FROM words WINDOW o AS (PARTITION BY row_id ORDER BY pos)
    ),
    twice AS (
        SELECT row_id, pos FROM windows WHERE gram IS NOT NULL
        QUALIFY count(*) OVER (PARTITION BY row_id, gram) > 1
    ),
    repeats AS (
        SELECT row_id, count(DISTINCT pos + k) AS n_repeat_words FROM twice, unnest([0, 1, 2]) AS t(k) GROUP BY row_id
    ),
    counts AS (SELECT row_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY row_id),
    lines AS (
        SELECT row_id, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM docs)
        WHERE regexp_matches(line, '{word}') GROUP BY row_id
    ),
    counted AS (
        SELECT doc_id, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
            coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM docs LEFT JOIN counts USING (row_id) LEFT JOIN lines USING (row_id) LEFT JOIN repeats USING (row_id)
    ),
    hosts AS (SELECT source, count(*) AS n, {sums} FROM counted GROUP BY source),
    means AS (SELECT sum(n) AS total, count(*) AS n_hosts, {means} FROM hosts),
    between_hosts AS (SELECT *, {between} FROM means),
    weights AS (SELECT *, {weights} FROM between_hosts),
    rates AS (SELECT source, {rates} FROM hosts, weights)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed,
        NOT ({base}) AND NOT ({usual}) AND r_any <= 0.8 AS kept
    FROM counted JOIN rates ON counted.source IS NOT DISTINCT FROM rates.source
    """


def _hard_negatives() -> str:
    own = hard_negatives
    return f"""
    WITH usable AS (
        SELECT row_number() OVER () AS row_id, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ),
    vecs AS (SELECT row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, x FROM usable),
    scored AS (
        SELECT a.row_id AS anchor, a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
            list_inner_product(a.x, b.x)::BIGINT AS score
        FROM vecs a JOIN vecs b ON a.row_id <> b.row_id WHERE a.vec_id % {own.EVERY} = 0
    ),
    positives AS (
        SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score,
            row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
        FROM scored WHERE same QUALIFY place <= {own.POSITIVES}
    )
    SELECT anchor_id, positive_id, row_number() OVER o AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor, anchor_id)
    WHERE NOT same AND {own.LOW} * positive_score <= 100 * score AND 100 * score <= {own.HIGH} * positive_score
    WINDOW o AS (PARTITION BY anchor, place ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER o <= {own.NEGATIVES}
    """


def _decontamination() -> str:
    window = decontamination.WINDOW
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH items AS (SELECT item_id, regexp_extract_all({lower}, '{word}') AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(len(w), {window}) AS size, array_to_string(w[k : k + least(len(w), {window}) - 1], ' ') AS words
        FROM items, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS t(k) WHERE len(w) > 0
    ),
    docs AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
    places AS (
        SELECT row_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS words
        FROM docs, (SELECT DISTINCT size FROM windows) AS sizes, unnest(range(1, len(w) - size + 2)) AS t(k)
    ),
    found AS (SELECT row_id, item_id, size, k FROM places JOIN windows USING (size, words)),
    hits AS (SELECT row_id, count(DISTINCT k + n) AS n_hit FROM found, unnest(range(size)) AS t(n) GROUP BY row_id),
    named AS (
        SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
        FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY row_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hits USING (row_id) LEFT JOIN named USING (row_id)
    """


def oracle_sql() -> dict[str, str]:
    return {"op9_host_rules": _host_rules(), "op11_hard_negatives": _hard_negatives(), "op12_decontamination": _decontamination()}
