"""Quality rules by host: failure rates of hosts, shrunk, join back to their documents.

Every text is judged by rules. Failures are added up by host (a partial aggregate on the map
side, so a host with a third of all rows sends one row per task). Each rule's rates over all
hosts give a beta prior by the method of moments, and a host's rate is shrunk towards it:
(failures + a) / (documents + a + b). A document is rejected if

* it fails a base rule: fewer than 50 words, or over half of its words in repeated windows,
* it fails a rule that is usual on its host (shrunk rate over ``rule_rate``), or
* its host as a whole fails (shrunk rate of any failure over ``host_rate``).

So a document without any failure goes only with a host that is junk nearly throughout.

Null texts have no words and fail; null hosts are one host. Repeated rows and ids are judged
row by row. Other columns stay; one with the name of an added column is replaced. On an empty
table there are no hosts, and the result is empty.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import with_batch_columns, written
from .text_rules import count_text

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule to the expression that says a document fails it.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "lines": "10 * n_dup_lines > n_words",
}
BASE = ("short", "repeats")
#: Bounds of a prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6


def count_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules need."""

    def compute(texts):
        rows = [count_text(t or "") for t in texts]
        return {name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(COUNTS)}

    return with_batch_columns(docs, [text], dict.fromkeys(COUNTS, LongType()), compute)


def _failures() -> dict[str, str]:
    return RULES | {"any": " OR ".join(f"({rule})" for rule in RULES.values())}


def host_rates(counted: DataFrame, host: str = "source") -> DataFrame:
    """A row per host: documents, and for each rule failures and the shrunk rate."""
    rules = list(_failures())
    sums = [F.sum(F.expr(f"CASE WHEN {rule} THEN 1L ELSE 0L END")).alias(f"{name}_failures") for name, rule in _failures().items()]
    hosts = written(counted.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *sums), "host-failures")
    # One row for all hosts: the mean rate of each rule and the variance between hosts.
    means = hosts.agg(F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("hosts"), *(F.sum(f"{r}_failures").alias(r) for r in rules)).first()
    total = means["n"] or 0
    mean = {r: (means[r] or 0) / max(total, 1) for r in rules}
    spread = hosts.agg(*(F.sum(F.col("n_docs") * F.pow(F.col(f"{r}_failures") / F.col("n_docs") - mean[r], 2)).alias(r) for r in rules)).first()
    for r in rules:
        chance = mean[r] * (1 - mean[r])
        between = (spread[r] or 0) / max(total, 1) - chance * means["hosts"] / max(total, 1)
        weight = MOST_WEIGHT if between <= 0 else min(max(chance / between - 1, LEAST_WEIGHT), MOST_WEIGHT)
        hosts = hosts.withColumn(f"{r}_rate", (F.col(f"{r}_failures") + mean[r] * weight) / (F.col("n_docs") + weight))
    return hosts


def judge(
    docs: DataFrame, host: str = "source", text: str = "text", rule_rate: float = 0.5, host_rate: float = 0.8
) -> DataFrame:
    """docs with counts, base_failed, the host's shrunk failure rate, and kept.

    Texts are read twice, once for the hosts' rates and once for the verdicts; only a row per
    host is shuffled and written.
    """
    rates = host_rates(count_rules(docs.select(host, text), text), host)
    verdicts = rates.select(
        F.col("host").alias("__llm_verdict_host"), F.col("any_rate").alias("__llm_host_rate"),
        *((F.col(f"{r}_rate") > rule_rate).alias(f"__llm_usual_{r}") for r in RULES),
    )
    counted = count_rules(docs, text)
    joined = counted.join(verdicts, counted[host].eqNullSafe(verdicts["__llm_verdict_host"]), "left")
    usual = " OR ".join(f"(__llm_usual_{r} AND ({rule}))" for r, rule in RULES.items())
    base = " OR ".join(f"({RULES[r]})" for r in BASE)
    return joined.withColumns(
        {
            "base_failed": F.expr(base),
            "host_failure_rate": F.col("__llm_host_rate"),
            "kept": F.expr(f"NOT ({base}) AND NOT ({usual}) AND __llm_host_rate <= {host_rate}D"),
        }
    ).drop("__llm_verdict_host", "__llm_host_rate", *(f"__llm_usual_{r}" for r in RULES))
