"""Mixing sources to target weights by the cube method.

Targets. Sources in code point order (null last) get the weights 1, 2, 3, repeating, of all
words; a target stops at a multiple of its source's size, and what is left over is shared by
weight among the others until none is above. Every document of a source is to be taken
``target / source size`` times: a whole number of times, and once more with a probability that
is the fraction left.

Cube method. The fractions are moved in the null space of two constraints, so that in every
step the expected number of documents and of words stay as they are, until a fraction is 0 or
1. Documents are dealt into blocks by source and hash; three open documents at a time are
moved along the one direction that keeps both totals, and one of them settles. A block leaves
two open at most, which go to the blocks of the next level, a thousandth in number, until one
block is left of each source. There the flight leaves out a dozen units of all sizes, and the
landing settles them with the last two: of all outcomes the one whose words and documents are
nearest to the expected totals.

Only ids, hashes and sizes are shuffled, never texts, and no block grows with a source: a
source with a third of all rows has a third of the blocks. Every choice comes from hashes of
rows and block numbers, so reruns agree.

Null texts and sources of size zero take no words. Rows that repeat an id, source and text are
one unit, taken alike. Other columns have no influence. Empty tables give empty tables.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bucket_of, known_to_workers, ranked, written

#: Units in a block of the flight, about.
BLOCK = 2000
#: Units that a source's last block leaves to the landing.
HELD = 12
#: What makes rows one unit.
UNIT = ("doc_id", "source", "text_hash")


def n_words(text: str = "text"):
    """Number of words, without a Python worker."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, most: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """source, source_size, units and target of every source; ``sized`` holds source, size and rows.

    The level at which targets stop is found by a few sums over the sources' table.
    """
    totals = written(
        sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units")),
        "source-sizes",
    )
    # Number the sources in order: by range, then inside the range.
    ranges = written(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()).withColumn("all", F.lit(0)), "source-ranges")
    order = [F.col("source").asc_nulls_last()]
    numbered = ranked(ranges, "all", "range", order, "number")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = written(numbered.select("source", "source_size", "units", weight.alias("weight")), "source-weights")
    cap = F.col("source_size") * F.lit(float(most))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        stopped = F.lit(False) if level is None else F.col("weight") * level > cap
        sums = weighed.agg(
            F.sum(F.when(stopped, cap).otherwise(0.0)).alias("stopped"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not sums["weight"]:
            break
        following = (total - sums["stopped"]) / sums["weight"]
        if level is not None and following <= level:
            break
        level = following
    target = F.least(cap, F.col("weight") * F.lit(float(level or 0.0)))
    return weighed.select("source", "source_size", "units", target.alias("target"))


def fly(share: np.ndarray, rows: np.ndarray, size: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Shares after the flight: all but two at most are 0 or 1.

    The sums of share times rows (documents) and of share times size (words) are kept.
    """
    shares, n, w = share.tolist(), rows.tolist(), size.tolist()
    draws = random.random(len(shares) + 1).tolist()
    open_: list[int] = []
    for i in random.permutation(len(shares)).tolist():
        if not 0.0 < shares[i] < 1.0:
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        # The direction that leaves documents and words as they are.
        u = [n[b] * w[c] - n[c] * w[b], n[c] * w[a] - n[a] * w[c], n[a] * w[b] - n[b] * w[a]]
        if u == [0, 0, 0]:
            u = [n[b], -n[a], 0]
        room = [((1 - shares[k]) / x, shares[k] / x) if x > 0 else (shares[k] / -x, (1 - shares[k]) / -x) for k, x in zip(open_, u) if x]
        up, down = min(r[0] for r in room), min(r[1] for r in room)
        step = up if draws[i] * (up + down) < down else -down
        for k, x in zip(open_, u):
            moved = shares[k] + step * x
            shares[k] = 0.0 if moved < 1e-9 else 1.0 if moved > 1 - 1e-9 else moved
        open_ = [k for k in open_ if 0.0 < shares[k] < 1.0]
    return np.array(shares)


def land(share: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few shares that are left, settled nearest to the expected words and documents.

    A document off counts as a hundredth of a mean one's words.
    """
    open_ = np.flatnonzero((share > 0) & (share < 1))
    outcomes = np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_)) & 1
    off = outcomes - share[open_]
    mean = size.sum() / max(rows.sum(), 1)
    cost = np.abs(off @ size[open_]) + 0.01 * mean * np.abs(off @ rows[open_])
    out = share.copy()
    out[open_] = outcomes[cost.argmin()]
    return out


def _settle(share: np.ndarray, rows: np.ndarray, size: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Flight and landing of a source's last block."""
    open_ = np.flatnonzero((share > 0) & (share < 1))
    by_size = open_[np.argsort(size[open_], kind="stable")]
    held = by_size[np.unique(np.linspace(0, len(by_size) - 1, HELD).astype(int))] if len(by_size) else by_size
    flying = np.setdiff1d(np.arange(len(share)), held)
    out = share.copy()
    out[flying] = fly(share[flying], rows[flying], size[flying], random)
    return land(out, rows, size)


def _flown(block: pa.Table) -> pa.Table:
    """A block after its flight; a source's only block is settled."""
    block = block.sort_by([("row_key", "ascending"), ("size", "ascending")])
    seed = zlib.crc32(f"{block['source'][0]}/{block['block'][0]}/{block['level'][0]}".encode())
    rows, size = block["rows"].to_numpy(), block["size"].to_numpy() * block["rows"].to_numpy()
    move = _settle if block["blocks"][0].as_py() == 1 else fly
    share = move(block["share"].to_numpy(), rows, size, np.random.default_rng(seed))
    return block.set_column(block.column_names.index("share"), "share", pa.array(share))


def balanced_sample(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """units with every ``share`` moved to 0 or 1 by the cube method.

    ``units`` (a written table) has row_key, source, rows, size, share, and ``blocks``, the
    number of blocks its source is dealt into. Words and documents of every source stay at
    their expected totals but for the landing of its last few units.
    """
    known_to_workers(units.sparkSession)
    columns = units.columns
    schema = units.withColumn("block", F.lit(0).cast("long")).withColumn("level", F.lit(0)).schema
    is_open = (F.col("share") > 0) & (F.col("share") < 1)
    out, rows, level = units.where(~is_open), units.where(is_open), 0
    most = rows.agg(F.max("blocks")).first()[0] or 0
    while most:
        dealt = rows.withColumn("block", bucket_of("row_key", buckets=F.col("blocks"), seed=level)).withColumn("level", F.lit(level))
        flown = dealt.groupBy("source", "block").applyInArrow(_flown, schema).select(columns)
        flown = written(flown.withColumn("blocks", F.ceil(F.col("blocks") * 2 / block).cast("long")), f"mix-level-{level}")
        out = out.unionByName(flown.where(~is_open))
        rows, level = flown.where(is_open), level + 1
        most = 0 if most == 1 else -(-most * 2 // block)
    return out


def mix(docs: DataFrame, most: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), block: int = BLOCK) -> DataFrame:
    """A row per unit of docs(doc_id, source, text): rows, size, source_size, target, copies.

    ``copies`` says how often each of the unit's rows is taken.
    """
    hashed = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), n_words().alias("size"))
    sized = written(hashed.groupBy(*UNIT, "size").agg(F.count(F.lit(1)).alias("rows")), "mix-units")
    targets = source_targets(sized, most, weights).withColumnRenamed("source", "_source")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["_source"])).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    units = joined.withColumns(
        {
            "whole": whole.cast("long"),
            "share": F.when(rate - whole < 1e-12, 0.0).otherwise(rate - whole),
            "row_key": F.xxhash64(*UNIT),
            "blocks": F.ceil(F.col("units") / block).cast("long"),
        }
    ).drop("units")
    sampled = balanced_sample(written(units, "mix-shares"), block)
    return sampled.select(
        *UNIT, "rows", "size", "source_size", "target", (F.col("whole") + F.col("share").cast("long")).alias("copies")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies say, not at all for none.

    Columns are those of docs. Texts are shuffled once, to meet their decisions.
    """
    decided = mix(docs.select("doc_id", "source", "text"), **options).where("copies > 0")
    decided = decided.select(*(F.col(c).alias(f"__llm_{c}") for c in UNIT), F.col("copies").alias("__llm_copies"))
    hashed = docs.withColumn("__llm_hash", F.xxhash64("text"))
    same = (
        (F.col("__llm_hash") == F.col("__llm_text_hash"))
        & F.col("doc_id").eqNullSafe(F.col("__llm_doc_id"))
        & F.col("source").eqNullSafe(F.col("__llm_source"))
    )
    copies = F.sequence(F.lit(1).cast("long"), F.col("__llm_copies"))
    return hashed.join(decided, same).withColumn("__llm_copy", F.explode(copies)).select(docs.columns)
