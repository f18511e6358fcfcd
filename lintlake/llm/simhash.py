"""Near-duplicate groups by SimHash, with pigeonhole blocks.

Fingerprints are made batch by batch where texts are read; after that only ids and 64-bit
numbers move. Equal fingerprints are one node, so copies, however many, never form pairs.

Links. Fingerprints are cut into six blocks. Two that differ in three bits at most agree in
three blocks at least, so each is keyed by every three of its blocks, 20 keys of about 32
bits, and only fingerprints with an equal key are compared. Where a key has gathered many
fingerprints, its rows are keyed once more by every three of the six halves of the other
blocks, by the same argument; no pair is lost and no group is ever paired off whole.

Components of the links are found by alternating large and small stars, each round a written
table in the shared folder. Nothing is collected but a few counts.

Null and empty texts have fingerprint zero, linked like any other. Repeated rows and ids are
rows of their own. A component's id is its smallest doc_id; null ids count only where there is
no other. Columns other than id and text are not read. Empty tables give empty tables.

Representatives can be asked for over wider groups (``similar``), in which texts are linked too
whose five-word shingles are alike to 0.8 or more (``near_copies``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import PIECE_BYTES, join_hot, row_key, with_batch_columns, written
from .near_copies import SET_COLUMNS, near_copies, set_columns

SEED = 42
SHINGLE = 3
MOST_BITS = 3
BLOCKS = 6
#: Fingerprints under one key from which on it is keyed once more.
CROWDED = 1000
_PART = 50_000


def fingerprint(text: str | None) -> int:
    """SimHash of the text's word shingles as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, shingles, _PART):
        to = min(at + _PART, shingles)
        bounds = zip(starts[at:to], ends[SHINGLE - 1 :][at:to] or ends[-1:])
        hashes = np.array([digest(line[a : b - 1], SEED) for a, b in bounds], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > shingles).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", sets: bool = False) -> DataFrame:
    """docs without the text, with its fingerprint as a (signed) long, and with ``sets`` its shingle set's columns."""

    def compute(texts):
        values = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
        return {name: pa.array(values.view(np.int64)), **(set_columns(texts) if sets else {})}

    # One pass for both: a second one would hold a second Python worker for each task.
    return with_batch_columns(docs, [text], {name: LongType(), **(SET_COLUMNS if sets else {})}, compute, PIECE_BYTES, (text,))


def _masks(parts: int, within: int = (1 << 64) - 1) -> list[int]:
    """The set bits of ``within`` cut into so many parts: a mask for each."""
    bits = [b for b in range(64) if within >> b & 1]
    return [sum(1 << bits[k] for k in range(p * len(bits) // parts, (p + 1) * len(bits) // parts)) for p in range(parts)]


def key_masks(within: int = (1 << 64) - 1) -> list[int]:
    """Masks of every choice of blocks that two close fingerprints must share one of."""
    return [sum(chosen) for chosen in combinations(_masks(BLOCKS, within), BLOCKS - MOST_BITS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _close(left: str, right: str):
    a, b = F.col(left), F.col(right)
    return (a < b) & (F.bit_count(a.bitwiseXOR(b)) <= MOST_BITS)


def links(fingerprints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in three bits at most."""
    masks = key_masks()
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(_signed(m)).alias("mask")) for k, m in enumerate(masks)))
    keyed = fingerprints.select("fingerprint", F.explode(table).alias("m")).select(
        "fingerprint", "m.k", F.col("fingerprint").bitwiseAND(F.col("m.mask")).alias("key")
    )
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowds = sizes.where(F.col("n") > crowded).select("k", "key", F.lit(True).alias("crowd"))
    marked = keyed.join(crowds, ["k", "key"], "left")
    plain = marked.where("crowd IS NULL").withColumn("j", F.lit(-1))
    finer = {k: [_signed(m | x) for x in key_masks(((1 << 64) - 1) & ~m)] for k, m in enumerate(masks)}
    nested = F.array(*(F.array(*(F.lit(x) for x in finer[k])) for k in range(len(masks))))
    split = marked.where("crowd").select(
        "fingerprint", "k", F.posexplode(F.element_at(nested, F.col("k") + 1)).alias("j", "mask")
    )
    split = split.select("fingerprint", "k", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"), "j")
    keys = plain.select("fingerprint", "k", "j", "key").unionByName(split.select("fingerprint", "k", "j", "key"))
    left = keys.select(F.col("fingerprint").alias("a"), "k", "j", "key")
    right = keys.select(F.col("fingerprint").alias("b"), F.col("k").alias("k2"), F.col("j").alias("j2"), F.col("key").alias("key2"))
    same = (F.col("k") == F.col("k2")) & (F.col("j") == F.col("j2")) & (F.col("key") == F.col("key2"))
    return left.join(right, same & _close("a", "b")).select("a", "b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b); the root is the smallest reachable."""
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_hot(both, least, ["u"], 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, least, ["u"], large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "small-star")
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _similar_links(prints: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Pairs (a, b), a < b, of fingerprints of texts with alike or equal shingle sets."""
    of_set = prints.groupBy("set_key").agg(
        F.min("fingerprint").alias("print"), F.min("__llm_key").alias("row_key"), F.min("set_size").alias("set_size"),
        F.first("set_bands").alias("set_bands"), F.first("set_sketch").alias("set_sketch"),
    )
    sets = written(of_set, "near-nodes")
    pairs = written(near_copies(docs, sets, text), "near-copies")
    one, other = (sets.select(F.col("set_key").alias(c), F.col("print").alias(f"{c}_print")) for c in "ab")
    alike = pairs.join(one, "a").join(other, "b").select("a_print", "b_print")
    equal = prints.select("set_key", "fingerprint").distinct().join(sets.select("set_key", "print"), "set_key").select("print", "fingerprint")
    both = alike.union(equal).toDF("p", "q").where("p <> q")
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", crowded: int = CROWDED, carry: tuple[str, ...] = (), similar: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and the columns in ``carry`` of every row.

    With ``similar`` (which needs ``__llm_key`` carried) near copies are linked as well.
    """
    columns = ["doc_id", *carry]
    marked = with_fingerprints(docs.select(*columns, text), text, "fingerprint", similar)
    prints = written(marked.select(*columns, "fingerprint", *(SET_COLUMNS if similar else ())), "fingerprints")
    nodes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "nodes")
    linked = links(nodes.select("fingerprint"), crowded)
    roots = components(linked.union(_similar_links(prints, docs, text)).distinct() if similar else linked)
    placed = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least_id", "n", F.coalesce("root", "fingerprint").alias("root")
    )
    placed = written(placed, "placed")
    ids = placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_print = join_hot(placed.withColumnRenamed("n", "copies"), ids, ["root"], placed.count())
    of_print = of_print.select("fingerprint", F.col("copies").alias("n"), F.col("root").alias("component"), "component_id")
    joined = join_hot(prints, of_print, ["fingerprint"], prints.count())
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return joined.select("doc_id", hexed, "component_id", "component", *carry)


def representatives(docs: DataFrame, text: str = "text", crowded: int = CROWDED, similar: bool = False) -> DataFrame:
    """One row of docs for each component: of its smallest doc_id, and there of the least key.

    Texts are shuffled once, to meet the rows' verdicts.
    """
    keyed = docs.withColumn("__llm_key", row_key(text=text))
    grouped = near_duplicates(keyed, text, crowded, ("__llm_key",), similar)
    least = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__llm_key")).alias("least"))
    chosen = least.select(F.col("least.__llm_key").alias("__llm_chosen"))
    found = keyed.join(chosen, F.col("__llm_key") == F.col("__llm_chosen"))
    one = Window.partitionBy("__llm_key").orderBy("__llm_chosen")
    return found.withColumn("__llm_turn", F.row_number().over(one)).where("__llm_turn = 1").select(docs.columns)
