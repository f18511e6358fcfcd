"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At 0.8 two 64-bit SimHashes differ in some ten bits, too many for pigeonhole blocks: candidates come from
MinHash bands instead, and each link is verified by the exact similarity of the sets. Equal sets are one
node, so copies, however many, never form pairs. A pair of similarity 0.8 has an equal one of the 24 bands
(of six values each) with a probability of 0.9993, a closer one with more.

Sets that share a band are a group. Groups are never paired off: in each of two rounds the sets of a group are
compared with the group's head only, which then leaves it. The head is the set with the most company in its
bands, for a text that others were made from has more in common with them than they have with each
other; in the second round one that is linked to nothing yet. Sets linked so far carry a label in common; a group with one label
is done, since further links in it would connect nothing. A comparison is first made by sketches, a byte of each of the
144 values; the exact one follows where they agree as those of a pair of 0.8 do, but for 1 in 4,000.

What is left goes on in clusters: groups whose heads have one label are one cluster. A cluster has a centre, the
shingles that over half of its sets have, and a set is known by its delta, what it has more or less than the
centre. Two sets differ in what their deltas differ in, so they are alike exactly if their deltas differ in a ninth of
the two sizes at most. Hence, with ``excess`` for nine times a delta's size less the set's, two facts:

* Sets whose excesses add up to nothing or less are alike whatever they hold. All such pairs of a cluster are connected by links to
  the set of the least excess.
* Other alike sets have at least an eighteenth of the sum of their excesses in common in their deltas. So it is enough to compare sets that
  meet in the first, rarest parts of their deltas, with enough of both left from there on.

This loses no link, and neither what most of a cluster has nor what one set alone has is ever a key: texts of a form, which
have much in common without being alike, and copies with changes of their own do not meet. The sets that do are those that depart
from their centre in the same way; the work grows with the number of their pairs of unequal label. What comes out connects
all that is alike; links that add nothing to it are not all listed.

Texts of fewer words have one shingle. Null and empty texts have none, are equal, and are linked to nothing
else. Repeated rows are one set. Only the text, ``doc_id`` and the sets' own columns are read, so other columns
may have any name. An empty table gives no links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, LongType

from .common import PIECE_BYTES, join_hot, row_key, with_batch_columns, written

SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 24, 6
VALUES = BANDS * ROWS
#: Rounds of comparisons with the heads of band groups.
ROUNDS = 2
#: Two sets are alike if what only one of them has is at most their sizes together divided by this.
APART = round((1 + LIKENESS) / (1 - LIKENESS))
#: Bits of a key in a delta that are left to the shingle's hash, below its number of sets.
_HASH_BITS = 43
#: Bytes of the sketches that agree at least: 3.5 deviations below what is expected of a pair of 0.8.
AGREEING = int(VALUES * (LIKENESS + (1 - LIKENESS) / 256) - 3.5 * (VALUES * LIKENESS * (1 - LIKENESS)) ** 0.5)
_PART = 2_000
_random = np.random.default_rng(5)
_FACTORS = _random.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 1 << 64, VALUES, np.uint64)
_MIX = _random.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the text's distinct shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    count = max(1, len(words) - SHINGLE + 1) if words else 0
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + SHINGLE])) for i in range(count)), np.uint64, count))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the bands, sketch) of a set."""
    least = np.full(VALUES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), _PART):
            least = np.minimum(least, ((shingles[at : at + _PART, None] ^ _MASKS) * _FACTORS).min(axis=0))
        mixed = (least ^ least >> np.uint64(29)) * _MIX
        return mixed.reshape(BANDS, ROWS).sum(axis=1), (mixed >> np.uint64(56)).astype(np.uint8)


def set_columns(texts: list[str | None]) -> dict[str, pa.Array]:
    """What ``with_sets`` adds, for a batch; one set at a time is held."""
    names, sizes = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
    keys, sketches = np.zeros((len(texts), BANDS), np.uint64), np.zeros((len(texts), VALUES), np.uint8)
    for i, text in enumerate(texts):
        own = shingle_set(text)
        names[i], sizes[i] = xxhash.xxh64_intdigest(own.tobytes()), len(own)
        keys[i], sketches[i] = signature(own)

    def listed(rows):
        bounds = np.arange(len(texts) + 1, dtype=np.int32) * rows.shape[1]
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(rows.reshape(-1)))

    return {
        "set_key": pa.array(names.view(np.int64)),
        "set_size": pa.array(sizes),
        "set_bands": listed(keys.view(np.int64)),
        "set_sketch": listed(sketches.view(np.int8)),
    }


SET_COLUMNS = {"set_key": LongType(), "set_size": LongType(), "set_bands": ArrayType(LongType()), "set_sketch": ArrayType(ByteType())}


def with_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``set_key``, which names the text's set, the set's size, its band keys and its sketch."""
    return with_batch_columns(docs, [text], SET_COLUMNS, set_columns)


def _alike(common: Column, left: Column, right: Column) -> Column:
    return common >= LIKENESS * (left + right - common)


def _agreeing(left: Column, right: Column) -> Column:
    same = F.zip_with(left, right, lambda a, b: F.when(a == b, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda total, one: total + one) >= AGREEING


def _grouped(keyed: DataFrame) -> DataFrame:
    """(group, set_key, weight) of the keyed sets in groups of two or more; weight is a set's company in all its groups."""
    keyed = written(keyed, "near-keys")
    sizes = keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = join_hot(keyed, sizes.withColumn("company", F.col("n")), ["group"], keyed.count())
    weights = shared.groupBy("set_key").agg(F.sum("company").alias("weight"))
    return shared.select("group", "set_key").join(weights, "set_key")


def _band_groups(sets: DataFrame) -> DataFrame:
    banded = sets.where("set_size > 0").select("set_key", F.posexplode("set_bands").alias("k", "key"))
    return _grouped(banded.select(F.xxhash64("k", "key").alias("group"), "set_key"))


def _clusters(active: DataFrame) -> DataFrame:
    """(cluster, set_key, set_size, label) of the groups that hold two labels or more."""
    first = F.max(F.struct("weight", "set_key", "label"))["label"].alias("cluster")
    groups = active.groupBy("group").agg(first, F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    members = join_hot(active, groups.where("low < high").select("group", "n", "cluster"), ["group"], active.count())
    return members.select("cluster", "set_key", "set_size", "label").dropDuplicates(["cluster", "set_key"])


def _deltas(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with ``delta``, the keys of what a set has more or less than its cluster's centre, rarest first,
    ``lone``, the number of shingles that no other set of the cluster has (they come before, and need no keys), and ``excess``."""
    members = written(members, "near-members")
    held = members.select("cluster", "set_key").join(found, "set_key").select("cluster", "set_key", F.explode("shingles").alias("shingle"))
    held = written(held, "near-held")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"))
    counts = held.groupBy("cluster", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(sizes, "cluster")
    central = 2 * F.col("n") > F.col("sets")
    departing = F.least(F.when(central, F.col("sets") - F.col("n")).otherwise(F.col("n")), F.lit(1 << 19))
    hashed = F.xxhash64("shingle").bitwiseAND(F.lit((1 << _HASH_BITS) - 1))
    key = F.shiftleft(departing, _HASH_BITS).bitwiseOR(hashed)
    counts = written(counts.select("cluster", "shingle", "n", central.alias("central"), key.alias("key")), "near-counts")
    shared = join_hot(held, counts, ["cluster", "shingle"], held.count())
    parts = [F.collect_list(F.when(which, F.col("key"))).alias(name) for name, which in (("has", F.col("central")), ("more", ~F.col("central")))]
    shared = shared.groupBy("cluster", "set_key").agg(*parts, F.count(F.lit(1)).alias("shared"))
    centres = counts.where("central").groupBy("cluster").agg(F.collect_list("key").alias("centre"))
    centres = sizes.withColumnRenamed("sets", "n").join(centres, "cluster", "left")
    each = join_hot(members.join(shared, ["cluster", "set_key"], "left"), centres, ["cluster"], members.count())
    none = F.array().cast("array<bigint>")
    less = F.array_except(F.coalesce("centre", none), F.coalesce("has", none))
    each = each.withColumn("delta", F.array_sort(F.concat(F.coalesce("more", none), less)))
    each = each.withColumn("lone", F.col("set_size") - F.coalesce("shared", F.lit(0)))
    excess = APART * (F.col("lone") + F.size("delta")) - F.col("set_size")
    return each.select(*members.columns, "delta", "lone", excess.alias("excess"))


def _pairs_by_delta(deltas: DataFrame) -> DataFrame:
    """Pairs (a, b) of which all that are alike in a cluster are connected by those that are, with their labels."""
    deltas = written(deltas, "near-deltas")
    best = F.min(F.struct("excess", "set_key", "label")).alias("best")
    bests = deltas.groupBy("cluster").agg(best, F.count(F.lit(1)).alias("n"))
    near = F.col("excess") + F.col("best.excess") <= 0
    each = join_hot(deltas, bests, ["cluster"], deltas.count()).withColumn("near", near)
    star = each.where("near AND label <> best.label")
    star = star.select(F.col("best.set_key").alias("a"), F.col("set_key").alias("b"), F.col("best.label").alias("a_label"), F.col("label").alias("b_label"))
    far = deltas.join(bests, "cluster").where(~near).groupBy("cluster").agg(F.min("excess").alias("far_excess"))
    each = each.join(far, "cluster")
    # Near sets are connected with the best one and need only meet those that are not.
    other = F.when(F.col("near"), F.col("far_excess")).otherwise(F.col("best.excess"))
    common = F.greatest(F.lit(1), F.ceil((F.col("excess") + other) / (2 * APART)))
    many = F.size("delta") - common + 1
    joined = F.when(F.col("near"), F.col("best.label")).otherwise(F.col("label")).alias("joined")
    own = ["cluster", "set_key", "label", "excess", "near"]
    keyed = each.where(many > 0).select(*own, joined, F.size("delta").alias("size"), F.posexplode(F.slice("delta", F.lit(1), many.cast("int"))).alias("at", "key"))
    keyed = written(keyed.select(*own, "joined", "key", (F.col("size") - F.col("at")).alias("left")), "near-parts")
    many = keyed.groupBy("cluster", "key").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("near")).alias("far"))
    keyed = keyed.join(many.where("rows > 1 AND far > 0").select("cluster", "key"), ["cluster", "key"])
    one, two = (keyed.select(*(F.col(c).alias(f"{side}_{c}") for c in keyed.columns)) for side in "ab")
    same = (F.col("a_cluster") == F.col("b_cluster")) & (F.col("a_key") == F.col("b_key"))
    once = (F.col("b_near") | (F.col("a_set_key") < F.col("b_set_key"))) & (F.col("a_joined") != F.col("b_joined"))
    enough = 2 * APART * F.least("a_left", "b_left") >= F.col("a_excess") + F.col("b_excess")
    met = one.where("NOT a_near").join(two, same & once & enough)
    met = met.select(F.col("a_cluster").alias("cluster"), *(F.col(f"{side}_{c}") for side in "ab" for c in ("set_key", "label", "excess"))).distinct()
    for side in "ab":
        met = met.join(deltas.select("cluster", F.col("set_key").alias(f"{side}_set_key"), F.col("delta").alias(f"{side}_delta")), ["cluster", f"{side}_set_key"])
    met = met.where(2 * APART * F.size(F.array_intersect("a_delta", "b_delta")) >= F.col("a_excess") + F.col("b_excess"))
    return star.union(met.select(F.col("a_set_key").alias("a"), F.col("b_set_key").alias("b"), "a_label", "b_label"))


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike; a set is sent once for each head it is compared with."""
    total = pairs.count()
    heads = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(found.select(F.col("set_key").alias("a"), F.col("shingles").alias("a_set")), "a")
    both = join_hot(pairs.join(found.select(F.col("set_key").alias("b"), F.col("shingles").alias("b_set")), "b"), heads, ["a"], total)
    return both.where(_alike(F.size(F.array_intersect("a_set", "b_set")), F.size("a_set"), F.size("b_set"))).select("a", "b", "a_label", "b_label")


HEAD = ("set_key", "set_size", "set_sketch", "label")


def _round(active: DataFrame, found: DataFrame, lone: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs compared, links found, what goes on) of one round; all are written."""
    # Once the first heads are through, those that are linked to nothing yet lead.
    alone = (F.col("label") == F.col("set_key")) if lone else F.lit(False)
    head = F.max(F.struct(alone.alias("alone"), "weight", *HEAD)).alias("head")
    heads = active.groupBy("group").agg(head, F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    met = written(join_hot(active, heads.where("low < high").select("group", "head", "n"), ["group"], active.count()), "near-met")
    each = met.where("label <> head.label")
    near = _alike(F.least("set_size", "head.set_size"), F.col("set_size"), F.col("head.set_size"))
    pairs = each.where(near).where(_agreeing(F.col("set_sketch"), F.col("head.set_sketch")))
    pairs = pairs.select(F.col("head.set_key").alias("a"), F.col("set_key").alias("b"), F.col("head.label").alias("a_label"), F.col("label").alias("b_label"))
    pairs = written(pairs.dropDuplicates(["a", "b"]), "near-pairs")
    links = written(_verified(pairs, found), "near-links")
    return pairs, links, written(_relabelled(met.where("set_key <> head.set_key").select(active.columns), links), "near-rest")


def _relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with linked labels made one: the least label in two steps, so a head and all that is linked to it agree."""
    rows = written(rows, "near-left")
    one = links.select(F.col("a_label").alias("label"), F.col("b_label").alias("other"))
    both = written(one.union(one.select("other", "label")).distinct(), "near-labels")
    least = both.groupBy("label").agg(F.least("label", F.min("other")).alias("least"), F.count(F.lit(1)).alias("n"))
    turned = both.select(F.col("other").alias("label"), F.col("label").alias("old"))
    second = join_hot(turned, least, ["label"], both.count()).groupBy("old").agg(F.min("least").alias("new"))
    known = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(second, F.col("label") == F.col("old"), "left")
    known = known.select("label", "n", F.least("label", "new").alias("new"))
    return join_hot(rows, known, ["label"], rows.count()).withColumn("label", F.col("new")).select(rows.columns)


def near_links(docs: DataFrame, sets: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links (a, b) that connect all alike sets, the pairs compared exactly).

    ``sets`` has a row per set with ``row_key``, that of one of its rows in docs.
    """
    own = sets.select("set_key", "set_size", "set_sketch", F.col("set_key").alias("label"))
    columns = ["group", "set_key", "weight", "set_size", "set_sketch", "label"]
    active = written(_band_groups(sets).join(own, "set_key").select(columns), "near-active")
    wanted = active.select("set_key").distinct().join(sets.select("set_key", "row_key"), "set_key")
    texts = docs.select(row_key(text=text).alias("row_key"), F.col(text).alias("text")).join(wanted, "row_key").dropDuplicates(["set_key"])

    def compute(listed):
        return {"shingles": pa.array([shingle_set(t).view(np.int64) for t in listed], pa.list_(pa.int64()))}

    shingled = with_batch_columns(texts.select("set_key", "text"), ["text"], {"shingles": ArrayType(LongType())}, compute, PIECE_BYTES, ("text",))
    found = written(shingled, "near-sets")
    compared, linked = [], []
    for turn in range(ROUNDS):
        if active.isEmpty():
            break
        pairs, links, active = _round(active, found, turn > 0)
        compared.append(pairs)
        linked.append(links)
    if not active.isEmpty():
        pairs = _pairs_by_delta(_deltas(_clusters(active), found))
        compared.append(written(pairs.dropDuplicates(["a", "b"]), "near-pairs"))
        linked.append(written(_verified(compared[-1], found), "near-links"))
    none = sets.where("false").select(F.col("set_key").alias("a"), F.col("set_key").alias("b"))
    links, pairs = none, none
    for one, other in zip(linked, compared):
        links, pairs = links.union(one.select("a", "b")), pairs.union(other.select("a", "b"))
    return links, pairs


def near_copies(docs: DataFrame, sets: DataFrame, text: str = "text") -> DataFrame:
    """Links (a, b) between set keys that connect all sets with the least similarity or more."""
    return near_links(docs, sets, text)[0]
