"""Shards of equal row counts by balanced label propagation.

Documents with a common text are linked, through a node for the text rather than in pairs, so
a group of any size costs a row per document. Every document starts in a shard that its hash
gives. In a round each group of links without a label asks for the shard where most of its documents
are, of those whose quota has room left for the whole group (ties are broken by hash; if none has
room, for another one that has). Labels are granted, large groups first and groups that do not fit being
passed over, and count against the shard's quota of rows. As a label is paid for with the whole
group, full shards exchange rows freely: once all are granted no shard holds more labelled rows than its
quota, wherever the rows were before. Rounds go on until none is granted; then documents
move to their group's shard. Groups larger than half a quota are first split by hash into parts that fit, each
with links of its own. At last shards above their exact size hand documents over to those
below, those without a label first.

The law held is ``rows``: sizes differ by one row at most.

Only ids, sizes and hashes are kept after texts have been read once. Groups are counted by
shard before they are joined; the driver sees a row per shard, and quotas are granted on
a table of shards times size classes, whose size does not depend on the input; texts
of more than half a quota, at most two a shard, are joined by broadcast; rows are numbered
inside small hash buckets.

Null texts are linked like equal texts and have 16 bytes. Repeated rows and ids are rows of
their own. Columns other than id and text are not read. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, ranked, written

#: Rows in a bucket that is numbered in one go, about.
BUCKET_ROWS = 20_000
#: Hash classes into which equally large groups are divided when labels are granted.
CLASSES = 64


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and two hashes that name the text."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(value) + 16).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.xxhash64(value).alias("text_key"),
        F.xxhash64(F.lit(1), value).alias("text_key2"),
    )


def _wishes(groups: DataFrame, free: list[int], turn: int) -> DataFrame:
    """groups (link, all, places) with the shard wanted and the class of the request.

    A group has at most a row per shard in ``places``; without a shard that has room it is left out.
    """
    room = F.array(*(F.lit(n).cast("long") for n in free))

    def fits(shard):
        return F.get(room, shard) >= F.col("all")

    here = F.array_max(F.filter("places", lambda x: fits(x["shard"])))["shard"]
    anywhere = F.filter(F.sequence(F.lit(0), F.lit(len(free) - 1)), fits)
    elsewhere = F.get(anywhere, F.pmod(F.xxhash64("link", F.lit(turn)), F.size(anywhere)).cast("int"))
    large_first = F.lit(64 * CLASSES) - F.floor(F.log2("all")).cast("int") * CLASSES
    return (
        groups.withColumn("wanted", F.coalesce(here, F.when(F.size(anywhere) > 0, elsewhere)))
        .where("wanted IS NOT NULL")
        .withColumn("class", large_first + bucket_of("link", buckets=CLASSES, seed=turn).cast("int"))
    )


def _granted(wishes: DataFrame, free: list[int]) -> DataFrame:
    """(wanted, class) of the classes that fit into the room of the wanted shard, large ones first."""
    demand = wishes.groupBy("wanted", "class").agg(F.sum("all").alias("rows"))
    lists = demand.groupBy("wanted").agg(F.sort_array(F.collect_list(F.struct("class", "rows"))).alias("classes"))
    lists = lists.withColumn("room", F.get(F.array(*(F.lit(n).cast("long") for n in free)), F.col("wanted")))
    return lists.select("wanted", F.explode(F.expr(
        "aggregate(classes, named_struct('room', room, 'taken', CAST(array() AS ARRAY<INT>)), (acc, c) -> "
        "if(c.rows <= acc.room, named_struct('room', acc.room - c.rows, 'taken', array_append(acc.taken, c.class)), acc), "
        "acc -> acc.taken)"
    )).alias("class"))


def propagate(linked: DataFrame, shards: int, quota: int) -> DataFrame:
    """(link, label): the shard of every group that found one under the quota."""
    here = linked.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct("n", F.xxhash64("link", "shard").alias("tie"), "shard")
    groups = written(here.groupBy("link").agg(F.sum("n").alias("all"), F.collect_list(place).alias("places")), "shard-groups")
    free, turn = [quota] * shards, 0
    labels = groups.selectExpr("link", "CAST(NULL AS INT) AS label").where("false")
    while True:
        wishes = _wishes(groups, free, turn)
        granted = _granted(wishes, free).withColumn("label", F.col("wanted"))
        answered = written(wishes.join(granted, ["wanted", "class"], "left").drop("wanted", "class"), "shard-labels")
        taken = answered.where("label IS NOT NULL").groupBy("label").agg(F.sum("all").alias("rows")).collect()  # a row per shard
        if not taken:
            return labels
        for r in taken:
            free[r.label] -= r.rows
        labels = labels.unionByName(answered.where("label IS NOT NULL").select("link", "label"))
        groups, turn = answered.where("label IS NULL").drop("label"), turn + 1


def _level(placed: DataFrame, shards: int, rows: int) -> DataFrame:
    """placed with exact sizes: surplus rows, unlinked ones first, go where rows are missing."""
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
    # The larger shards get the odd rows, so that fewest move.
    by_size = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))
    exact = {s: rows // shards + (k < rows % shards) for k, s in enumerate(by_size)}
    over = {s: max(0, counts.get(s, 0) - exact[s]) for s in range(shards)}
    if not any(over.values()):
        return placed
    missing = [(s, exact[s] - counts.get(s, 0)) for s in range(shards) if exact[s] > counts.get(s, 0)]
    surplus = F.element_at(F.array(*(F.lit(over[s]) for s in range(shards))), F.col("shard") + 1)
    # Numbered from the unlinked ones on; the first ``surplus`` of a shard leave it.
    numbered = ranked(placed.withColumn("part", F.when(F.col("link").isNull(), F.col("bucket")).otherwise(F.col("bucket") + F.lit(1 << 40))), "shard", "part", ["row_key", "doc_id", "size"], "place")
    starts, total = {}, 0
    for s in range(shards):
        starts[s], total = total, total + over[s]
    turn = F.col("place") + F.element_at(F.array(*(F.lit(starts[s]) for s in range(shards))), F.col("shard") + 1)
    to, upto = F.lit(missing[-1][0]), 0
    ends = []
    for s, n in missing:
        upto += n
        ends.append((s, upto))
    for s, end in reversed(ends[:-1]):
        to = F.when(turn < end, s).otherwise(to)
    return numbered.withColumn("shard", F.when(F.col("place") < surplus, to).otherwise(F.col("shard"))).drop("part", "place")


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    ``slot`` numbers the rows of a shard from 0 without gaps. ``grown_shard`` is null: under
    the law ``rows`` a further shard takes from all.
    """
    base = written(measured(docs, text), "shard-documents")
    rows = base.count()
    buckets = max(1, -(-rows // shards // BUCKET_ROWS))
    quota = rows // shards
    base = base.withColumns(
        {
            "row_key": F.xxhash64("doc_id", "text_key"),
            "shard": bucket_of("doc_id", "text_key", buckets=shards, seed=7).cast("int"),
            "bucket": bucket_of("doc_id", "text_key", buckets=buckets, seed=11),
        }
    )
    part_rows = max(1, quota // 2)
    groups = base.groupBy("text_key", "text_key2", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select(
        *(F.col(c).alias(f"g_{c}") for c in ("text_key", "text_key2", "size")), F.ceil(F.col("n") / part_rows).cast("long").alias("parts")
    )
    hot, others = F.broadcast(groups.where("parts > 1")), groups.where("parts = 1")  # hot: at most two a shard
    same = F.lit(True)
    for c in ("text_key", "text_key2", "size"):
        same &= F.col(c) == F.col(f"g_{c}")
    matched = base.join(hot, same).unionByName(base.join(hot, same, "left_anti").join(others, same, "left"))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("parts")))
    link = F.when(F.col("parts").isNotNull(), F.concat_ws("/", "text_key", "text_key2", "size", part))
    marked = written(
        matched.withColumn("link", link).select(
            "doc_id", "size", "text_crc32", "row_key", "shard", "bucket", "link"
        ),
        "shard-links",
    )
    linked = marked.where("link IS NOT NULL")
    moved = linked.join(propagate(linked, shards, quota), "link", "left").withColumns(
        {"shard": F.coalesce("label", "shard"), "link": F.when(F.col("label").isNotNull(), F.col("link"))}
    )
    placed = written(moved.select(marked.columns).unionByName(marked.where("link IS NULL")), "shard-placed")
    level = written(_level(placed, shards, rows), "shard-level")
    slots = ranked(level, "shard", "bucket", ["row_key", "doc_id", "size"], "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
