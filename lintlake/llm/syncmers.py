"""Document fingerprints from closed syncmers.

A k-mer (k code points in a row) is an anchor if the least of the hashes of its inner s-mers
stands at its first or last place. Whether it is one depends on the k-mer alone, so an edit
elsewhere in the text neither adds nor removes anchors, and equal passages have the same
anchors at the same distances. The first k-mer and the first s-mer of a text are anchors too,
for short texts; one shorter than k is an anchor as a whole.

The fingerprint holds anchors with their places, in order of place: a distinct hash at its first
place, if it is below a fixed bound (one in ``SHARE``) or among the text's least ``LEAST`` hashes. It grows with the text, so
a passage that long texts have in common leaves its share of anchors in both.

Likeness compares two fingerprints up to the lower of their bounds. It counts the anchors that are in both, and the links
that are in both: an anchor, the next one and the distance between them. What is counted is divided by all
anchors and links of the two. So an anchor that matches in order and distance counts more than one met elsewhere.

Null texts count as empty, with the empty fingerprint; two of these are alike (1), an empty
and another one are not (0). Repeated rows and ids are rows of their own. Other columns stay
(``with_anchors``, ``with_fingerprint``); one with the name of an output is replaced. Empty
tables give empty tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .bpe_rounds import codes_of
from .common import known_to_workers, with_batch_columns, written

K, S = 12, 4
#: Hashes below 2**32 / SHARE are kept, and the least LEAST of a text.
SHARE, LEAST = 8, 64
_BELOW = 2**32 // SHARE
#: Sizes of texts are counted in units of so many characters; a bucket of texts has about BUCKET_UNITS.
UNIT, BUCKET_UNITS = 1024, 8192
_LOW = -(2**63)
#: Code points that are worked on at once; a longer text is taken alone.
GROUP_CODES = 1_000_000


def _mixed(values: np.ndarray) -> np.ndarray:
    out = values.copy()
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x7FB5D329728EA185)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x81DADEF4BC2DD44D)
    out ^= out >> np.uint64(33)
    return out


def anchors_of(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in the joined texts, and their 32-bit hashes."""
    lengths = np.diff(bounds)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        padded = np.concatenate([codes.astype(np.uint64) + np.uint64(1), np.zeros(K, np.uint64)])
        n = len(codes)
        two = padded[:-1] * base + padded[1:]
        four = two[:-2] * base**np.uint64(2) + two[2:]
        eight = four[:-4] * base**np.uint64(4) + four[4:]
        whole = _mixed(eight[:n] * base**np.uint64(4) + four[8 : 8 + n])
        inner = _mixed(four[: n + K - S])
    width = K - S + 1
    least = inner
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    least = least[:n]
    chosen = (least == inner[:n]) | (least == inner[width - 1 : width - 1 + n])
    text = np.repeat(np.arange(len(lengths)), lengths)
    chosen &= np.arange(n) + K <= bounds[1:][text]
    starts = bounds[:-1][lengths > 0]
    chosen[starts] = True
    places = np.flatnonzero(chosen)
    hashes = whole[places]
    for t in np.flatnonzero((lengths > 0) & (lengths < K)):
        at = np.searchsorted(places, bounds[t])
        own = codes[bounds[t] : bounds[t + 1]].astype("<u4").tobytes()
        hashes[at] = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "big")
    heads = bounds[:-1][lengths >= S]
    at = np.searchsorted(places, heads)
    places, hashes = np.insert(places, at, heads), np.insert(hashes, at, inner[heads])
    return places, (hashes >> np.uint64(32)).astype(np.uint32)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of every text: rows of a place and a hash, in order of place."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= GROUP_CODES):
            size += len(texts[to])
            to += 1
        codes, bounds = codes_of(texts[at:to])
        places, hashes = anchors_of(codes, bounds)
        text = np.repeat(np.arange(to - at), np.diff(np.searchsorted(places, bounds)))
        keys = text.astype(np.uint64) << np.uint64(32) | hashes
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        order, text = order[first], text[order[first]]
        rank = np.arange(len(order)) - np.searchsorted(text, text)
        kept = np.sort(order[(rank < LEAST) | (hashes[order] < _BELOW)])
        rows = np.column_stack([places[kept] - bounds[np.searchsorted(bounds, places[kept], "right") - 1], hashes[kept]]).astype(np.uint32)
        cuts = np.searchsorted(places[kept], bounds)
        out += [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        at = to
    return out


def _bound(sketch: np.ndarray) -> int:
    """The largest hash up to which the fingerprint has all anchors of its text."""
    return 2**32 - 1 if len(sketch) < LEAST else max(_BELOW - 1, int(sketch[:, 1].max()))


def _links(sketch: np.ndarray) -> np.ndarray:
    wide = sketch.astype(np.uint64)
    with np.errstate(over="ignore"):
        gap = (wide[1:, 0] - wide[:-1, 0]) * np.uint64(0x9E3779B97F4A7C15)
        return np.unique(_mixed((wide[:-1, 1] << np.uint64(32) | wide[1:, 1]) ^ gap))


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    if not len(left) or not len(right):
        return 1.0 if len(left) == len(right) else 0.0
    bound = min(_bound(left), _bound(right))
    left, right = left[left[:, 1] <= bound], right[right[:, 1] <= bound]
    common, total = 0, 0
    for a, b in ((left[:, 1], right[:, 1]), (_links(left), _links(right))):
        both = len(np.intersect1d(a, b, assume_unique=True))
        common, total = common + both, total + len(a) + len(b) - both
    return common / total if total else 0.0


def as_text(sketch: np.ndarray) -> str:
    """16 hex digits for each anchor: its place and its hash."""
    return sketch.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32).reshape(-1, 2)


def with_anchors(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``anchor_places`` (from 0) and ``anchor_hashes`` of each text."""

    def compute(texts):
        found = [anchors_of(*codes_of([t or ""])) for t in texts]
        return {"anchor_places": [p.tolist() for p, _ in found], "anchor_hashes": [h.tolist() for _, h in found]}

    kind = ArrayType(LongType())
    return with_batch_columns(docs, [text], {"anchor_places": kind, "anchor_hashes": kind}, compute)


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text."""

    def compute(texts):
        return {name: pa.array(map(as_text, sketches([t or "" for t in texts])), pa.string())}

    return with_batch_columns(docs, [text], {name: StringType()}, compute)


def _sizes(docs: DataFrame, partitions: int | None) -> tuple[DataFrame, int, int]:
    """((key, units) of every doc_id, the number of buckets, the units of a fair bucket)."""
    units = F.floor(F.coalesce(F.length("text"), F.lit(0)) / UNIT) + 1
    sized = docs.select(F.coalesce("doc_id", F.lit(_LOW)).alias("key"), units.alias("units"))
    by_id = written(sized.groupBy("key").agg(F.sum("units").alias("units")), "syncmer-sizes")
    total = by_id.agg(F.sum("units")).first()[0] or 0
    buckets = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_UNITS))
    return by_id, buckets, max(1, -(-total // buckets))


def _bounds(by_id: DataFrame, buckets: int, fair: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Where buckets begin, as ids and as hashes inside them, in order; and the ids that are split by hash.

    Ids with more than a fair bucket of text, fewer than there are buckets, are split; so all three
    lists are as long as the buckets are many.
    """
    hot = {r["key"]: -(-r["units"] // fair) for r in by_id.where(F.col("units") > fair).collect()}
    bounds = {(key, _LOW + 2**64 * n // slices) for key, slices in hot.items() for n in range(slices)}
    steps = [n / buckets for n in range(1, buckets)]
    if steps:
        each = by_id.select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.least("units", F.lit(fair)))))
        found = each.agg(F.percentile_approx("key", steps, 100 * buckets)).first()[0] or []
        bounds |= {(int(key), _LOW) for key in found}
    listed = sorted(bounds)
    return np.array([b[0] for b in listed], np.int64), np.array([b[1] for b in listed], np.int64), sorted(hot)


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """docs(doc_id, text) in partitions sorted by doc_id (nulls first), with ``bucket`` and ``ahead``.

    Every bucket ends with a copy, marked ``ahead``, of the row that follows its last one in
    the order of all rows (after the last: the first). Texts are shuffled once. Buckets have about the
    same number of characters, and there are as many as that asks for. Rows of an id that has more
    are in order of their texts' hashes and dealt over several buckets; only rows that are equal in id and
    text are never parted.
    """
    known_to_workers(docs.sparkSession)
    by_id, buckets, fair = _sizes(docs, partitions)
    bound_ids, bound_hashes, hot = _bounds(by_id, buckets, fair)

    def numbers_of(keys: pa.Array, hashes: pa.Array) -> np.ndarray:
        key, hashed = keys.to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(bound_ids, key, "left"), np.searchsorted(bound_ids, key, "right")
        for n in np.flatnonzero(high - low > 1):
            high[n] = low[n] + np.searchsorted(bound_hashes[low[n] : high[n]], hashed[n], "right")
        return high

    @F.arrow_udf("long")
    def bucket(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(numbers_of(keys, hashes), pa.int64())

    hashed = F.when(F.col("key").isin(hot), F.xxhash64("text")).otherwise(F.lit(_LOW)) if hot else F.lit(_LOW)
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LOW)).cast("long").alias("key")).withColumn("hash", hashed)
    firsts = (
        keyed.select("key", "hash", bucket("key", "hash").alias("bucket"))
        .groupBy("bucket").agg(F.min(F.struct("key", "hash")).alias("first")).orderBy("bucket").collect()  # a row per bucket
    )
    filled = [r["bucket"] for r in firsts]
    before = {r["bucket"]: (tuple(r["first"]), filled[k - 1]) for k, r in enumerate(firsts)}

    @F.arrow_udf("array<long>")
    def targets(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        own = numbers_of(keys, hashes).tolist()
        rows = zip(own, keys.to_pylist(), hashes.to_pylist())
        return pa.array([[b, before[b][1]] if before[b][0] == (key, h) else [b] for b, key, h in rows], pa.list_(pa.int64()))

    placed = keyed.withColumn("to", targets("key", "hash")).select("doc_id", "text", "hash", F.posexplode("to").alias("ahead", "bucket"))
    sorted_rows = placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "ahead", "doc_id", "hash", "text")
    return sorted_rows.select("doc_id", "text", "ahead", "bucket")


def compare_with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of the same text with its second half replaced.

    The last half of the code points gives way to as many from the start of the next
    document. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited (likeness to the edited text) and near_next (to the next document).
    """
    fields = [("doc_id", docs.schema["doc_id"].dataType), ("n_chars", LongType()), ("edited_sha256", StringType())]
    fields += [("fingerprint", StringType()), ("edited_fingerprint", StringType())]
    schema = StructType([StructField(n, t) for n, t in fields]).add("near_edited", "double").add("near_next", "double")

    def run(batches):
        carried: list[tuple] = []
        for batch in batches:
            rows = batch.to_pydict()
            listed = carried + list(zip(rows["doc_id"], (t or "" for t in rows["text"]), rows["bucket"], rows["ahead"]))
            if not listed:
                continue
            carried = listed[-1:]
            yield from compared(listed, batch.schema.field("doc_id").type)

    def compared(listed, id_type):
        at = 0
        while at < len(listed) - 1:
            to, size = at, 0
            while to < len(listed) - 1 and (to == at or size < GROUP_CODES):
                size += len(listed[to][1])
                to += 1
            part = listed[at : to + 1]
            own = sketches([r[1] for r in part])
            pairs = [k for k in range(len(part) - 1) if not part[k][3]]
            edited = []
            for k in pairs:
                text, half = part[k][1], len(part[k][1]) // 2
                edited.append(text[: len(text) - half] + part[k + 1][1][:half])
            other = sketches(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part[k][0] for k in pairs], id_type),
                    pa.array([len(part[k][1]) for k in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([as_text(own[k]) for k in pairs], pa.string()),
                    pa.array([as_text(x) for x in other], pa.string()),
                    pa.array([likeness(own[k], x) for k, x in zip(pairs, other)], pa.float64()),
                    pa.array([likeness(own[k], own[k + 1]) for k in pairs], pa.float64()),
                ],
                names=schema.names,
            )
            at = to

    return with_next(docs, partitions).mapInArrow(run, schema)
