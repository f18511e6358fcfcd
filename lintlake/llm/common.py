"""What the operators share: tables, batches in Python, tables between steps, ranks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of input that become Python values at a time, where a batch is taken in pieces.
PIECE_BYTES = 1 << 20
#: A word: what stands between blanks (code points 0x20 and 0x09 to 0x0D).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir.

    Where it is unset, a local master (tests) gets a new local folder; any other master is
    refused, since its executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def known_to_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library from where the driver has it.

    On a cluster it is installed on the executors or sent with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def _pieces(batch: pa.RecordBatch, used: Sequence[int], piece_bytes: int | None) -> Iterator[pa.RecordBatch]:
    """The batch cut into equal numbers of rows, one at least, with about ``piece_bytes`` in the columns used."""
    size = sum(batch.column(n).nbytes for n in used)
    rows = batch.num_rows if piece_bytes is None else max(1, batch.num_rows * piece_bytes // max(1, size))
    for at in range(0, batch.num_rows, max(1, rows)):
        yield batch.slice(at, rows)


def with_batch_columns(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: dict[str, DataType],
    compute: Callable[..., dict[str, pa.Array]],
    piece_bytes: int | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """df with columns computed from Arrow batches of the inputs.

    ``compute`` gets a list of Python values for each input. Columns of df with the name of
    an output, whatever their case, are replaced. With ``piece_bytes`` it gets rows of about so many bytes at
    a time, so a worker never holds a whole batch as Python values. Columns in ``drop`` do not come back.
    """
    known_to_workers(df.sparkSession)
    new = {name.lower() for name in (*outputs, *drop)}
    kept = [f.name for f in df.schema.fields if f.name.lower() not in new]
    fields = [*(df.schema[name] for name in kept), *(StructField(k, t) for k, t in outputs.items())]
    types = {name: to_arrow_type(kind) for name, kind in outputs.items()}
    places = {c: n for n, c in enumerate(df.columns)}
    lower = {c.lower(): n for c, n in places.items()}
    used = [places.get(c, lower.get(c.lower())) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for batch in batches for piece in _pieces(batch, used, piece_bytes)):
            found = compute(*(batch.column(n).to_pylist() for n in used))
            arrays = [batch.column(places[c]) for c in kept]
            arrays += [pa.array(found[c], type=types[c]) if not isinstance(found[c], pa.Array) else found[c].cast(types[c]) for c in outputs]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *outputs])

    return df.mapInArrow(run, StructType(fields))


def bucket_of(*columns: Column | str, buckets: int | Column, seed: int = 0) -> Column:
    """A bucket from the hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(buckets) if isinstance(buckets, int) else buckets)


def ranked(
    df: DataFrame, within: str, bucket: str, order: Sequence[Column | str], name: str = "rank"
) -> DataFrame:
    """Gapless numbers from 0 inside every ``within``, by bucket and then by order.

    No value of ``within`` is sorted in one task: rows are numbered inside their bucket, and
    the buckets' row counts, added up before it, are joined to them. ``df`` should be a
    written table, for it is read twice; ``bucket`` should hold a few thousand rows each.
    """
    counts = df.groupBy(within, bucket).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(within, bucket, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(within, bucket).orderBy(*order)
    numbered = df.withColumn("_own", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, [within, bucket])
    return joined.withColumn(name, F.col("_start") + F.col("_own")).drop("_own", "_start")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of a row by its id and the hash of its text; only repeated rows share it."""
    return F.concat_ws("/", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.xxhash64(text).cast("string"))


#: The share of all rows that one join key may bring to one task.
HOT_SHARE = 1 / 1024


def join_hot(rows: DataFrame, one: DataFrame, keys: Sequence[str], total: int, share: float = HOT_SHARE) -> DataFrame:
    """The inner join of rows with ``one``, which has a row per key and in ``n`` the key's number of rows.

    Keys with more than their share of all (``total``) rows are dealt over several join keys. There
    are at most 1 / share such keys, so their list may be broadcast, whatever the tables' size.
    """
    fair = max(1, int(total * share))
    salts = F.ceil(F.col("n") / fair).cast("int")
    hot = one.where(F.col("n") > fair).select(*keys, salts.alias("__salts"))
    dealt = rows.join(F.broadcast(hot), list(keys), "left")
    dealt = dealt.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    last = F.when(F.col("n") > fair, salts).otherwise(1) - 1
    each = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), last))).drop("n")
    return dealt.join(each, [*keys, "__salt"]).drop("__salt")
