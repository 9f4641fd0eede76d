"""What the training-data operators share: table access, shared scratch tables, batch slicing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds at once in its own arrays.
SLICE_BYTES = 4 << 20

#: The separators of every word contract: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds Arrow batches by bytes: rows may hold long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, after which freed memory goes back to the system: Python workers stay from task to task, and each would
    keep the most that any of its tasks has held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's, for numpy's arrays
            trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is named (local mode)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.decidra.scratch", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="decidra-")
        spark.conf.set("spark.decidra.scratch", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lost executor costs no earlier stage.

    The table goes at the end of the session (or by drop_scratch)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/decidra/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def drop_older(name: str, keep: int = 1) -> None:
    """Deletes the tables cut under this name but the last `keep`: for rounds that each read the table before only."""
    own = [x for x in _scratch if x[1].rpartition("/")[2].rpartition("-")[0] == name]
    for x in own[: len(own) - keep]:
        _delete(*x)
        _scratch.remove(x)


def drop_scratch() -> None:
    """Deletes the scratch tables of this process; results that read them must be written by then."""
    while _scratch:
        try:
            _delete(*_scratch.pop())
        except Exception:  # noqa: BLE001 - the session has ended: nothing is left to ask
            return


atexit.register(drop_scratch)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in runs of rows with about `most` bytes of `column`, a longer text alone."""
    for batch in batches:
        sizes = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)


def plain_text(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def running(df: DataFrame, groups: list[str], order: F.Column, value: F.Column | None = None, name: str = "pos", per_bucket: int = 5000, carry: DataFrame | None = None) -> DataFrame:
    """Adds `name`: the sum of `value` over the group's rows before this one in `order` (by default their number).

    groups: columns without nulls. order: a bigint spread evenly over 0 to 2^63. A group's rows are cut into value ranges
    of `order` (its top bits), so a group that holds a third of all rows is worked by many tasks: values are summed per
    (group, range) with map-side combining, ranges are summed in order, and only a range's own rows are sorted together.
    carry: columns by group that are joined on the way. df is read twice: give it a cheap or a written one."""
    bits = max(0, (max(1, df.count() // per_bucket) - 1).bit_length())
    keyed = df.withColumn("_order", order).withColumn("_range", F.shiftright(F.col("_order"), 63 - bits) if bits else F.lit(0).cast("long"))
    keyed = keyed.withColumn("_value", F.lit(1).cast("long") if value is None else value)
    sums = keyed.groupBy(*groups, "_range").agg(F.sum("_value").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if carry is not None:
        sums = sums.join(carry, groups)
    within = Window.partitionBy(*groups, "_range").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_row", F.coalesce(F.sum("_value").over(within), F.lit(0))).join(sums, [*groups, "_range"])
    return placed.withColumn(name, F.col("_before") + F.col("_row")).drop("_order", "_range", "_value", "_row", "_before")


def spread(*columns: str, seed: int = 0) -> F.Column:
    """A hash of these columns over 0 to 2^63, for running()."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1)
