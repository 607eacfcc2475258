"""What the operators share: the shared scratch folder, and taking rows out of a table."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout.llm.textbytes import has_bit

#: Bytes of text that one numpy step works on; a longer text is still taken whole.
CHUNK_BYTES = 1 << 18
#: Bits of a filter of hashes: half a MB on the driver and the executors, whatever it filters.
FILTER_BITS = 1 << 22

#: Folders of local sessions that set none, by application.
_temporary: dict[str, str] = {}
#: The paths landed since each released() that this thread is in.
_helpers = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _temporary.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="llm-")
        _temporary[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def landed(df: DataFrame) -> DataFrame:
    """df, written to the scratch folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    if opened := getattr(_helpers, "opened", None):
        opened[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def released(build: Callable[[], DataFrame]) -> DataFrame:
    """What build() returns, landed; the tables that were landed on the way are deleted."""
    if not hasattr(_helpers, "opened"):
        _helpers.opened = []
    _helpers.opened.append([])
    try:
        out = landed(build())
    finally:
        paths = _helpers.opened.pop()
    kept = paths.pop()
    delete(out.sparkSession, paths)
    if _helpers.opened:
        _helpers.opened[-1].append(kept)
    return out


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what landed() wrote in this session; call it when the results are saved."""
    delete(spark, [f"{scratch_dir(spark)}/llm/{spark.sparkContext.applicationId}"])


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scratch_path(spark: SparkSession) -> str:
    """A new path in the scratch folder, for this session."""
    return f"{scratch_dir(spark)}/llm/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def text_of(name: str) -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_bucket(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers outlive their tasks, and others need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most limit bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
        give_back()


def filter_bits(hashes: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """A bit for each of the column `hash`; combined on the executors, of fixed size."""
    place = F.col("hash").bitwiseAND(F.lit(size - 1))
    rows = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def passes_filter(hashes: DataFrame, key: Column) -> Column:
    """Whether a key may be among the column `hash`: true for all that are, and for few others while those are few."""
    bits = hashes.sparkSession.sparkContext.broadcast(filter_bits(hashes))

    def passes(keys: pa.Array) -> pa.Array:
        return pa.array(has_bit(bits.value, keys.to_numpy().view(np.uint64)))

    return F.arrow_udf(passes, "boolean")(key)


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """docs less the rows whose keys are in gone; of rows whose keys are in repeated one stays.

    keys: expressions over docs, by their column names in gone and repeated, the cheapest
    first; null equals null. A filter of fixed size on the first key lets most rows that stay
    pass where they are read; only the others are joined, and their texts shuffled."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    names = list(keys)

    free = {k: free_name(docs, f"other_{k}") for k in names}

    def on(table: DataFrame) -> tuple[DataFrame, Column]:
        other = table.select(*[F.col(k).alias(free[k]) for k in names])
        same = F.lit(True)
        for k, e in keys.items():
            same = same & e.eqNullSafe(F.col(free[k]))
        return other, same

    some = not repeated.isEmpty()
    either = landed(gone.select(*names).unionAll(repeated.select(*names)).distinct())
    touched = passes_filter(either.select(F.xxhash64(names[0]).alias("hash")), F.xxhash64(keys[names[0]]))
    near = docs.where(touched)
    out, same = on(either)
    left = docs.where(~touched).unionByName(near.join(out, same, "left_anti"))
    if not some:
        return left
    twice, same = on(repeated)
    once = near.join(twice, same).dropDuplicates([free[k] for k in names])
    return left.unionByName(once.select(*cols))
