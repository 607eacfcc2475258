"""CSV records whose quoted cells go over several lines, cut from a file in parallel.

Whether a line break ends a record depends on all quotes before it. So each block of a file
is walked once for both cases, that it begins outside and that it begins inside a
quoted cell: that gives a function of two states. The functions of the blocks are chained
by a window over one row per block, which tells the state each block really begins in.
A second walk then cuts the lines into records; only a record that goes on into
another block is put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscout.operators.common import join_small

#: What is left of a quoted cell, with what follows its closing quote up to the next cell.
REST_OF_QUOTED = re.compile(rb'[^"]*+(?:""[^"]*+)*+"[^,]*+(,?)')
#: Any number of cells that end on the line.
WHOLE_CELLS = re.compile(rb'(?:(?!")[^,]*+,|"[^"]*+(?:""[^"]*+)*+"[^,]*+,)*+')
#: The last cell of a record; anything else is a quoted cell that goes on.
LAST_CELL = re.compile(rb'(?!")[^,]*+\Z|"[^"]*+(?:""[^"]*+)*+"[^,]*+\Z')
BLOCK = "file string, block long"


def state_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line; a quote opens a cell only as its first sign."""
    at = 0
    if inside:
        rest = REST_OF_QUOTED.match(line)
        if rest is None:
            return True
        if not rest[1]:
            return False
        at = rest.end()
    at = WHOLE_CELLS.match(line, at).end()
    return LAST_CELL.match(line, at) is None


def file_lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(file, block, line): the bytes between line feeds, blocks being the parts that Spark deals to tasks."""
    lines = spark.read.option("lineSep", "\n").text(list(files))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.col("value").cast("binary").alias("line"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batches cut where the block changes, each with the values of its other columns."""
    for b in batches:
        names = [n for n in b.schema.names if n != "line"]
        files, blocks = b.column("file"), b.column("block").to_pylist()
        start = 0
        for i in range(1, b.num_rows + 1):
            if i == b.num_rows or blocks[i] != blocks[start] or files[i] != files[start]:
                yield tuple(b.column(n)[start].as_py() for n in names), b.slice(start, i - start)
                start = i


def block_functions(lines: DataFrame) -> DataFrame:
    """One row per block: the state it ends in, and whether a record begins in it, if it begins outside (0) or inside (1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states, begun = None, [False, True], [False, False]
        rows: list[tuple] = []
        for at, part in _stretches(batches):
            if at != now:
                if now is not None:
                    rows.append((*now, *map(int, states), *begun))
                now, states, begun = at, [False, True], [False, False]
            column = part.column("line")
            marked = pc.indices_nonzero(pc.match_substring(column, b'"')).to_pylist()
            for i in (*marked, None):
                # Up to a line with a quote the states stay; a line that begins outside begins a record.
                if i is None and marked and marked[-1] == part.num_rows - 1:
                    break
                begun = [b or not s for b, s in zip(begun, states)]
                if i is not None:
                    line = column[i].as_py()
                    states = [state_after(line, s) for s in states]
            if len(rows) >= 1000:
                yield _table(rows)
                rows = []
        if now is not None:
            rows.append((*now, *map(int, states), *begun))
        if rows:
            yield _table(rows)

    return lines.mapInArrow(run, f"{BLOCK}, to0 int, to1 int, begun0 boolean, begun1 boolean")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
    names = ["file", "block", "to0", "to1", "begun0", "begun1"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def block_starts(functions: DataFrame) -> DataFrame:
    """(file, block, inside, owner): the state each block begins in, and the block where the record that is open there began.

    A block that ends in one state whatever it began in sets the state; one that ends in the other
    state than it began in changes it over. So the state is that of the last setting block and the number of changes since."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    change = ((F.col("to0") == 1) & (F.col("to1") == 0)).cast("long")
    counted = functions.withColumn("changes", F.sum(change).over(upto))
    set_here = F.when(F.col("to0") == F.col("to1"), F.struct(F.col("to0").alias("state"), F.col("changes").alias("at")))
    last = F.last(set_here, ignorenulls=True).over(before)
    seen = counted.select("*", last.alias("set"), F.coalesce(F.lag("changes").over(upto), F.lit(0)).alias("so_far"))
    state = (F.coalesce("set.state", F.lit(0)) + F.col("so_far") - F.coalesce("set.at", F.lit(0))) % 2 == 1
    placed = seen.select("file", "block", state.alias("inside"), F.when(state, F.col("begun1")).otherwise(F.col("begun0")).alias("begun"))
    return placed.select("file", "block", "inside", F.last(F.when(F.col("begun"), F.col("block")), ignorenulls=True).over(before).alias("owner"))


def record_parts(lines: DataFrame) -> DataFrame:
    """(file, owner, block, whole, first, record): records that lie in one block, and the parts of the others.

    lines: file, block, line, inside, owner. A record belongs to the block where it begins; first marks the
    first of a file. Blank lines between records are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, held, owner, torn, head = None, False, [], None, False, False
        out: list[tuple] = []

        def close(whole: bool) -> bool:
            """Give out the lines held; blank ones count for nothing."""
            record = b"\n".join(held)
            if whole and not (record := record.removesuffix(b"\r")):
                return False
            out.append((now[0], owner, now[1], whole, head and owner == 0, record))
            return True

        for at, part in _stretches(batches):
            if at != now:
                if held:
                    close(not inside and not torn)
                now, inside, held, torn, head = at, at[2], [], at[2], at[1] == 0
                owner = at[3] if inside else at[1]
            quoted = pc.match_substring(part.column("line"), b'"').to_pylist()
            for line, marked in zip(part.column("line").to_pylist(), quoted):
                if held and not inside:
                    head = not close(not torn) and head
                    held, owner, torn = [], at[1], False
                held.append(line)
                if marked:
                    inside = state_after(line, inside)
                if len(out) >= 4000:
                    yield _parts(out)
                    out = []
        if held:
            close(not inside and not torn)
        if out:
            yield _parts(out)

    return lines.select("file", "block", "inside", "owner", "line").mapInArrow(
        run, "file string, owner long, block long, whole boolean, first boolean, record binary")


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["file", "owner", "block", "whole", "first", "record"])


def csv_records(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(file, first, record) of all records of the files, as bytes without the line end; first: the file's first record.

    Every task reads its part of a file, however long the quoted cells are. A cell
    that is never closed takes the rest of its file, as it does when the file is read by one task."""
    lines = file_lines(spark, files)
    starts = block_starts(block_functions(lines))
    parts = record_parts(join_small(lines, starts, ["file", "block"], starts.count()))
    whole = parts.where("whole").select("file", "first", "record")
    torn = parts.where(~F.col("whole")).groupBy("file", "owner").agg(
        F.max("first").alias("first"),
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"))
    line_end = F.lit("\n").cast("binary")
    joined = F.aggregate("parts", F.lit(None).cast("binary"), lambda all_, p: F.when(
        all_.isNull(), p["record"]).otherwise(F.concat(all_, line_end, p["record"])))
    ended = F.expr("CASE WHEN substring(_r, -1, 1) = X'0D' THEN substring(_r, 1, octet_length(_r) - 1) ELSE _r END")
    return whole.unionAll(torn.withColumn("_r", joined).select("file", "first", ended.alias("record")))
