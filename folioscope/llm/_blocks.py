"""Groups whose members are compared with one another, in blocks, so that no task gathers a whole large group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, keys: list[str], by: str, block: int) -> DataFrame:
    """Give each row of a group, whose `size` it carries, to the pairs of blocks that hold its block.

    A group of at most `block` rows is one block; a larger one is cut into several by a hash of `by`.  Adds side (the
    row's block) and p1 <= p2 (the pair).  A row goes to as many pairs as its group has blocks.
    """
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    rows = rows.withColumn("side", F.pmod(F.xxhash64(F.lit(11), by), blocks).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns({"p1": F.least("side", "o"), "p2": F.greatest("side", "o")}).drop("o", "size")


def grouped(rows: DataFrame, keys: list[str], compare: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Call `compare` with the rows of each group; groups of one row are passed over.  One group is held at a time."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                here = tuple(c[lo] for c in cols)
                if held and here != last:
                    yield from flush(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = here
        if held:
            yield from flush(held)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in held) > 1:
            out = compare(pa.Table.from_batches(held).combine_chunks())
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return rows.mapInArrow(run, schema)
