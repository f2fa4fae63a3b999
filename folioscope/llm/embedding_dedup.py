"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm._blocks import dealt, grouped
from folioscope.llm._common import NO_ID, beside, components, table

COSINE = 0.98
#: Hash tables, rotations that make a table's cell, and cells of each table that a vector is looked for in.
TABLES, PARTS, PROBES = 8, 2, 3
#: Vectors of a bucket that meet in one task, from each of two blocks.
BLOCK = 1024


@lru_cache(maxsize=4)
def signs(dim: int) -> np.ndarray:
    """Random signs of the rotations of vectors of `dim` components: (table, part, round, component)."""
    return np.random.Generator(np.random.PCG64(dim)).integers(0, 2, (TABLES, PARTS, 3, dim), dtype=np.int8) * 2 - 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows whose length is a power of two, unscaled."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def cells(x: np.ndarray) -> np.ndarray:
    """Cells of unit vectors: (row, table, probe), the nearest cell first.

    A pseudo-random rotation is three rounds of sign flips and Hadamard transform; the vertex of the cross-polytope
    nearest to the rotated vector is its greatest coordinate by size, with its sign.  A cell is PARTS vertices.  The
    further probes take the next best vertex where the change costs least.
    """
    n, d = x.shape
    dim = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, dim - d)))
    out = np.zeros((n, TABLES, PROBES), dtype=np.int64)
    for t in range(TABLES):
        first, second, loss = [], [], []
        for p in range(PARTS):
            y = x
            for k in range(3):
                y = hadamard(y * signs(dim)[t, p, k]) / np.sqrt(dim)
            size = np.abs(y)
            two = np.argpartition(-size, 1, axis=1)[:, :2]
            got = np.take_along_axis(size, two, axis=1)
            swap = got[:, 1] > got[:, 0]
            two[swap] = two[swap][:, ::-1]
            got = np.sort(got, axis=1)[:, ::-1]
            vertex = two + dim * (np.take_along_axis(y, two, axis=1) < 0)
            first.append(vertex[:, 0])
            second.append(vertex[:, 1])
            loss.append(got[:, 0] ** 2 - got[:, 1] ** 2)
        loss = np.stack(loss, axis=1)
        order = np.argsort(loss, axis=1)
        for probe in range(PROBES):
            code = np.zeros(n, dtype=np.int64)
            for p in range(PARTS):
                changed = (probe > 0) & (order[:, probe - 1] == p) if probe else np.zeros(n, dtype=bool)
                code = code * (2 * dim) + np.where(changed, second[p], first[p])
            out[:, t, probe] = code
    return out


def unit(v) -> np.ndarray | None:
    """A vector of length 1, in double precision; None if it can link with nothing."""
    if v is None or not len(v):
        return None
    x = np.array(v, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A unit vector (bytes of doubles; null: links with nothing) and its cells."""
    for batch in batches:
        rows = [unit(v) for v in batch.column("vector").to_pylist()]
        keys: list = [None] * len(rows)
        by_size: dict[int, list[int]] = {}
        for i, x in enumerate(rows):
            if x is not None:
                by_size.setdefault(len(x), []).append(i)
        for which in by_size.values():
            for i, c in zip(which, cells(np.stack([rows[i] for i in which])), strict=True):
                keys[i] = c.ravel().tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("v"), batch.column("label"), pa.array([None if x is None else x.tobytes() for x in rows], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["v", "label", "x", "cells"],
        )


def _compare(rows: pa.Table) -> pa.Table | None:
    """Links of a bucket's block pair: counts of those that have no earlier bucket, and edges that connect the linked.

    Rows (a, b, n): a has n further links if b is null, else a and b are connected.
    """
    rep, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float64).reshape(len(rep), -1)
    cell = np.array(rows.column("cells").to_pylist()).reshape(len(rep), TABLES, PROBES)
    t, code = rows.column("t")[0].as_py(), rows.column("code")[0].as_py()
    side, p1, p2 = (rows.column(c).to_numpy() for c in ("side", "p1", "p2"))
    left = np.flatnonzero(side == p1[0])
    right = left if p1[0] == p2[0] else np.flatnonzero(side == p2[0])
    count = np.zeros(len(rep), dtype=np.int64)
    parent = np.arange(len(rep))
    for lo in range(0, len(left), 128):
        mine = left[lo : lo + 128]
        i, j = np.nonzero(x[mine] @ x[right].T >= COSINE)
        i, j = mine[i], right[j]
        ok = i < j if p1[0] == p2[0] else rep[i] != rep[j]
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        seen = np.zeros(len(i), dtype=bool)
        for k in range(t + 1):
            for p in range(PROBES):
                for q in range(PROBES):
                    same = cell[i, k, p] == cell[j, k, q]
                    seen |= same if k < t else same & (cell[i, k, p] < code)
        np.add.at(count, i[~seen], copies[j[~seen]])
        np.add.at(count, j[~seen], copies[i[~seen]])
        while True:
            a, b = parent[i], parent[j]
            if (a == b).all():
                break
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    some, tied = np.flatnonzero(count), np.flatnonzero(parent != np.arange(len(rep)))
    if not len(some) and not len(tied):
        return None
    return pa.table(
        {
            "a": pa.array(np.concatenate([rep[some], rep[tied]])),
            "b": pa.array([None] * len(some) + rep[parent[tied]].tolist(), pa.int64()),
            "n": pa.array(np.concatenate([count[some], np.zeros(len(tied), np.int64)])),
        }
    )


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Every row of vectors: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, they have the same number of components, and their cosine in
    double precision is COSINE or more.  A vector that is null, empty or zero or holds a null or non-finite component
    links with nothing.  n_links counts other ids; component_id is the smallest id reachable; kept: it is the row's own.

    Copies (equal unit vectors) are one node with a count.  Nodes are put into PROBES cells of each of TABLES tables;
    those that share a cell are compared exactly, in blocks.  A pair that shares several cells counts in the first.
    Only counts and connecting edges leave a block, never its pairs.  A null id is an id that sorts last.  Rows that
    repeat an id count once; if their vectors differ, each row has its own links.
    """
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("v"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    made = table(rows.mapInArrow(_prepare, "v long, label string, x binary, cells array<long>"), "vectors")
    valid = made.where("x is not null and label is not null")
    hashed = valid.select("v", "label", "x", "cells", F.sha2(F.col("x"), 256).alias("h"))
    copies = hashed.groupBy("label", "h").agg(F.min("v").alias("rep"), F.count_distinct("v").alias("copies"))
    nodes = hashed.dropDuplicates(["label", "h"]).select("label", "h", "x", "cells").join(copies, ["label", "h"])
    # two nodes of one id (it repeats with another vector) stay apart
    nodes = nodes.withColumn("node", F.row_number().over(Window.partitionBy("rep").orderBy("label", "h")) - 1).withColumn("rep0", F.col("rep"))
    nodes = nodes.withColumn("rep", F.when(F.col("node") == 0, F.col("rep")).otherwise(-F.abs(F.xxhash64("rep", "label", "h")) - 1))
    nodes = table(nodes.drop("node"), "nodes")
    cell = F.posexplode("cells").alias("k", "code")
    put = nodes.select("rep", "label", "copies", "x", "cells", cell).withColumn("t", F.expr(f"k div {PROBES}").cast("int"))
    put = put.drop("k").withColumn("width", F.octet_length("x"))
    bucket = ["label", "width", "t", "code"]
    size = table(put.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1"), "cells")
    put = put.join(beside(size), bucket)
    put = dealt(put, bucket, "rep", BLOCK).withColumn("bucket", F.xxhash64(*bucket))
    found = table(grouped(put, ["bucket", *bucket, "p1", "p2"], _compare, "a long, b long, n long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    comp = components(found.where("b is not null")).withColumnsRenamed({"node": "rep", "component": "c"})
    told = nodes.select("label", "h", "rep", "rep0", "copies").join(links, "rep", "left").join(comp, "rep", "left")
    told = told.withColumn("c", F.coalesce("c", "rep"))
    least = told.groupBy("c").agg(F.min("rep0").alias("component"))
    told = told.join(least, "c").select("label", "h", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    told = table(told, "told")
    out = made.select("v", "label", F.when(F.col("x").isNotNull(), F.sha2(F.col("x"), 256)).alias("h"))
    out = out.join(beside(told), ["label", "h"], "left").withColumn("component", F.coalesce("component", "v"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(kind)
    return out.select(
        back("v").alias("vec_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        back("component").cast("long").alias("component_id"),
        (F.col("v") == F.col("component")).alias("kept"),
    )


def op3_embedding(spark, sf_dir):
    """All embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = {
    "op3_embedding": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
""",
}
