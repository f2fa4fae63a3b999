"""Mixing sources to target weights: a time-varying curriculum over positions of the training run (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm._common import WORD, table

#: Weight over training progress 0..1, as (progress, weight) knots joined by straight lines, for the sources in
#: code-point order, repeating.  Their areas are 5, 2 and 1: the first starts strong, the third is phased in.
CURRICULUM = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Documents of one source that one ordering task takes at most, on average.
BIN_ROWS = 4_000


def _segments(knots):
    """(start, weight at start, slope, area before) of each straight piece, and the whole area."""
    out, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        if t1 < t0 or min(w0, w1) < 0:
            raise ValueError("knots must be in order and weights not negative")
        if t1 > t0:
            out.append((t0, w0, (w1 - w0) / (t1 - t0), area))
            area += (w0 + w1) / 2 * (t1 - t0)
    if knots[0][0] != 0 or knots[-1][0] != 1 or area <= 0:
        raise ValueError("a schedule runs from 0 to 1 and has a positive area")
    return out, area


def progress(share: Column, pattern: Column, schedules=CURRICULUM) -> Column:
    """The training progress at which a source has had `share` of its tokens: its schedule's integral, inverted."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        segments, area = _segments(knots)
        piece = None
        for t0, w0, slope, before in segments:
            need = share * F.lit(area) - F.lit(before)
            root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0)))
            here = F.lit(t0) + F.when(root > 0, F.lit(2.0) * need / root).otherwise(0.0)
            piece = here if piece is None else F.when(need >= 0, here).otherwise(piece)
        out = F.when(pattern == k, F.least(piece, F.lit(1.0))).otherwise(out)
    return out


def mix(
    docs: DataFrame,
    schedules=CURRICULUM,
    max_repeats: int = 3,
    total: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """One row per document, range-sorted by training position: what the mix takes of it, and when.

    Each source's share of `total` (default: all words) follows the area of its schedule; a target stops at
    `max_repeats` times its source's words and the excess goes to the others by weight.  Within a source, documents
    stand in the order of a hash of their id and are read round and round until the target is met; the last document
    reached is taken in part.  Position p of a document is the progress at which its source's cumulative demand, the
    integral of its weight schedule, reaches the words that stand before it.

    row_col names an orderable column that is returned as `row` and orders rows of equal id and size.  Returns doc_id, source, size, source_size, target, taken, passes (array of positions, one per reading), position
    (the first; null if nothing is taken).  A null or blank text has size 0, takes nothing and gets no position; a
    null source is a source that sorts last; rows that repeat an id count one by one.  An empty table gives no rows.

    A source's running total is taken in two steps (within hash bins, then over bins), so that one that holds a
    large part of all rows is spread over many tasks.
    """
    areas = [_segments(k)[1] for k in schedules]
    extra_col = [F.col(row_col).alias("row")] if row_col else []
    carried = ["row"] if row_col else []
    sized = table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
            *extra_col,
        ),
        "sizes",
    )
    by = Window.orderBy(F.asc_nulls_last("source"))
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    src = src.withColumn("pattern", ((F.row_number().over(by) - 1) % len(schedules)).cast("int"))
    weight = F.lit(None).cast("double")
    for k, a in enumerate(areas):
        weight = F.when(F.col("pattern") == k, F.lit(a)).otherwise(weight)
    src = src.withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    src = src.withColumn("t", F.lit(float(total)) if total is not None else F.sum("source_size").over(Window.partitionBy()).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("full", F.col("cap") * rest <= F.col("w") * (F.col("t") - before))
    everything = Window.partitionBy()
    left = F.col("t") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    src = src.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * left / open_w))
    src = table(src.select("source", "source_size", "n", "pattern", "target"), "sources").withColumnRenamed("source", "s")
    bins = max(1, -(-(src.agg(F.max("n")).first()[0] or 0) // BIN_ROWS))

    rows = sized.join(src, F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "bin", F.shiftright(F.shiftright("h", 30) * F.lit(bins), 30)
    )
    key = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    sums = rows.groupBy(key[0].alias("k"), key[1].alias("none"), "bin").agg(F.sum("size").alias("b"))
    upto = Window.partitionBy("k", "none").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = table(sums.select("k", "none", "bin", F.coalesce(F.sum("b").over(upto), F.lit(0)).alias("base")), "bins")
    rows = rows.withColumns({"k": key[0], "none": key[1]}).join(sums, ["k", "none", "bin"])
    within = Window.partitionBy("k", "none", "bin").orderBy("h", F.asc_nulls_last("doc_id"), "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    part = F.col("target") - turns * F.col("source_size")
    extra = F.least(F.greatest(F.floor(part + F.lit(0.5)).cast("long") - F.col("start"), F.lit(0)), F.col("size"))
    rows = rows.withColumns({"extra": extra, "turns": turns}).withColumn("taken", F.col("turns") * F.col("size") + F.col("extra"))
    readings = F.when(F.col("taken") > 0, F.col("turns") + F.when(F.col("extra") > 0, 1).otherwise(0)).otherwise(F.lit(0)).cast("int")
    at = lambda turn: progress((F.col("start") + turn * F.col("source_size")) / F.col("target"), F.col("pattern"), schedules)
    steps = [F.when(readings > p, at(F.lit(p))) for p in range(max_repeats + 1)]
    rows = rows.withColumn("passes", F.filter(F.array(*steps), lambda x: x.isNotNull()))
    rows = rows.withColumn("position", F.get("passes", F.lit(0)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "position", *carried).orderBy(
        F.asc_nulls_last("position"), F.asc_nulls_last("doc_id")
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """The mix as a stream: one row per reading of a document (doc_id, reading, position), sorted by position."""
    rows = mixed.select("doc_id", F.posexplode("passes").alias("reading", "position"))
    return rows.orderBy("position", F.asc_nulls_last("doc_id"), "reading")


def op1_mix(spark, sf_dir):
    """All documents, under the default curriculum (5, 2, 1)."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position")
    )


_PROGRESS = """least(CASE p WHEN 0 THEN 0.0 + CASE WHEN 7.5::DOUBLE + sqrt(greatest(7.5::DOUBLE*7.5 + (2 * -5.0)::DOUBLE * (y*5.0::DOUBLE - 0.0), 0)) > 0
      THEN 2.0::DOUBLE * (y*5.0::DOUBLE) / (7.5::DOUBLE + sqrt(greatest(56.25::DOUBLE + -10.0::DOUBLE * (y*5.0::DOUBLE), 0))) ELSE 0 END
    WHEN 1 THEN 2.0::DOUBLE * (y*2.0::DOUBLE) / (2.0::DOUBLE + sqrt(4.0::DOUBLE))
    ELSE 2.0::DOUBLE * (y*1.0::DOUBLE) / (0.5::DOUBLE + sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * (y*1.0::DOUBLE), 0))) END, 1.0)"""

ORACLE = {
    "op1_mix": rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS p FROM s0),
s2 AS (SELECT *, CASE p WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, (3 * source_size)::DOUBLE AS cap,
  (sum(source_size) OVER ())::DOUBLE AS t FROM s1),
s3 AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= w * (t - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM s2),
s4 AS (SELECT source, source_size, p, CASE WHEN is_full THEN cap
  ELSE w * (t - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target FROM s3),
r AS (SELECT d.doc_id, d.size, s4.source_size, s4.target, s4.p,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM sized d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS f FROM r),
v AS (SELECT *, least(greatest(floor(target - f * source_size + 0.5)::BIGINT - c, 0), size) AS extra, c / target AS y FROM u),
x AS (SELECT doc_id, size, source_size, target, (f * size + extra)::BIGINT AS taken, p, y FROM v)
SELECT doc_id, size, source_size, target, taken, round(CASE WHEN taken > 0 THEN {_PROGRESS} END, 9) AS position FROM x
""",
}
