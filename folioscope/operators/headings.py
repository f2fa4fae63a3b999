"""Body size, heading candidates, wrapped headings and their levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

SIZE_FACTOR, MAX_WORDS, WRAP_EMS = 1.15, 12, 1.5


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the font size, to a tenth, that most characters have; of equal ones the first met."""
    by_size = lines.groupBy("doc_id", F.bround("size", 1).alias("s")).agg(
        F.sum(F.char_length("text")).alias("weight"), F.min("line_no").alias("met")
    )
    return by_size.groupBy("doc_id").agg(F.max_by("s", F.struct("weight", -F.col("met"))).alias("body"))


def with_body(lines: DataFrame) -> DataFrame:
    """lines with the body size of their document, which they may carry already."""
    return lines if "body" in lines.columns else lines.join(body_size(lines), "doc_id")


def detect_headings(lines: DataFrame) -> DataFrame:
    """Outlines from fonts alone: doc_id, pos, title, level, page, y.

    Candidates are short lines that are no page furniture and are larger than the body, or bold and numbered or
    called chapter.  A candidate continues the one before it if both have the page, size and weight in common, stand
    close together, and it is not itself numbered.  Sizes rank the levels where no number gives one.
    """
    lines = T.with_keys(with_body(lines), "text", "n_words")
    large = F.col("size") >= F.col("body") * SIZE_FACTOR
    cand = lines.where(F.col("n_words").between(1, MAX_WORDS) & (large | F.col("bold"))).withColumn("s", T.strip(F.col("text")))
    cand = cand.withColumns({"marked": F.col("s").rlike(T.CHAPTER) | F.col("s").rlike(T.NUMBERED), "tier": F.bround("size", 1)})
    cand = cand.where((large | F.col("marked")) & ~T.is_furniture(F.col("s")))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    prev = lambda c: F.lag(c).over(w)
    joins = (
        (prev("page") == F.col("page"))
        & (prev("tier") == F.col("tier"))
        & (prev("bold") == F.col("bold"))
        & (F.col("y") - prev("y") <= WRAP_EMS * prev("size"))
        & ~F.col("marked")
    )
    cand = cand.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    cand = cand.withColumn("grp", F.sum("new").over(w))
    grp = cand.groupBy("doc_id", "grp").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]), " ").alias("title"),
        F.min(F.struct("line_no", "page", "y", "tier")).alias("f"),
    )
    tiers = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("f.tier")))
    level = F.coalesce(T.numbering_level(F.col("title")), F.when(F.col("title").rlike(T.CHAPTER), 1), tiers)
    return grp.select("doc_id", F.col("grp").cast("int").alias("pos"), "title", level.cast("int").alias("level"), F.col("f.page").alias("page"), F.col("f.y").alias("y"))
