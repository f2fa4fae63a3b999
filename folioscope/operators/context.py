"""The text that a language model is shown of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.headings import with_body

FACTOR, MOST = 1.1, 400

# What stands before the contents' text and the candidate lines, and the form of a candidate line.
CONTENTS = "Table of contents text:\n"
CANDIDATES = "Candidate heading lines (body text size %.1f; physical_page is 0-based, not a printed page number):\n"
CANDIDATE = "physical_page=%d size=%.1f bold=%s text=%s"


def context_lines(lines: DataFrame) -> DataFrame:
    """The first MOST lines of each document that are larger than the body or bold."""
    c = with_body(lines).where((F.col("size") >= F.col("body") * FACTOR) | F.col("bold"))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))).where(F.col("rn") <= MOST)


def llm_context(lines: DataFrame, toc_pages: DataFrame, quote=None) -> DataFrame:
    """(doc_id, context): the contents pages' text where there are any, else the candidate lines.

    quote(column) writes a text as a literal; the default keeps it as it is.
    """
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", c.alias("s")))), lambda x: x["s"]), "\n")
    t = lines.join(toc_pages, ["doc_id", "page"], "left_semi").groupBy("doc_id").agg(ordered(F.col("text")).alias("t"))
    text = quote(F.col("text")) if quote else F.col("text")
    one = F.format_string(CANDIDATE, "page", "size", F.when(F.col("bold"), "True").otherwise("False"), text)
    c = context_lines(lines).groupBy("doc_id", "body").agg(ordered(one).alias("c"))
    docs = lines.select("doc_id").distinct().join(t, "doc_id", "left").join(c, "doc_id", "left")
    head = F.format_string(CANDIDATES, F.coalesce("body", F.lit(0.0)))
    found = F.concat(F.lit(CONTENTS), "t")
    return docs.select("doc_id", F.when(F.col("t").isNotNull(), found).otherwise(F.concat(head, F.coalesce("c", F.lit("")))).alias("context"))
