"""Lines from nested text blocks: fragments, baselines, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.python_semantics import nfkc

BOLD_FLAG, BASELINE, WIDE_GAP = 16, 2.0, 2.0
PROBE_PAGES = 10

BLOCKS = (
    "array<struct<type:int,lines:array<struct<bbox:array<double>,spans:array<struct<text:string,size:double,flags:int,font:string>>>>>>"
)


def fragments(pages: DataFrame) -> DataFrame:
    """One row per text line of a page's blocks (doc_id, page, blocks) that has ink: frag_no, text, x0, x1, y, size, bold."""
    b = pages.select("doc_id", "page", F.posexplode("blocks").alias("b", "block")).where("block.type = 0")
    ln = b.select("doc_id", "page", "b", F.posexplode("block.lines").alias("l", "line"))
    inked = F.filter("line.spans", lambda s: T.strip(F.coalesce(s["text"], F.lit(""))) != "")
    ln = ln.withColumn("inked", inked).where(F.size("inked") > 0)
    bold = F.exists("inked", lambda s: (s["flags"].bitwiseAND(BOLD_FLAG) != 0) | F.contains(F.lower(s["font"]), F.lit("bold")))
    joined = F.array_join(F.transform("line.spans", lambda s: F.coalesce(s["text"], F.lit(""))), "")
    return ln.select(
        "doc_id", "page", (F.col("b") * F.lit(1_000_000) + F.col("l")).alias("frag_no"),
        T.strip(nfkc(joined)).alias("text"),
        F.get("line.bbox", F.lit(0)).alias("x0"), F.get("line.bbox", F.lit(1)).alias("y"), F.get("line.bbox", F.lit(2)).alias("x1"),
        F.array_max(F.transform("inked", lambda s: s["size"])).alias("size"), bold.alias("bold"),
    )


def baseline_lines(frags: DataFrame) -> DataFrame:
    """Fragments of a page grouped into lines.

    In the order of (y, x0) a line holds what lies within BASELINE of its first fragment: a fold, since the anchor
    moves with each new line.  It runs as an expression over a page's sorted fragments, and a page is bounded.
    """
    frag = F.struct("y", "x0", "frag_no", "x1", "size", "bold", "text")
    pages = frags.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(frag)).alias("fs"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("gs"))

    def step(acc, f):
        new = acc["anchor"].isNull() | (f["y"] - acc["anchor"] > BASELINE)
        g = acc["g"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, f["y"]).otherwise(acc["anchor"]).alias("anchor"), g.alias("g"), F.concat(acc["gs"], F.array(g)).alias("gs"))

    pages = pages.withColumn("gs", F.aggregate("fs", start, step)["gs"])
    rows = pages.select("doc_id", "page", F.explode(F.arrays_zip("gs", "fs")).alias("z")).select("doc_id", "page", F.col("z.gs").alias("g"), "z.fs.*")
    # within a line, from left to right; a wide gap shows as two spaces
    across = F.array_sort(F.collect_list(F.struct("x0", "y", "frag_no", "x1", "size", "text")))
    lines = rows.groupBy("doc_id", "page", "g").agg(across.alias("a"), F.min("x0").alias("x"), F.min("y").alias("y"), F.max("size").alias("size"), F.bool_or("bold").alias("bold"))
    parts = F.transform(
        "a",
        lambda f, i: F.when(i == 0, f["text"]).otherwise(
            F.concat(F.when(f["x0"] - F.get("a", i - 1)["x1"] > WIDE_GAP * f["size"], "  ").otherwise(" "), f["text"])
        ),
    )
    return lines.select("doc_id", "page", "g", F.array_join(parts, "").alias("text"), "x", "y", "size", "bold")


def lines_from_blocks(pages: DataFrame) -> DataFrame:
    """The line table of nested block pages: doc_id, page, g (line of the page, from 1), text, x, y, size, bold."""
    return baseline_lines(fragments(pages))


def has_text_layer(lines: DataFrame) -> DataFrame:
    """(doc_id, has_text): whether one of the first pages has text that is not blank."""
    ink = F.col("n_words") > 0 if "n_words" in lines.columns else T.strip(F.col("text")) != ""
    return lines.groupBy("doc_id").agg(F.bool_or((F.col("page") < PROBE_PAGES) & ink).alias("has_text"))
