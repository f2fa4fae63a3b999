"""From decoded documents to training records: harvest, line dataset, distillation, dataset.

docs: doc_id, file, sha256, page_count, unreadable, encrypted, toc (array of level, title, page; page from 1; an empty one
is none).  lines: the line table of those that could be read.  Every document ends as records or as a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.python_semantics import quoted
from folioscope.operators import align, dataset
from folioscope.operators.context import llm_context
from folioscope.operators.entries import to_entries
from folioscope.operators.extract import has_text_layer
from folioscope.operators.features import line_features
from folioscope.operators.locate import locate_hinted
from folioscope.operators.toc import contents_pages, parse_contents
from folioscope.scratch import table

RECORD = "file string, sha256 string, page_count int, context_kind string, context string, entries array<struct<title:string,level:int,printed_page:int>>, alignment double, silver boolean"


def _facts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    d = docs.join(has_text_layer(lines), "doc_id", "left").withColumn("has_text", F.coalesce("has_text", F.lit(False)))
    return d.withColumns({"has_outline": F.coalesce(F.size("toc") > 0, F.lit(False)), "unreadable": F.coalesce("unreadable", F.lit(False)), "encrypted": F.coalesce("encrypted", F.lit(False))})


def _named(*names: str) -> dict:
    return {n: F.col(n) for n in names}


def _gold(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode("toc").alias("pos", "t"))
    return rows.select("doc_id", "pos", "t.title", F.col("t.level").cast("int").alias("level"), F.col("t.page").cast("int").alias("page"))


def _listed(rows: DataFrame) -> DataFrame:
    e = F.struct("pos", F.struct("title", "level", F.col("printed_page").cast("int").alias("printed_page")).alias("e"))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: x["e"]).alias("entries"))


def harvest(docs: DataFrame, lines: DataFrame, augment: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, reasons): a record for each document with a usable embedded outline, else (doc_id, reason).

    Documents with contents pages take printed pages from their rows, by similarity of titles, and need a matched share of
    MIN_ALIGNMENT; others have none.  augment adds to each of the former a record of kind `headings-synthetic` whose
    context is made of its other pages alone.
    """
    facts = _facts(docs, lines)
    pages = table(contents_pages(lines), "contents_pages")  # read by each of the steps below
    gold = _gold(docs)
    kinds = pages.select("doc_id").distinct().withColumn("toc_kind", F.lit(True))
    with_toc = gold.join(kinds, "doc_id", "left_semi")
    printed = align.align_printed_pages(with_toc, parse_contents(lines, pages))
    facts = facts.join(kinds, "doc_id", "left").join(align.matched_share(printed), "doc_id", "left")
    why = dataset.harvest_reason(_named("unreadable", "encrypted", "has_outline", "page_count", "has_text", "alignment"))
    facts = facts.withColumn("reason", why)
    good = facts.where("reason is null").select("doc_id", "file", "sha256", "page_count", "alignment", F.coalesce("toc_kind", F.lit(False)).alias("toc_kind"))
    entries = _listed(gold.join(printed.select("doc_id", "pos", "printed_page"), ["doc_id", "pos"], "left"))
    context = llm_context(lines, pages, quoted)
    kind = F.when(F.col("toc_kind"), "toc").otherwise("headings")
    out = good.withColumn("context_kind", kind).join(context, "doc_id").join(entries, "doc_id")
    if augment:
        body = lines.join(kinds, "doc_id", "left_semi").join(pages, ["doc_id", "page"], "left_anti").drop("body")
        own = llm_context(body, pages.where("false"), quoted)
        bare = _listed(with_toc.withColumn("printed_page", F.lit(None).cast("int")))
        twin = good.where("toc_kind").withColumn("context_kind", F.lit("headings-synthetic")).withColumn("alignment", F.lit(None).cast("double"))
        out = out.unionByName(twin.join(own, "doc_id").join(bare, "doc_id"))
    records = out.select("doc_id", "file", "sha256", "page_count", "context_kind", "context", "entries", "alignment", F.lit(False).alias("silver"))
    return records, facts.where("reason is not null").select("doc_id", "reason")


def line_dataset(docs: DataFrame, lines: DataFrame, mask: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, reasons): a nested row of labelled lines for each document of which a bookmark finds its line.

    rows: doc_id, file, sha256, page_count, lines (text, page, x, y, size, bold, size_ratio, gap_above, words, label; in
    order), aligned, unaligned, masked.  mask gives the likely lines of unaligned bookmarks the label MASK.
    """
    facts = _facts(docs, lines)
    gold = _gold(docs)
    claimed = align.claims(lines, gold)
    labels = claimed.where("line_no is not null").select("doc_id", "line_no", "label")
    masked = None
    if mask:
        lost = claimed.where("line_no is null").join(gold, ["doc_id", "pos"])
        masked = align.masked_lines(lines, labels, lost, contents_pages(lines))
        labels = labels.unionByName(masked.withColumn("label", F.lit(align.MASK)))
    counts = align.alignment_counts(claimed, masked)
    facts = facts.join(counts, "doc_id", "left").fillna(0, ["aligned", "unaligned", "masked"])
    facts = facts.withColumn("reason", dataset.lines_reason(_named("unreadable", "encrypted", "has_outline", "has_text", "aligned")))
    good = facts.where("reason is null").select("doc_id", "file", "sha256", "page_count", "aligned", "unaligned", "masked")
    rows = line_features(lines).join(labels, ["doc_id", "line_no"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    one = F.struct("line_no", F.struct("text", "page", "x", "y", "size", "bold", "size_ratio", "gap_above", "words", "label").alias("l"))
    nested = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["l"]).alias("lines"))
    return good.join(nested, "doc_id"), facts.where("reason is not null").select("doc_id", "reason")


def distill(docs: DataFrame, lines: DataFrame, backend) -> tuple[DataFrame, DataFrame]:
    """(records, reasons): silver records of documents without an embedded outline, labelled by a backend.

    A teacher's outline counts if at most MAX_UNLOCATABLE of its titles are not found in the text.
    """
    # read by each of the steps below, so the lines are not grouped anew for each
    facts = table(_facts(docs, lines).drop("toc"), "facts")
    pages = table(contents_pages(lines), "contents_pages")
    first = dataset.distill_reason(_named("unreadable", "encrypted", "has_outline", "page_count", "has_text") | {"n_entries": F.lit(None), "failures": F.lit(None)})
    asked = facts.where(first.isNull()).select("doc_id")
    context = llm_context(lines.join(asked, "doc_id", "left_semi"), pages, quoted)
    said = table(backend.outlines(context), "said")  # so that each document is asked for once
    missed = locate_hinted(to_entries(said), lines, pages).groupBy("doc_id").agg(F.count_if("failed").alias("failures"))
    facts = facts.join(said, "doc_id", "left").join(missed, "doc_id", "left").join(pages.select("doc_id").distinct().withColumn("toc_kind", F.lit(True)), "doc_id", "left")
    facts = facts.withColumns({"n_entries": F.when(F.col("error").isNull(), F.size("entries")), "failures": F.coalesce("failures", F.lit(0))})
    named = _named("unreadable", "encrypted", "has_outline", "page_count", "has_text", "n_entries", "failures")
    facts = facts.withColumn("reason", F.coalesce(first, F.col("error"), dataset.distill_reason(named)))
    e = F.transform("entries", lambda x: F.struct(x["title"].alias("title"), x["level"].alias("level"), x["printed_page"].alias("printed_page")))
    records = facts.where("reason is null").join(context, "doc_id").select(
        "doc_id", "file", "sha256", "page_count", F.when(F.col("toc_kind"), "toc").otherwise("headings").alias("context_kind"), "context", e.alias("entries"),
        F.lit(None).cast("double").alias("alignment"), F.lit(True).alias("silver"),
    )
    return records, facts.where("reason is not null").select("doc_id", "reason")


def build(records: DataFrame, train: float = 0.8, val: float = 0.1, order: str = "ord") -> DataFrame:
    """(split, prompt, completion, meta) of deduplicated records, as a model is trained on them."""
    kept = dataset.split_records(records, train, val, order)
    meta = F.struct("sha256", "file", "context_kind")
    return kept.select("split", dataset.sft_row(F.col("context"), F.col("entries")).alias("r"), meta.alias("meta")).select("split", "r.prompt", "r.completion", "meta")


def training_lines(nested: DataFrame, fixed_test: DataFrame | None = None, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Lines of a line dataset with their split: doc_id, split, line_no, page_count, and the line's columns.

    fixed_test (sha256) is the test set, whatever the hash says; documents that the hash puts into the test set without
    being in it are left out.  Masked lines stay, for neighbours' features; drop them after featurizing.
    """
    from folioscope.functions.text import split_of

    d = nested.withColumn("split", split_of(F.col("sha256"), train, val))
    if fixed_test is not None:
        d = d.join(fixed_test.select("sha256", F.lit(True).alias("fixed")).distinct(), "sha256", "left")
        d = d.withColumn("split", F.when(F.col("fixed"), "test").otherwise(F.nullif("split", F.lit("test")))).where("split is not null")
    rows = d.select("doc_id", "split", "page_count", F.posexplode("lines").alias("line_no", "l"))
    return rows.select("doc_id", "split", "page_count", "line_no", "l.*")
