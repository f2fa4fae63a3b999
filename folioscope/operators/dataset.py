"""Training-set construction: ordered dedup, hash split, gates, prompts and generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

CHARS_PER_TOKEN = 3
MIN_PAGES, MIN_ALIGNMENT = 4, 0.6
MAX_UNLOCATABLE = 0.2

# Fixed value: the text around a context that training and serving share.
PROMPT = (
    "The following text was extracted from a PDF. It contains either a table of\n"
    "contents or a list of candidate section headings (with font metadata). Produce the\n"
    "document outline: one entry per real section, in document order. `level` is the nesting\n"
    "depth (1 = chapter, 2 = subchapter, ...). Set `printed_page` when a page number is shown\n"
    "next to the entry. Exclude page furniture, running headers, and anything that is not a\n"
    "section heading. Keep titles exactly as written (minus dot leaders and page numbers).\n"
    "\n"
    "{context}"
)

OUTLINE = "struct<entries:array<struct<title:string,level:int,printed_page:int>>>"


def first_of_each(records: DataFrame, order: str = "ord") -> DataFrame:
    """The first record of each (sha256, context_kind), in file order."""
    w = Window.partitionBy("sha256", "context_kind").orderBy(order)
    return records.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def split_records(records: DataFrame, train: float = 0.8, val: float = 0.1, order: str = "ord") -> DataFrame:
    """Deduplicated records with their split; synthetic and silver ones stay in train or go."""
    r = first_of_each(records, order).withColumn("split", T.split_of(F.col("sha256"), train, val))
    only_train = (F.col("context_kind") == "headings-synthetic") | F.coalesce(F.col("silver"), F.lit(False))
    return r.where(~only_train | (F.col("split") == "train"))


def split_counts(records: DataFrame) -> DataFrame:
    """Rows per split, and what was dropped as duplicate or as train-only."""
    kept = split_records(records).groupBy("split").agg(F.count("*").alias("n"))
    uniq = first_of_each(records)
    counts = records.agg(F.count("*").alias("all")).crossJoin(uniq.agg(F.count("*").alias("uniq"))).crossJoin(split_records(records).agg(F.count("*").alias("kept")))
    lost = counts.select(F.expr("stack(2, 'duplicate', all - uniq, 'train-only', uniq - kept) as (split, n)"))
    return kept.unionByName(lost)


def sft_row(context: Column, entries: Column) -> Column:
    """prompt and completion; entries: array of (title, level, printed_page)."""
    completion = F.to_json(F.struct(entries.alias("entries")), {"ignoreNullFields": "false"})
    return F.struct(F.replace(F.lit(PROMPT), F.lit("{context}"), context).alias("prompt"), completion.alias("completion"))


def fits(prompt: Column, completion: Column, max_tokens: int) -> Column:
    return F.char_length(prompt) + F.char_length(completion) <= CHARS_PER_TOKEN * max_tokens


def parse_generation(generation: Column) -> Column:
    """The entries of the first JSON object of a generation; null if there is none or it breaks the schema."""
    at = F.instr(generation, "{")
    parsed = F.from_json(F.when(at > 0, F.substring(generation, at, F.char_length(generation))), OUTLINE)
    entries = parsed["entries"]
    good = entries.isNotNull() & ~F.exists(entries, lambda e: e["title"].isNull() | e["level"].isNull())
    return F.when(good, entries)


def harvest_reason(r: dict[str, Column]) -> Column:
    """Why a document is skipped, in the order of the checks; null if it is not.

    r: unreadable, encrypted, has_outline, page_count, has_text, alignment.
    """
    return (
        F.when(r["unreadable"], "unreadable")
        .when(r["encrypted"], "encrypted")
        .when(~r["has_outline"], "no-embedded-outline")
        .when(r["page_count"] < MIN_PAGES, "too-short")
        .when(~r["has_text"], "no-text-layer")
        .when(r["alignment"] < MIN_ALIGNMENT, "poor-alignment")
    )


def lines_reason(r: dict[str, Column]) -> Column:
    """Why a document gives no labelled lines.  r: unreadable, encrypted, has_outline, has_text, aligned."""
    return (
        F.when(r["unreadable"], "unreadable")
        .when(r["encrypted"], "encrypted")
        .when(~r["has_outline"], "no-embedded-outline")
        .when(~r["has_text"], "no-text-layer")
        .when(r["aligned"] == 0, "no-alignment")
    )


def distill_reason(r: dict[str, Column], max_unlocatable: float = MAX_UNLOCATABLE) -> Column:
    """The like for documents without an outline, after a teacher has been asked.  r also: n_entries, failures."""
    return (
        F.when(r["unreadable"], "unreadable")
        .when(r["encrypted"], "encrypted")
        .when(r["has_outline"], "has-embedded-outline")
        .when(r["page_count"] < MIN_PAGES, "too-short")
        .when(~r["has_text"], "no-text-layer")
        .when(r["n_entries"] == 0, "teacher-empty")
        .when(F.try_divide(r["failures"], r["n_entries"]) > max_unlocatable, "teacher-unlocatable")
    )


def pending(records: DataFrame, done: DataFrame, key: str = "sha256") -> DataFrame:
    """Records that a resumed run still has to do."""
    return records.join(done.select(key), key, "left_anti")


def chosen(records: DataFrame, keys: DataFrame, key: str = "sha256") -> DataFrame:
    return records.join(keys.select(key), key, "left_semi")
