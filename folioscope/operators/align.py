"""Labels for lines and pages for titles, by alignment with an embedded outline."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.python_semantics import similarity

MAX_LEVEL, MASK = 4, -1
SIMILAR = 0.85


def claims(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """(doc_id, pos, line_no, label): every bookmark of toc; line_no and label are null where it claims no line.

    toc: doc_id, pos, level, title, page (from 1).  Each bookmark takes the first unclaimed line with its key on its
    page, the next or the one before; a blank key takes none.  Claims block lines of the same key only, so the fold runs
    per document and key, in which each page's lines are taken from the front.  Lines whose key no bookmark has are left
    out by a hash table of the bookmarks' keys; the others come one by one before their bookmarks.
    """
    e = T.with_keys(toc, "title", "k_merge").select("doc_id", F.col("k_merge").alias("k"), "pos", "level", F.greatest(F.col("page") - 1, F.lit(0)).cast("long").alias("p"))
    wanted = e.where("k <> ''").select("doc_id", "k").distinct()
    kinds = dict(toc.dtypes)
    ln = T.with_keys(lines, "text", "k_merge").withColumnRenamed("k_merge", "k").join(wanted.hint("shuffle_hash"), ["doc_id", "k"], "left_semi")
    ln = ln.select(
        "doc_id", "k", F.lit(0).alias("side"), F.lit(None).cast(kinds["pos"]).alias("pos"), F.lit(None).cast(kinds["level"]).alias("level"),
        F.col("page").cast("long").alias("p"), F.col("line_no").cast("long").alias("n"),
    )
    e = e.withColumns({"side": F.lit(1), "n": F.lit(None).cast("long")})
    rows = ln.unionByName(e).repartition("doc_id", "k").sortWithinPartitions("doc_id", "k", "side", "n", "pos")
    got = rows.mapInArrow(_claim, f"doc_id {kinds['doc_id']}, pos {kinds['pos']}, level {kinds['level']}, line_no long")
    label = F.least(F.greatest(F.col("level"), F.lit(1)), F.lit(MAX_LEVEL)).cast("int")
    return got.select("doc_id", "pos", F.col("line_no").cast(dict(lines.dtypes)["line_no"]).alias("line_no"), F.when(F.col("line_no").isNotNull(), label).alias("label"))


def _claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines taken by bookmarks: of a document and key first the lines come, in order, then the bookmarks."""
    last, free = None, {}
    for batch in batches:
        rows, taken = [], []
        cols = (batch.column(c).to_pylist() for c in ("doc_id", "k", "side", "p", "n"))
        for i, (doc, key, side, page, n) in enumerate(zip(*cols, strict=True)):
            if (doc, key) != last:
                last, free = (doc, key), {}
            if side == 0:
                free.setdefault(page, deque()).append(n)
                continue
            at = next((p for p in (page, page + 1, page - 1) if free.get(p)), None) if page is not None else None
            rows.append(i)
            taken.append(None if at is None else free[at].popleft())
        own = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("pos"), own.column("level"), pa.array(taken, pa.int64())], ["doc_id", "pos", "level", "line_no"])


def align_labels(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """(doc_id, line_no, label) of the lines that bookmarks claim (see `claims`); a label is at most MAX_LEVEL."""
    return claims(lines, toc).where("line_no is not null").select("doc_id", "line_no", "label")


def alignment_counts(claimed: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """(doc_id, aligned, unaligned, masked) of `claims` and `masked_lines`."""
    n = claimed.groupBy("doc_id").agg(F.count("line_no").alias("aligned"), F.count_if(F.col("line_no").isNull()).alias("unaligned"))
    if masked is None:
        return n.withColumn("masked", F.lit(0).cast("long"))
    return n.join(masked.groupBy("doc_id").agg(F.count("*").alias("masked")), "doc_id", "left").fillna(0, ["masked"])


def alignment_totals(counts: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: aligned, unaligned, masked, lines, and the shares aligned of bookmarks, positive and masked of lines."""
    c = counts.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("aligned", "unaligned", "masked")))
    c = c.crossJoin(F.broadcast(lines.agg(F.count("*").alias("lines"))))
    return c.select(
        "*", F.try_divide("aligned", F.col("aligned") + F.col("unaligned")).alias("aligned_share"),
        F.try_divide("aligned", "lines").alias("positive_share"), F.try_divide("masked", "lines").alias("masked_share"),
    )


def masked_lines(lines: DataFrame, labels: DataFrame, unaligned: DataFrame, toc_pages: DataFrame) -> DataFrame:
    """Unlabelled lines that plausibly are an unaligned title's: (doc_id, line_no).

    Keys are equal, or one of at least eight characters begins the other.  Contents pages and rows are never masked.
    Titles and lines meet on the document and the key's first eight characters.
    """
    head = lambda k: F.substring(k, 1, T.PREFIX_CHARS)
    ln = T.with_keys(lines, "text", "k_merge").select("doc_id", "line_no", "page", F.col("k_merge").alias("k"), T.in_contents(lines).alias("listed")).where("k <> ''")
    ln = ln.join(toc_pages, ["doc_id", "page"], "left_anti").where("not listed")
    ln = ln.join(labels.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti").withColumn("h", head(F.col("k")))
    u = T.with_keys(unaligned, "title", "k_merge").select("doc_id", F.col("k_merge").alias("t")).withColumn("h", head(F.col("t"))).distinct()
    return ln.join(u, (ln.doc_id == u.doc_id) & (ln.h == u.h) & T.prefix_match(F.col("k"), F.col("t")), "left_semi").select("doc_id", "line_no")


def align_printed_pages(gold: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, pos, printed_page, matched): for each gold title in order, the best unused contents row of ratio SIMILAR or more.

    Ratios are computed in Arrow batches over a document's pairs of different titles, of which each counts once, however
    often it is repeated.  Taking rows is a fold over a document's titles, which holds its rows by title.
    """
    kinds = dict(gold.dtypes)
    g = T.with_keys(gold, "title", "k_title").select("doc_id", "pos", F.col("k_title").alias("a"))
    r = T.with_keys(rows, "title", "k_title").select("doc_id", F.col("pos").cast("int").alias("r"), F.col("printed_page").cast("int").alias("printed_page"), F.col("k_title").alias("b")).where("b is not null")
    # a ratio is at most 2 * shorter / (shorter + longer): titles of lengths that may reach SIMILAR meet in length classes
    step = math.log(SIMILAR / (2 - SIMILAR))
    size = lambda c: F.floor(F.log(F.greatest(F.char_length(c), F.lit(1)).cast("double")) / (1e-9 - step))
    titles = g.where("a is not null").select("doc_id", "a").distinct().select("*", F.explode(F.sequence(size("a") - 1, size("a") + 1)).alias("z"))
    la, lb = F.char_length("a"), F.char_length("b")
    pairs = titles.join(r.select("doc_id", "b").distinct().withColumn("z", size("b")), ["doc_id", "z"]).drop("z").where(2 * F.least(la, lb) >= SIMILAR * (la + lb))
    # equal titles need no comparison; of the others the number of common characters is a bound as well
    same = F.col("a") == F.col("b")
    pairs = pairs.withColumn("ratio", F.when(same, 1.0).otherwise(similarity(F.when(~same, F.col("a")), F.when(~same, F.col("b")), SIMILAR))).where(F.col("ratio") >= SIMILAR)
    near = pairs.groupBy("doc_id", "a").agg(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("o"), "b"))).alias("near"))
    cols = {"side": "int", "pos": kinds["pos"], "k": "string", "r": "int", "printed_page": "int", "near": "array<struct<o:double,b:string>>"}
    shaped = lambda df, **have: df.select("doc_id", *(have.get(c, F.lit(None)).cast(t).alias(c) for c, t in cols.items()))
    rows = shaped(r, side=F.lit(0), k=F.col("b"), r=F.col("r"), printed_page=F.col("printed_page"))
    rows = rows.unionByName(shaped(near, side=F.lit(1), k=F.col("a"), near=F.col("near"))).unionByName(shaped(g, side=F.lit(2), pos=F.col("pos"), k=F.col("a")))
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "side", "pos", "r")
    return rows.mapInArrow(_take, f"doc_id {kinds['doc_id']}, pos {kinds['pos']}, printed_page int, matched boolean")


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows taken by titles: of a document first its rows come, in order, then the titles near a title, then the titles."""
    last, free, near = object(), {}, {}
    for batch in batches:
        at, printed, matched = [], [], []
        cols = (batch.column(c).to_pylist() for c in ("doc_id", "side", "k", "r", "printed_page", "near"))
        for i, (doc, side, key, r, page, like) in enumerate(zip(*cols, strict=True)):
            if doc != last:
                last, free, near = doc, {}, {}
            if side == 0:
                free.setdefault(key, deque()).append((r, page))
            elif side == 1:
                near[key] = [(x["o"], free[x["b"]]) for x in like]
            else:
                # of equal titles the first free row stands for all
                best = min(((o, left[0][0], left) for o, left in near.get(key, ()) if left), key=lambda x: x[:2], default=None)
                at.append(i)
                printed.append(best[2].popleft()[1] if best else None)
                matched.append(best is not None)
        own = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("pos"), pa.array(printed, pa.int32()), pa.array(matched, pa.bool_())], ["doc_id", "pos", "printed_page", "matched"])


def matched_share(aligned: DataFrame) -> DataFrame:
    """(doc_id, alignment): the share of a document's gold titles that `align_printed_pages` matched."""
    return aligned.groupBy("doc_id").agg(F.avg(F.col("matched").cast("int")).alias("alignment"))
