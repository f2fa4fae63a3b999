"""Line dedup by pairwise alignment: documents that share lines are aligned, and common blocks leave the later one."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm._common import NO_ID, beside, checked, only, table, text_hash

#: Up to this many different documents with a shared line, all are aligned with one another.
RARE = 10
#: A partner of this share of all pairs is treated apart, so that they need not meet in one task; there are at most 1 / HOT.
HOT = 1e-3
#: Words that an aligned block has at least; a shorter one is no copy.
MIN_WORDS = 5


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with ink: its number, its rank among such lines, 128 bits of its bytes, its words."""
    low = (1 << 64) - 1
    for batch in batches:
        d, t1 = batch.column("d").to_pylist(), batch.column("t1").to_pylist()
        out: list[list] = [[] for _ in range(7)]
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            k = 0
            for no, line in enumerate(text.split(b"\n")):
                words = len(line.split())
                if words:
                    h = xxhash.xxh3_128_intdigest(line)
                    for to, v in zip(out, (d[i], t1[i], k, no, h >> 64, h & low, words), strict=True):
                        to.append(v)
                    k += 1
            if len(out[0]) > 50_000:
                yield _line_batch(out)
                out = [[] for _ in range(7)]
        yield _line_batch(out)


def _line_batch(out: list[list]) -> pa.RecordBatch:
    names = ["d", "t1", "k", "no", "h1", "h2", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.uint64(), pa.uint64(), pa.int32()]
    cols = [pa.array(v, type=t) for v, t in zip(out, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([c.view(pa.int64()) if c.type == pa.uint64() else c for c in cols], names)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, ascending in both.

    Equal ends are aligned first.  Within the rest, elements that occur once on either side are matched and the
    longest ascending chain of these matches (of equally long ones that with the least ends) divides it into parts
    that are aligned in the same way.  Where nothing occurs once on either side, elements count as different when
    their occurrence number differs, and the chain ends it.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, p, q = todo.pop()
        while i < j and p < q and a[i] == b[p]:
            out.append((i, p))
            i, p = i + 1, p + 1
        while i < j and p < q and a[j - 1] == b[q - 1]:
            j, q = j - 1, q - 1
            out.append((j, q))
        if i >= j or p >= q:
            continue
        na, nb = Counter(a[i:j]), Counter(b[p:q])
        where = {x: p + y for y, x in enumerate(b[p:q]) if nb[x] == 1}
        matches = [(x, where[a[x]]) for x in range(i, j) if na[a[x]] == 1 and a[x] in where]
        if matches:
            chain = _chain(matches)
            for (x, y), (z, w) in zip([(i - 1, p - 1), *chain], [*chain, (j, q)], strict=True):
                todo.append((x + 1, z, y + 1, w))
            out += chain
            continue
        labelled: dict = {}
        count: Counter = Counter()
        for y in range(p, q):
            count[b[y]] += 1
            labelled[b[y], count[b[y]]] = y
        count = Counter()
        matches = []
        for x in range(i, j):
            count[a[x]] += 1
            if (a[x], count[a[x]]) in labelled:
                matches.append((x, labelled[a[x], count[a[x]]]))
        out += _chain(matches)
    return sorted(out)


def _chain(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain that ascends in the second place; the first place ascends already."""
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, y) in enumerate(matches):
        k = bisect_left(ends, y)
        back.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(y)
            at.append(n)
        else:
            ends[k], at[k] = y, n
    out = []
    n = at[-1] if at else -1
    while n >= 0:
        out.append(matches[n])
        n = back[n]
    return out[::-1]


def common_blocks(later: list[tuple], earlier: list[tuple], min_words: int) -> list[int]:
    """Numbers of the later document's lines in aligned blocks of enough words; lines are (k, no, hash, words)."""
    pairs = patience([x[2] for x in later], [x[2] for x in earlier])
    out: list[int] = []
    block: list[int] = []
    words = 0
    last = (-9, -9)
    for i, j in [*pairs, (-1, -1)]:
        here = (later[i][0], earlier[j][0]) if i >= 0 else (-9, -9)
        if i < 0 or (here[0] - last[0], here[1] - last[1]) != (1, 1):
            if words >= min_words:
                out += block
            block, words = [], 0
        if i >= 0:
            block.append(later[i][1])
            words += later[i][3]
            last = here
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of each sequence: a hash of every run of 1, 2, 4, 8, ... adjacent shared lines."""
    for batch in batches:
        q, d, key = [], [], []
        for own, least, lines in zip(batch.column("q").to_pylist(), batch.column("f").to_pylist(), _rows(batch.column("lines")), strict=True):
            at = [k for k, *_ in lines]
            h = [f"{a:x},{b:x}" for _, _, (a, b), _ in lines]
            n = 1
            while n <= len(h):
                keys = {xxhash.xxh3_64_intdigest(" ".join(h[i : i + n]), n) for i in range(len(h) - n + 1) if at[i + n - 1] - at[i] == n - 1}
                q += [own] * len(keys)
                d += [least] * len(keys)
                key += keys
                n *= 2
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(key, pa.uint64()).view(pa.int64())], ["q", "f", "key"])


def _rows(column: pa.Array) -> Iterator[list[tuple]]:
    """Sequences as lists of (k, place, hash, words)."""
    flat = column.flatten()
    k, h1, h2, words = (flat.field(c).to_pylist() for c in ("k", "h1", "h2", "words"))
    ends = np.cumsum(column.value_lengths().to_numpy()).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        yield [(k[i], i - a, (h1[i], h2[i]), words[i]) for i in range(a, b)]


def _align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [common_blocks(a, b, min_words) for a, b in zip(_rows(batch.column("mine")), _rows(batch.column("theirs")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("copy"), pa.array(hit, pa.list_(pa.int32()))], ["q", "copy", "gone"])

    return run


def remove_common_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs as row (all its columns), doc_id, kept (its text without removed lines), n_lines, n_removed, gone (line numbers).

    Documents are compared by their sequences of shared lines (those that several documents have).  Documents of equal
    sequences are aligned with the first of them, which takes all that any other partner could.  A sequence has as
    partners all earlier sequences with which it shares a line, or a run of 2, 4, 8, ... adjacent lines, that at most
    RARE sequences have; and of each more common line or run the first sequence that has it.  So every block is
    compared with a document that has all of it or, longer than a power of two, each of its two halves, and pairs are
    bounded by the number of shared lines, however common one is.  Of documents that share only what is more common than
    RARE, those that are first in nothing are not aligned with each other.

    Each pair is aligned with patience diff.  Blocks of aligned lines that are adjacent on both sides, blank lines
    aside, and have at least `min_words` words together are deleted from the later document.  Lines are judged on the
    input.

    Lines are separated by \\n and equal if their bytes are.  Blank lines are neither matched nor deleted.  A null
    text is empty: one blank line.  A null id sorts last.  Of rows that repeat an id each gets its own result, from
    its own text; where they differ, all of them are partners of later documents.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    keyed = keyed.select("row", "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), text_hash(F.col("text"))[0], "text")
    gone = only(lambda: _removed(keyed, min_words), "gone")
    out = keyed.join(beside(gone), ["d", "t1"], "left")
    cut = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return out.select(
        "row",
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(cut).alias("kept"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("gone"),
    )


def _removed(keyed: DataFrame, min_words: int) -> DataFrame:
    """(d, t1, gone) of the rows (d, t1, text) that lose lines: their numbers."""
    lines = table(
        keyed.select("d", "t1", "text").mapInArrow(_lines, "d long, t1 long, k int, no int, h1 long, h2 long, words int"), "lines"
    )
    shared = lines.groupBy("h1", "h2").agg(F.min("d").alias("f"), F.max("d").alias("m")).where("f < m").select("h1", "h2")
    held = lines.join(beside(table(shared, "shared")), ["h1", "h2"]).groupBy("d", "t1")
    held = held.agg(F.array_sort(F.collect_set(F.struct("k", "no", "h1", "h2", "words"))).alias("own"))
    lined = F.transform("own", lambda x: F.struct(x["k"].alias("k"), x["h1"].alias("h1"), x["h2"].alias("h2"), x["words"].alias("words")))
    held = held.select("d", "t1", F.transform("own", lambda x: x["no"]).alias("nos"), lined.alias("lines"))
    held = table(held.withColumn("q", F.xxhash64("lines")), "held")
    seqs = held.groupBy("q").agg(F.min("d").alias("f"), F.max("d").alias("m"), F.min("lines").alias("lines"))
    seqs = table(seqs, "sequences")
    keys = table(seqs.select("q", "f", "lines").mapInArrow(_runs, "q long, f long, key long"), "runs")
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("f", "q")).alias("lead")).where("n > 1")
    met = table(keys.join(beside(table(counts, "counts")), "key"), "met")
    common = met.where(F.col("n") > RARE).select("q", "f", F.col("lead.q").alias("p"), F.col("lead.f").alias("pf"))
    few = met.where(F.col("n") <= RARE).groupBy("key").agg(F.collect_list(F.struct("q", "f")).alias("x"))
    few = few.select("x", F.explode("x").alias("y")).select(F.col("y.q").alias("q"), F.col("y.f").alias("f"), F.explode("x").alias("z"))
    few = few.select("q", "f", F.col("z.q").alias("p"), F.col("z.f").alias("pf"))
    pairs = few.union(common).where("pf < f").select("q", "p").distinct()
    # equal sequences: the first one's own lines
    pairs = table(pairs.union(seqs.where("f < m").select("q", F.col("q").alias("p"))), "pairs")
    mine, theirs = seqs.select("q", F.col("lines").alias("mine")), seqs.select(F.col("q").alias("p"), F.col("lines").alias("theirs"))
    # a partner of very many documents is sent to every task, if all such fit, and else shuffled like any other
    many = pairs.groupBy("p").agg(F.count("*").alias("n"))
    hot = table(many.where(F.col("n") >= F.lit(HOT * max(pairs.count(), 1))).select("p").join(theirs, "p"), "partners")
    found = pairs.join(beside(mine), "q")
    found = found.join(checked(hot), "p").unionByName(found.join(checked(hot).select("p"), "p", "left_anti").join(beside(theirs), "p"))
    found = found.select("q", (F.col("p") == F.col("q")).alias("copy"), "mine", "theirs")
    hits = found.mapInArrow(_align(min_words), "q long, copy boolean, gone array<int>").where(F.size("gone") > 0)
    hits = table(hits.groupBy("q", "copy").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("at")), "hits")
    gone = held.select("d", "t1", "nos", "q").join(beside(seqs.select("q", "f")), "q").withColumn("copy", F.col("d") > F.col("f"))
    gone = gone.join(beside(hits), ["q", "copy"])
    return gone.select("d", "t1", F.array_sort(F.transform("at", lambda i: F.get("nos", i))).alias("gone"))


def op10_lines(spark, sf_dir):
    """All documents."""
    out = remove_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
