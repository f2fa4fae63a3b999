"""Windows of W units (words or bytes) that occur again: what substring and suffix-array dedup share.

1. *Survey*: every window is anchored at its gram (g units) with the least hash, which equal windows share.  About
   2 / (W - g + 2) of all grams are anchors of some window; only their hashes are shuffled and counted.  A window whose
   anchor does not recur cannot recur, so this leaves out what the costlier steps need not see.
2. *Contexts*: around each anchor that recurs, the run of windows anchored at it is cut out.  Equal contexts meet in
   one row that keeps their first occurrence; all windows of a later one recur.
3. *Shards*: contexts that share an anchor meet, and the method of each operator finds what recurs among them.
4. The spans found go back to their documents, which are read again and cut.

An anchor with more than CROWD distinct contexts is no fair unit of work.  Its contexts are dealt further: each of their
windows goes to the shard of its own hash, as a context of one window, and the same method decides there.  Texts with an
earlier exact copy take no part after step 1; they are wholly made of windows of the first copy.  Long texts are worked
on in overlapping pieces, and equal contexts that follow one another at equal steps, as in periodic text, are one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _bytes as B
from folioscope.llm._common import NO_ID, beside, drop, table, text_hash

#: Distinct contexts of an anchor beyond which its windows are dealt one by one.
CROWD = 20_000
#: Distinct contexts that a shard holds at a time, about.
SHARD = 20_000
#: Contexts that make up this share of all are sent to every task when spans go back: at most 1 / COMMON of them.
COMMON = 1e-5
#: Bytes of a long text that are worked on at once, and rows that a task gathers before it lets them go.
PIECE, ROWS = 2 << 20, 20_000

_CONTEXT = "a long, c1 long, c2 long, d long, t1 long, pos long, len long, step long, times long, ctx binary"
_PARTS = "array<struct<s:long,e:long>>"


def _units(kind: str, gram: int, data: np.ndarray, at: np.ndarray):
    """Hashes of grams of units, where each row's units begin, and where units begin and end (None: bytes)."""
    if kind == "byte":
        return B.byte_grams(data, gram), at, None, None
    begin, end, first = B.words(data, at)
    return B.gram_hashes(B.word_hashes(data, begin, end), gram), first, begin, end


def _pieces(kind: str, gram: int, window: int, column: pa.Array) -> Iterator[tuple]:
    """Runs of rows (first, end, bytes, their `_units`, 0); a long text in pieces that share window - 1 units, with the unit that each begins at."""
    for lo, hi, data, at in B.blocks(column, PIECE):
        if len(data) <= 2 * PIECE:
            yield lo, hi, data, _units(kind, gram, data, at), 0
            continue
        start, base = 0, 0
        while start < len(data):
            end = min(start + PIECE, len(data))
            while kind == "word" and end < len(data) and not B.SPACE[data[end]]:
                end += 1
            part = data[start:end]
            units = _units(kind, gram, part, np.array([0, len(part)]))
            yield lo, hi, part, units, base
            n = int(units[1][-1])
            if end == len(data):
                return
            if n < window:  # too few to hold a window: take more at once
                step = max(n - window + 1, 0)
            else:
                step = n - window + 1
            if step == 0:
                part = data[start:]
                yield lo, hi, part, _units(kind, gram, part, np.array([0, len(part)])), base
                return
            start += step if kind == "byte" else int(units[2][step])
            base += step


def _survey(kind: str, window: int, gram: int, most: int):
    """The anchors of each text, or piece of one; an anchor that occurs again at most `most` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, (g, bounds, _, _), _ in _pieces(kind, gram, window, batch.column("text")):
                row, anchor, _, _ = B.runs(g, bounds, window, gram)
                h = g[anchor].view(np.int64)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                keep = np.ones(len(h), dtype=bool)
                keep[most:] = (h[most:] != h[:-most]) | (row[most:] != row[:-most])
                row, h = row[keep], h[keep]
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in ("d", "t1", "t2")] + [pa.ListArray.from_arrays(cut, pa.array(h))],
                    ["d", "t1", "t2", "anchors"],
                )

    return run


def _contexts(kind: str, window: int, gram: int, once: bool):
    """A row for each context of a document's candidate anchors: pos, len, and `times` that it occurs, `step` apart.

    once: of equal contexts in a document only the first is cut out; later ones are rows without a hash and a text.
    """
    names = [f.split()[0] for f in _CONTEXT.split(", ")]
    kinds = (*(pa.int64(),) * 9, pa.binary())

    def flush(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def add(out: list[list], row: list) -> None:
        """Append a row, or let the last one take it in: the same context a step further, or a later one that adjoins."""
        last = out[-1] if out else None
        if last and last[1:5] == row[1:5]:
            if row[1] is None:
                if last[5] <= row[5] <= last[5] + last[6]:
                    last[6] = max(last[6], row[5] + row[6] - last[5])
                    return
            elif last[6] == row[6] and (last[8] == 1 or row[5] == last[5] + last[7] * last[8]) and row[5] > last[5]:
                last[7] = row[5] - last[5] if last[8] == 1 else last[7]
                last[8] += 1
                return
        out.append(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t1 = batch.column("d").to_pylist(), batch.column("t1").to_pylist()
            cand = batch.column("cand")
            seen: set = set()
            own_row = -1
            for lo, hi, data, (g, bounds, begin, end), base in _pieces(kind, gram, window, batch.column("text")):
                row, anchor, first, last = B.runs(g, bounds, window, gram)
                h = g[anchor].view(np.int64)
                edges = np.searchsorted(row, np.arange(hi - lo + 1))
                out: list[list] = []
                for r in range(hi - lo):
                    if lo + r != own_row:
                        seen, own_row = set(), lo + r
                    own = np.flatnonzero(np.isin(h[edges[r] : edges[r + 1]], np.asarray(cand[lo + r].values))) + edges[r]
                    moved = base - int(bounds[r])
                    for part in range(0, len(own), ROWS):
                        some = own[part : part + ROWS]
                        for a, f, e in zip(h[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                            if begin is None:
                                ctx = data[f : e + window].tobytes()
                            else:
                                ctx = b" ".join(data[begin[f] : end[e + window - 1]].tobytes().split())
                            k = xxhash.xxh3_128_intdigest(ctx)
                            at = [d[lo + r], t1[lo + r], f + moved, e + window - f, 0, 1]
                            if once and k in seen:
                                add(out, [None, None, None, *at, None])
                            else:
                                if once:
                                    seen.add(k)
                                add(out, [a, _signed(k >> 64), _signed(k & _LOW), *at, ctx])
                        if len(out) >= ROWS:
                            yield flush(out)
                            out = []
                if out:
                    yield flush(out)

    return run


def _windows(kind: str, window: int):
    """The windows of a context as contexts of their own: a shard key, the context's hash, the first place, the offset, the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c1, c2, fd, fp, ctx in zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "fd", "fp", "ctx")), strict=True):
                units = ctx if kind == "byte" else ctx.split(b" ")
                n = len(units) - window + 1
                own = [units[i : i + window] if kind == "byte" else b" ".join(units[i : i + window]) for i in range(n)]
                same = lambda v: pa.array([v] * n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_signed(xxhash.xxh3_64_intdigest(w)) for w in own], pa.int64()),
                        *(same(v) for v in (c1, c2, fd)),
                        pa.array(range(fp, fp + n), pa.int64()),
                        pa.array(range(n), pa.int64()),
                        pa.array(own, pa.binary()),
                    ],
                    ["a", "c1", "c2", "fd", "fp", "off", "ctx"],
                )

    return run


_LOW = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(compare: Callable[[list[bytes], np.ndarray, np.ndarray], list[list[tuple[int, int]]]]):
    """Cut a partition's contexts, sorted by anchor, into shards; give each to `compare` with the first occurrences.

    compare gets the contexts that share their anchor with another, and returns for each the parts (first unit, end
    unit) whose windows occur earlier in another context.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        shared = [i for i in range(n) if (i and rows[i][0] == rows[i - 1][0]) or (i + 1 < n and rows[i][0] == rows[i + 1][0])]
        spans: list[list] = []
        if shared:
            spans = compare(
                [rows[i][5] for i in shared], np.array([rows[i][3] for i in shared]), np.array([rows[i][4] for i in shared])
            )
        found = [(rows[i], s) for i, s in zip(shared, spans, strict=True) if s]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[1] for r, _ in found], pa.int64()),
                pa.array([r[2] for r, _ in found], pa.int64()),
                pa.array([[{"s": a + r[6], "e": b + r[6]} for a, b in s] for r, s in found], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
            ],
            ["c1", "c2", "parts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "c1", "c2", "fd", "fp", "ctx", "off")), strict=True):
                if len(rows) >= SHARD and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield flush(rows)

    return run


def _cut(kind: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, texts = [], [], [], []
            parts, whole = batch.column("parts"), batch.column("whole").to_pylist()
            for i, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                raw = raw or b""
                units = raw if kind == "byte" else raw.split()
                size = len(units)
                if whole[i] and size >= window:
                    cuts = [(0, size)]
                else:
                    cuts = merged(parts[i].as_py() or ())
                kept, at = [], 0
                for s, e in cuts:
                    kept.append(units[at:s])
                    at = e
                kept.append(units[at:])
                texts.append(b"".join(kept) if kind == "byte" else b" ".join(w for k in kept for w in k))
                n.append(size)
                removed.append(sum(e - s for s, e in cuts))
                spans.append([{"s": s, "e": e} for s, e in cuts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
                ["doc_id", "kept", "n", "n_removed", "spans"],
            )

    return run


def merged(parts) -> list[tuple[int, int]]:
    """Spans as maximal ones, in order; spans that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted((p["s"], p["e"]) for p in parts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_recurring(
    docs: DataFrame, kind: str, window: int, gram: int, compare, same_document: bool, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cut every unit that a recurring window covers: doc_id, kept (binary), n, n_removed, spans of units removed."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), *text_hash(F.col("text")), "text")
    survey = table(
        keyed.select("d", "t1", "t2", "text").mapInArrow(
            _survey(kind, window, gram, 2 if same_document else 1), "d long, t1 long, t2 long, anchors array<long>"
        ),
        "survey",
    )
    copies = table(
        survey.groupBy("t1", "t2").agg(F.min("d").alias("rep"), F.max("d").alias("top")).where("top > rep").drop("top"), "copies"
    )
    known = survey.join(beside(copies), ["t1", "t2"], "left").withColumn("copy", F.coalesce(F.col("d") > F.col("rep"), F.lit(False)))
    later = table(known.where("copy").select("d", "t1").distinct(), "later")
    live = known.where(~F.col("copy")).select("d", "t1", F.explode("anchors").alias("a"))
    again = table(live.groupBy("a").agg(F.count("*").alias("times")).where("times > 1").select("a"), "anchors")
    cand = table(live.join(beside(again), "a").groupBy("d", "t1").agg(F.collect_set("a").alias("cand")), "candidates")
    drop(survey)
    found = keyed.join(beside(cand), ["d", "t1"]).select("d", "t1", "text", "cand")
    found = table(found.mapInArrow(_contexts(kind, window, gram, same_document), _CONTEXT), "contexts")
    drop(cand)
    met = found.where("c1 is not null").groupBy("c1", "c2").agg(
        F.min(F.struct("d", "pos")).alias("f"), F.first("a").alias("a"), F.first("ctx").alias("ctx"), F.count("*").alias("times")
    )
    met = table(met.select("a", "c1", "c2", F.col("f.d").alias("fd"), F.col("f.pos").alias("fp"), "ctx", "times"), "distinct")
    crowd = table(met.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    shared = met.join(beside(crowd), "a").select("a", "c1", "c2", "fd", "fp", F.lit(0).cast("long").alias("off"), "ctx", "n")
    alone = shared.where(F.col("n") > CROWD).select("c1", "c2", "fd", "fp", "ctx")
    alone = alone.mapInArrow(_windows(kind, window), "a long, c1 long, c2 long, fd long, fp long, off long, ctx binary")
    dealt = shared.where(F.col("n") <= CROWD).drop("n").unionByName(alone).repartition("a").sortWithinPartitions("a", "c1", "c2", "off")
    hits = dealt.mapInArrow(shards(compare), f"c1 long, c2 long, parts {_PARTS}")
    hits = table(hits.groupBy("c1", "c2").agg(F.flatten(F.collect_list("parts")).alias("parts")), "hits")
    # of a context only its later occurrences, and a first one with parts, are cut
    told = met.select("c1", "c2", "fd", "fp", "times").join(beside(hits), ["c1", "c2"], "left").where("times > 1 or parts is not null")
    told = table(told, "told")
    total = told.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    often = F.col("times") >= max(2.0, COMMON * total)
    first = (F.col("d") == F.col("fd")) & ((F.col("pos") == F.col("fp")) if same_document else F.lit(True))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.col("pos") + k * F.col("step"))
    whole = F.when(F.col("step") <= F.col("len"), F.array(F.struct(F.col("pos").alias("s"), (F.col("pos") + F.col("step") * (F.col("n") - 1) + F.col("len")).alias("e"))))
    whole = whole.otherwise(F.transform(places, lambda x: F.struct(x.alias("s"), (x + F.col("len")).alias("e"))))
    moved = F.flatten(F.transform(places, lambda x: F.transform("parts", lambda p: F.struct((p["s"] + x).alias("s"), (p["e"] + x).alias("e")))))
    placed = found.withColumnRenamed("times", "n").drop("a", "ctx")
    keyed_rows = placed.where("c1 is not null")
    # spans of very common contexts meet them without a shuffle; there are at most 1 / COMMON of those
    hot = F.broadcast(told.where(often))
    spans = keyed_rows.join(hot, ["c1", "c2"]).unionByName(keyed_rows.join(hot.select("c1", "c2"), ["c1", "c2"], "left_anti").join(beside(told.where(~often)), ["c1", "c2"]))
    spans = spans.select("d", "t1", F.explode(F.when(first, moved).otherwise(whole)).alias("p"))
    spans = spans.unionByName(placed.where("c1 is null").select("d", "t1", whole[0].alias("p")))
    cuts = spans.groupBy("d", "t1").agg(F.collect_list("p").alias("parts"), F.lit(False).alias("whole"))
    gone = later.select("d", "t1", F.lit(None).cast(_PARTS).alias("parts"), F.lit(True).alias("whole"))
    cuts = table(cuts.unionByName(gone), "cuts")
    drop(found, met, crowd, hits, told, copies, later, again)
    joined = keyed.join(beside(cuts), ["d", "t1"], "left").select("doc_id", "text", "parts", "whole")
    return joined.mapInArrow(_cut(kind, window), f"doc_id {dict(docs.dtypes)[id_col]}, kept binary, n long, n_removed long, spans {_PARTS}")
