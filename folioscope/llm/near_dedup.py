"""MinHash near-dedup with Order MinHash over word shingles, verified by banded alignment."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _bytes as B
from folioscope.llm._blocks import dealt, grouped
from folioscope.llm._common import NO_ID, at_hand, beside, components, table, text_hash

SHINGLE = 5
SIMILARITY = 0.8
#: Minimum k-mers of a sketch, and sketches of a text.  Two texts at the threshold share a sketch with probability
#: about 0.8 ** PICKED = 0.33, so they share none of all sketches with probability 7e-5.
PICKED, SKETCHES = 5, 24
#: Up to this many k-mers a text also offers single ones as keys, enough of them to meet every text that it can link with.
SHORT = 25
#: Bins of a text's profile.
BINS = 256
#: Rounds in which a node offers only its nearest candidate of a bucket, before the one with all candidates.
NEAREST_ROUNDS = 2
#: Texts of a bucket that meet in one task, from each of two blocks.
BLOCK = 1024

_RNG = np.random.Generator(np.random.PCG64(77))
_ORDER = _RNG.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = B.mix(_RNG.integers(0, 1 << 63, SKETCHES, dtype=np.uint64))
_OCC = np.uint64(0x9E3779B97F4A7C15)


def labelled_kmers(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's k-mers of words, each mixed with its occurrence number; a shorter text is one k-mer."""
    if not len(words):
        return words
    h = B.gram_hashes(words, k) if len(words) >= k else B.gram_hashes(words, len(words))
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    occ = np.empty(len(s), dtype=np.uint64)
    occ[order] = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
    return B.mix(h + occ * _OCC)


def sketches(kmers: np.ndarray) -> np.ndarray:
    """Order MinHash: for each of SKETCHES orders, the PICKED least k-mers, in text order, as one hash."""
    rank = kmers[None, :] * _ORDER[:, None]
    if len(kmers) > PICKED:
        at = np.sort(np.argpartition(rank, PICKED - 1, axis=1)[:, :PICKED], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(kmers)), rank.shape)
    out = _SALT.copy()
    for j in range(at.shape[1]):
        out = out * np.uint64(0xD6E8FEB86659FD93) + kmers[at[:, j]]
    return B.mix(out)


def short_keys(kmers: np.ndarray) -> np.ndarray:
    """The least k-mers of a text of up to SHORT of them, as keys; none for a longer one.

    Linked texts have at least SIMILARITY of either's k-mers in common.  The least of the common ones is preceded, in
    either text, by its other k-mers only, so it is among the least of both.
    """
    n = len(kmers)
    if n > SHORT:
        return kmers[:0]
    return B.mix(np.sort(kmers)[: n - math.ceil(SIMILARITY * n - 1e-9) + 1] ^ _OCC)


def profile(kmers: np.ndarray) -> np.ndarray:
    """Counts of k-mers in BINS bins.  Profiles differ by no more than the k-mers do, so they rule pairs out for sure."""
    return np.minimum(np.bincount((kmers >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two texts: m / (len(a) + len(b) - m), with m k-mers aligned in order; 0 if it is below `least`.

    Labelled k-mers occur once in a text, so the best alignment is the longest ascending chain of common ones.  One
    that reaches `least` leaves out at most `band` k-mers of both together, and never strays further off the diagonal.
    """
    total = len(a) + len(b)
    band = int(total * (1 - least) / (1 + least) + 1e-9)
    if not total or abs(len(a) - len(b)) > band:
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    j = order[at]
    i = np.flatnonzero((b[j] == a) & (np.abs(j - np.arange(len(a))) <= band))
    if total - 2 * len(i) > band:
        return 0.0
    ends: list[int] = []
    for y in j[i].tolist():
        k = bisect_left(ends, y)
        if k == len(ends):
            ends.append(y)
        else:
            ends[k] = y
    sim = len(ends) / (total - len(ends))
    return sim if sim >= least - 1e-12 else 0.0


def _lowered_words(data: np.ndarray, at: np.ndarray):
    data = B.LOWER[data]
    begin, end, first = B.words(data, at)
    return data, begin, end, first


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in B.blocks(batch.column("text")):
            data, begin, end, first = _lowered_words(data, at)
            h, g = B.word_hashes(data, begin, end), B.word_hashes(data, begin, end, 1)
            cols: list[list] = [[] for _ in range(5)]
            for r in range(hi - lo):
                own = slice(first[r], first[r + 1])
                kmers = labelled_kmers(h[own])
                if not len(kmers):
                    row = (0, 0, 0, [], b"")
                else:
                    c1, c2 = _fold(h[own], 0), _fold(g[own], 1)
                    row = (len(kmers), int(c1[0].view(np.int64)), int(c2[0].view(np.int64)), np.concatenate([sketches(kmers), short_keys(kmers)]).view(np.int64), profile(kmers).tobytes())
                for to, v in zip(cols, row, strict=True):
                    to.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(lo, hi - lo) for c in ("d", "t1")] + [pa.array(v, t) for v, t in zip(cols, kinds, strict=True)],
                ["d", "t1", "n", "node", "c2", "keys", "profile"],
            )


def _fold(h: np.ndarray, which: int) -> np.ndarray:
    """A hash of a whole sequence, as an array of one."""
    power = np.full(len(h), B._MULT[which], dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    return B.mix(np.array([(h * power).sum() + np.uint64(len(h))], dtype=np.uint64))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in B.blocks(batch.column("text")):
            data, begin, end, first = _lowered_words(data, at)
            h = B.word_hashes(data, begin, end)
            seq = [labelled_kmers(h[first[r] : first[r + 1]]).tobytes() for r in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array(seq, pa.binary())], ["node", "seq"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sim = [
            aligned(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
        ]
        keep = pa.array([s > 0 for s in sim])
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _excess(na, pa_, nb, pb):
    """How far texts with these numbers of k-mers and profiles are from what a link allows; above 0 they cannot link."""
    band = (na + nb) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9
    return np.abs(pa_.astype(np.int16) - pb.astype(np.int16)).sum(axis=-1) - band


def _leader_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        p = np.frombuffer(b"".join(batch.column("profile").to_pylist()), np.uint8).reshape(-1, BINS)
        q = np.frombuffer(b"".join(batch.column("lprofile").to_pylist()), np.uint8).reshape(-1, BINS)
        ok = pa.array(_excess(batch.column("n").to_numpy(), p, batch.column("ln").to_numpy(), q) <= 0)
        yield pa.RecordBatch.from_arrays([batch.column("lead").filter(ok), batch.column("node").filter(ok)], ["a", "b"])


def _block_pairs(nearest: bool):
    def compare(rows: pa.Table) -> pa.Table | None:
        """Pairs of a bucket's block pair that are not known to be connected and can reach the threshold.

        nearest: of each node only the one that its profile is nearest to.
        """
        node, n, comp = (rows.column(c).to_numpy() for c in ("node", "n", "comp"))
        prof = np.frombuffer(b"".join(rows.column("profile").to_pylist()), np.uint8).reshape(-1, BINS)
        side, p1, p2 = (rows.column(c).to_numpy() for c in ("side", "p1", "p2"))
        within = p1[0] == p2[0]
        left = np.flatnonzero(side == p1[0])
        right = left if within else np.flatnonzero(side == p2[0])
        a, b = [], []
        for k, i in enumerate(left.tolist()):
            others = right[k + 1 :] if within and not nearest else right
            others = others[comp[others] != comp[i]]
            if len(others):
                over = _excess(n[i], prof[i], n[others], prof[others])
                if nearest:
                    best = int(np.argmin(over))
                    others, over = others[best : best + 1], over[best : best + 1]
                others = others[over <= 0]
                a.append(np.minimum(node[i], node[others]))
                b.append(np.maximum(node[i], node[others]))
        if not a:
            return None
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return compare


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs as doc_id, class_id: the smallest id among documents linked with it directly or through others.

    Two documents are linked if their k-mers (SHINGLE words, A-Z in lower case) align in order with a similarity of
    SIMILARITY or more (see `aligned`).  Texts with the same words are one node.  Candidates share an Order MinHash
    sketch: the least of several random orders' k-mers, labelled by occurrence and kept in text order, so that texts
    match by edits and not merely by content.  Texts of up to SHORT k-mers have too few for that to be reliable; they
    also share single k-mers (see `short_keys`), by which none of their links is missed.  In a first round each bucket's members are compared with its least
    node, which connects dense groups at a cost in proportion to their size.  In a second round all pairs of a bucket
    that are not connected yet are looked at, in blocks, and those whose profiles allow a link are aligned too.  So no
    bucket is capped and links inside a connected group are the only ones left out, which changes no class.

    A text without words (null, empty, blank) is linked with nothing; a text of fewer than SHINGLE words is one k-mer.
    A null id sorts last.  Rows that repeat an id each get the class of their own text.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), text_hash(F.col("text"))[0], "text")
    sketched = table(
        keyed.select("d", "t1", "text").mapInArrow(_sketch, "d long, t1 long, n long, node long, c2 long, keys array<long>, profile binary"),
        "sketches",
    )
    classes = sketched.where("n > 0").groupBy("node", "c2").agg(
        F.min(F.struct("d", "t1")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("profile").alias("profile")
    )
    # two classes with one `node` differ in c2; the sum tells them apart and is unique but for chance in 2 ** 64
    classes = table(classes.select((F.col("node").bitwiseXOR(F.xxhash64("c2"))).alias("node"), F.col("rep.d").alias("d"), F.col("rep.t1").alias("t1"), "n", "keys", "profile"), "classes")
    keys = classes.select("node", F.explode("keys").alias("key"))
    several = table(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    member = classes.select("node", "n", "profile", F.explode("keys").alias("key")).join(beside(several), "key")
    member = table(member, "members")
    lead = member.groupBy("key").agg(F.min(F.struct("node", "n", "profile")).alias("l"))
    lead = lead.select("key", F.col("l.node").alias("lead"), F.col("l.n").alias("ln"), F.col("l.profile").alias("lprofile"))
    lead = table(lead, "leaders")
    pairs = member.join(beside(lead), "key").where("node <> lead").select("lead", "ln", "lprofile", "node", "n", "profile").distinct()
    links = _links(pairs.mapInArrow(_leader_pairs, "a long, b long").distinct(), classes, keyed)
    none = classes.sparkSession.createDataFrame([], "a long, b long")
    joined = table(components(none if links is None else links).withColumnsRenamed({"node": "x", "component": "c"}), "joined")
    left = [True] * NEAREST_ROUNDS + [False]
    while left:
        nearest = left.pop(0)
        rows = member.join(at_hand(joined), F.col("node") == F.col("x"), "left")
        rows = rows.select("key", "size", "node", "n", "profile", F.coalesce("c", "node").alias("comp"))
        mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        rows = dealt(rows.join(beside(mixed), "key", "left_semi"), ["key"], "node", BLOCK)
        found = grouped(rows, ["key", "p1", "p2"], _block_pairs(nearest), "a long, b long").distinct()
        links = _links(found, classes, keyed)
        if links is None:
            # nothing has changed, so another round of this kind would look at the same pairs
            left = [r for r in left if r != nearest]
            continue
        # what is known of the components goes on as stars
        links = joined.select(F.col("x").alias("a"), F.col("c").alias("b")).union(links)
        joined = table(components(links).withColumnsRenamed({"node": "x", "component": "c"}), "joined")
    joined = joined.withColumnsRenamed({"x": "node", "c": "component"})
    named = classes.select("node", "d").join(joined, "node", "left").select("d", "node", F.coalesce("component", "node").alias("component"))
    best = named.groupBy("component").agg(F.min("d").alias("best"))
    named = table(named.join(best, "component").where("best < d or component <> node").select("node", "best"), "named")
    # rows with their class; texts that stand alone keep the least id of their copies
    reps = classes.select("node", F.col("d").alias("rep"))
    told = sketched.select("d", "t1", F.when(F.col("n") > 0, F.col("node").bitwiseXOR(F.xxhash64("c2"))).alias("node"))
    told = told.join(reps, "node", "left").join(beside(named), "node", "left")
    best = F.coalesce("best", "rep", "d")
    kind = dict(docs.dtypes)[id_col]
    out = told.select(
        F.when(F.col("d") != NO_ID, F.col("d")).cast(kind).alias("doc_id"), F.when(best != NO_ID, best).cast(kind).alias("class_id")
    )
    return out


def _links(pairs: DataFrame, classes: DataFrame, keyed: DataFrame) -> DataFrame | None:
    """The pairs of nodes whose texts align; None for no pairs or no such."""
    pairs = table(pairs, "pairs")
    if pairs.isEmpty():
        return None
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # few nodes go to the texts, not all texts to the nodes
    need = table(classes.select("node", "d", "t1").join(at_hand(table(nodes, "nodes")), "node"), "needed")
    texts = keyed.join(at_hand(need), ["d", "t1"]).select("node", "text")
    seqs = table(texts.mapInArrow(_sequences, "node long, seq binary").dropDuplicates(["node"]), "sequences")
    seqs = at_hand(seqs)
    one, two = seqs.toDF("a", "sa"), seqs.toDF("b", "sb")
    links = table(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long"), "links")
    return None if links.isEmpty() else links


def op7_near(spark, sf_dir):
    """All documents, shingles of five words, similarity 0.8."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
