"""Suffix-array dedup by prefix-free parsing, over bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _bytes as B
from folioscope.llm._recurrence import remove_recurring

WINDOW = 100
#: Bytes of an anchor: strings of WINDOW bytes are looked for around byte strings of this length that recur.
GRAM = 40
#: Bytes of a trigger, and one in how many byte strings is one.
TRIGGER, MODULUS = 8, 24


def triggers(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where phrases begin: at each text's first byte and wherever the rolling hash of TRIGGER bytes is 0 modulo MODULUS."""
    h = B.byte_grams(data, TRIGGER)
    hit = np.zeros(len(data), dtype=bool)
    hit[: len(h)] = h % np.uint64(MODULUS) == 0
    room = np.zeros(len(data) + 1, dtype=np.int64)
    # a trigger lies within one text and leaves more than itself
    np.add.at(room, begin, 1)
    np.add.at(room, np.maximum(end - TRIGGER, begin), -1)
    hit &= np.cumsum(room)[:-1] > 0
    hit[begin] = True
    return np.flatnonzero(hit)


def _places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys; in that order, where each one's run of equal keys begins; and whether it is alone in it."""
    order = np.argsort(key)
    s = key[order]
    new = np.ones(len(s) + 1, dtype=bool)
    new[1:-1] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    size = np.diff(at)
    return order, np.repeat(at[:-1], size), np.repeat(size == 1, size)


def _doubled(key: np.ndarray, left: np.ndarray, have: int, depth: int) -> np.ndarray:
    """Ranks of suffixes by `depth` symbols at least, from keys that order them by `have`; left: how many symbols each has.

    A suffix that ends sorts first.  A rank is the number of smaller suffixes, so that a run of equal ones is refined
    within its own ranks: each round sorts only those that are not alone and go on, by what stands `have` symbols further.
    """
    n = len(key)
    order, begin, alone = _places(key)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = begin
    # where one of a run has ended before `have`, all have, and are equal
    open_ = order[~alone]
    open_ = open_[left[open_] >= have]
    while have < depth and len(open_):
        goes = left[open_] > have
        right = np.zeros(len(open_), dtype=np.int64)
        right[goes] = rank[open_[goes] + have] + 1
        old = rank[open_]
        order, begin, alone = _places(old * (n + 1) + right)
        old, at = old[order], open_[order]
        whole = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        rank[at] = old + begin - np.repeat(whole, np.diff(np.append(whole, len(old))))
        have *= 2
        at = at[~alone]
        open_ = at[left[at] >= have]
    return rank


def dictionary_suffixes(data: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes of the dictionary's phrases by `depth` bytes, each of which ends with its phrase (left: bytes to there)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    n = len(data)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(7):
        byte = np.where(left > j, padded[j : j + n].astype(np.uint64) + np.uint64(1), np.uint64(0))
        key = key * np.uint64(257) + byte
    return _doubled(key, left, 7, depth)


def parse_suffixes(parse: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of the parse, in which each text ends on its own (left: phrases to there)."""
    return _doubled(parse, left, 1, len(parse))


def corpus_order(contexts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and numbers that order all their suffixes by `depth` bytes at least, from a prefix-free parse.

    Triggers cut the texts into phrases that overlap by the trigger that ends one and begins the next.  The dictionary is
    the sorted set of distinct phrases, the parse the sequence of their numbers.  Since no phrase holds a trigger but at
    its ends, the rest of a phrase from a position on, if it is longer than a trigger, begins no other such rest; so the
    order of two suffixes is that of their phrases' rests in the suffix array of the dictionary and, where these are
    equal, that of what follows in the suffix array of the parse.
    """
    size = np.array([len(c) for c in contexts])
    end = np.cumsum(size)
    begin = end - size
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    at = triggers(data, begin, end)
    of = np.searchsorted(begin, at, side="right") - 1
    final = np.append(of[1:] != of[:-1], True)
    stop = np.where(final, end[of], np.append(at[1:], 0) + TRIGGER)
    raw = data.tobytes()
    phrases = [raw[s:e] for s, e in zip(at.tolist(), stop.tolist(), strict=True)]
    # the last phrase of a text ends with it: a mark keeps it apart from a phrase that goes on
    phrases = [p + b"\0" if f else p + b"\1" for p, f in zip(phrases, final.tolist(), strict=True)]
    words = sorted(set(phrases))
    number = {p: k for k, p in enumerate(words)}
    parse = np.array([number[p] for p in phrases])
    length = np.array([len(p) for p in words])
    base = np.cumsum(length) - length
    left = np.repeat(length, length) - (np.arange(length.sum()) - np.repeat(base, length))
    rest = dictionary_suffixes(np.frombuffer(b"".join(words), dtype=np.uint8), left, depth)
    last = np.searchsorted(of, of, side="right")
    after = parse_suffixes(parse, last - np.arange(len(parse)))
    # of each byte: the phrase it lies in before that phrase's closing trigger, and its place there
    owner = np.searchsorted(at, np.arange(len(data)), side="right") - 1
    alpha = rest[base[parse[owner]] + np.arange(len(data)) - at[owner]]
    following = np.where(final, 0, np.append(after[1:], 0) + 1)[owner]
    return data, alpha * (len(parse) + 2) + following


def _suffixes(window: int):
    def compare(contexts: list[bytes], doc: np.ndarray, pos: np.ndarray) -> list[list[tuple[int, int]]]:
        """In corpus order the strings of `window` bytes that are equal are neighbours; the first start is kept."""
        data, number = corpus_order(contexts, window)
        size = np.array([len(c) for c in contexts])
        base = np.cumsum(size) - size
        count = size - window + 1
        of = np.repeat(np.arange(len(contexts)), count)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        start = base[of] + offset
        order = np.argsort(number[start])
        # neighbours with `window` bytes in common, by two rolling hashes
        s = start[order]
        same = np.zeros(len(s) + 1, dtype=bool)
        both = [B.byte_grams(data, window, k) for k in (0, 1)]
        same[1:-1] = (both[0][s[1:]] == both[0][s[:-1]]) & (both[1][s[1:]] == both[1][s[:-1]])
        several = same[:-1] | same[1:]
        group, at = np.cumsum(~same[:-1])[several], order[several]
        by = np.lexsort((pos[of[at]] + offset[at], doc[of[at]], group))
        later = np.zeros(len(of), dtype=bool)
        later[at[by[1:]]] = group[by[1:]] == group[by[:-1]]
        out: list[list[tuple[int, int]]] = [[] for _ in contexts]
        hit = np.flatnonzero(later)
        if len(hit):
            new = np.ones(len(hit), dtype=bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])
            at = np.flatnonzero(new)
            for s, e in zip(hit[at].tolist(), hit[np.append(at[1:], len(hit)) - 1].tolist(), strict=True):
                out[of[s]].append((int(offset[s]), int(offset[e]) + window))
        return out

    return compare


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a string of `window` bytes that also starts earlier (smaller id, or same id before).

    Strings that may recur are found around recurring anchors and dealt to shards by them (see ``_recurrence``), so that
    equal strings meet.  A shard's texts are parsed prefix-free; the suffix arrays of its dictionary and of its parse
    together give the order of all its suffixes (see `corpus_order`), in which equal strings are neighbours.  Of each the
    first start in the corpus is kept.  A piece of text that occurs several times is parsed once: all its later
    occurrences go.  Highly repetitive text costs what its distinct pieces cost.

    Returns doc_id, kept (binary), n, n_removed, spans (maximal, of bytes removed).  Strings never cross texts and
    are judged on the input.  A null text is empty; one shorter than the window keeps all; a null id sorts last;
    rows that repeat an id and its text are one document.
    """
    return remove_recurring(docs, "byte", window, gram, _suffixes(window), same_document=True, id_col=id_col, text_col=text_col)


def op8_suffix(spark, sf_dir):
    """All documents, strings of 100 bytes."""
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", F.col("n").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
