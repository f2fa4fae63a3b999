"""Language-model scoring with a probabilistic suffix tree over words, kept in tables that grow with the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _bytes as B
from folioscope.llm import _packs as P
from folioscope.llm._common import beside, checked, drop, table

#: Words of the longest contexts.
DEPTH = 3
#: Occurrences that a context needs to be considered, and that a symbol needs after it to have a probability of its own.
CONTEXT, ENTRY = 8, 2
#: What is taken off each count and left to the shorter context.
DISCOUNT = 0.6
#: What makes up this share of all training tokens is sent to every task: at most 1 / HEAVY words, and as many states and
#: entries of each length.  All else, which grows with the corpus, meets the tokens by a join.
HEAVY = 4e-6
#: Shares in which rows are scored, one after the other.
ROUNDS = 3
#: Bits of a filter that spares a join what it knows nothing of: 2 ** 16 to 2 ** MOST_BITS.
MOST_BITS = 27
#: Tokens that a task works on at once when it counts, and when it scores.
TOKENS, SCORED = 1_000_000, 300_000

_U = np.uint64
_END = _U(0xE19D5C1C3B5A0D27)
_ROOT, _NEXT = _U(0x243F6A8885A308D3), _U(0x9E3779B97F4A7C15)
_AFTER = 0xA0761D6478BD642F
_BEFORE = _U(pow(_AFTER, -1, 1 << 64))


def longer(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of the state whose words are those of `state` and, before them, `word`."""
    return B.mix(state * _U(0xD6E8FEB86659FD93) + word)


def entry(state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The key of a symbol after a state."""
    return B.mix((state ^ _NEXT) * _U(_AFTER) + symbol)


def state_of(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The state whose `entry` with a symbol has this key."""
    return (B.unmix(key) - symbol) * _BEFORE ^ _NEXT


def _token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of rows of text, and how many each row has."""
    data = B.LOWER[data]
    begin, end, first = B.words(data, at)
    return np.insert(B.word_hashes(data, begin, end), first[1:], _END), np.diff(first) + 1


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as rows (rid, doc_id, tokens), stored: all later passes read hashes of tokens instead of text.

    Tokens are words (runs without ASCII white space, A-Z in lower case), then one end of text; tokens is the sequence of
    their 64-bit hashes, eight bytes each.  A null text is empty; a null id stays null; rid numbers the rows.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in B.blocks(batch.column("text")):
                h, size = _token_hashes(data, at)
                cut = np.append(0, np.cumsum(size)) * 8
                packed = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(lo, hi - lo), batch.column("doc_id").slice(lo, hi - lo), packed.cast(pa.binary())], ["rid", "doc_id", "tokens"])

    return table(rows.mapInArrow(run, f"rid long, doc_id {kind}, tokens binary"), "tokens")


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` tokens: the rows, token hashes, each one's place in its row, each row's size.

    A longer row comes alone.
    """
    for batch in batches:
        for lo, hi, data, at in B.blocks(batch.column("tokens"), most * 8):
            size = np.diff(at) // 8
            h = np.frombuffer(data.tobytes(), dtype=np.uint64)
            yield batch.slice(lo, hi - lo), h, np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size), size


def contexts(h: np.ndarray, place: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """For k = 1, 2, ... depth: the key of the k words before each token; 0 where the text has fewer before it."""
    state = np.full(len(h), _ROOT)
    for k in range(1, depth + 1):
        older = np.zeros(len(h), dtype=np.uint64)
        older[k:] = h[:-k]
        state = np.where(place >= k, longer(state, older), _U(0))
        yield state


class Filter:
    """A set of keys in which every member is found, and few others."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, key: np.ndarray) -> np.ndarray:
        place = key >> _U(64 - self.bits)
        return (self.words[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)


def _filter(keys: DataFrame, rows: int) -> Filter:
    """A filter of the column `key`: bits are set by an aggregate, at most 2 ** (MOST_BITS - 6) rows reach the driver."""
    bits = min(max(16, int(16 * max(rows, 1)).bit_length()), MOST_BITS)
    place = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("p"))
    word = place.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    got = word.toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return Filter(out, bits)


class Heavy:
    """Keys with a value each; a table of where the keys with the same first bits begin makes looking up fast."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = _U(64 - max(4, len(keys).bit_length() + 2))
        slot = (self.keys >> self.shift).astype(np.int64)
        self.begin = np.searchsorted(slot, np.arange((1 << int(64 - self.shift)) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.begin).max(initial=0))

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are here, and the values of those."""
        if not len(self.keys):
            return np.zeros(len(key), dtype=bool), np.zeros(0)
        at = self.begin[(key >> self.shift).astype(np.int64)].astype(np.int64)
        found = np.full(len(key), -1)
        for j in range(self.deepest):
            here = np.minimum(at + j, len(self.keys) - 1)
            found = np.where(self.keys[here] == key, here, found)
        ok = found >= 0
        return ok, self.values[found[ok]]


def _heavy(rows: DataFrame, value: str) -> Heavy:
    got = rows.select("key", value).toArrow()
    return Heavy(got["key"].to_numpy().view(np.uint64), got[value].to_numpy().astype(np.float64))


@dataclass
class Tree:
    """n, v: training tokens and kinds.  states, entries: the kept tree by length, as tables.

    states: key, parent, c, beta; entries: state, symbol, n, v.  values: keys and values of all that scoring adds up (see
    `score`), less what is heavy, in packs.
    """

    n: int
    v: int
    states: list[DataFrame]
    entries: list[DataFrame]
    values: DataFrame
    heavy_words: Heavy
    heavy: Heavy
    known: Filter
    buckets: int


def _counted(tokens: DataFrame, keys, told, kinds: int, many: int, least: int, schema: str) -> DataFrame:
    """Counts of what `keys` finds in a block of tokens, of at least `least`: what `told` tells of it, and n.

    keys(h, place) gives `kinds` columns: first the hashes that are counted, in whose order packs are laid out, then what
    else told(*columns) needs.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, place, _ in _blocks(batches, TOKENS):
            key, *more = keys(h, place)
            if len(key):
                at, n = P.summed(key, np.ones(len(key), dtype=np.int64))
                yield P.in_order(key[at], [*(c[at] for c in more), n], many)

    def meet(packs: dict[int, list[bytes]]) -> pa.RecordBatch:
        *cols, n = P.columns(packs[0], (*(np.uint64,) * kinds, np.int64))
        at, n = P.summed(cols[0], n)
        at, n = at[n >= least], n[n >= least]
        cols = told(*(c[at] for c in cols))
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols] + [pa.array(n)], [f.split()[0] for f in schema.split(", ")])

    return P.gathered(tokens.mapInArrow(count, P.SCHEMA), meet, schema)


def train(tokens: DataFrame, depth: int = DEPTH) -> Tree:
    """The suffix tree of the training texts, given as `tokenize` returns them.

    A context of k words is considered if it occurs CONTEXT times; the symbols seen ENTRY times after it have
    probabilities of their own: p = (n - DISCOUNT) / c + beta * lower, where lower is that after the context without its
    oldest word, and beta the mass that is left, which all other symbols share as they do there.  At the root a token
    has (c + 1) / (N + V + 1).  A context is kept if its distribution diverges from the shorter one's (their
    Kullback-Leibler divergence times its count exceeds what stating its probabilities would cost, half the logarithm of
    N each), or if a longer one that ends in it is kept.  These are absolute counts: the tree grows with the corpus.
    """
    tokens = tokens.select("tokens")
    # the number of tokens decides how many buckets there are
    many = P.buckets(tokens.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0] // 8)
    words = table(_counted(tokens, lambda h, place: [h], lambda h: [h], 1, many, 1, "key long, c long"), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = int(_END.view(np.int64))
    lower = words.where(F.col("c") >= ENTRY).select(F.col("key").alias("symbol"), ((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("lower"))
    made = words.where((F.col("c") >= CONTEXT) & (F.col("key") != end))
    made = table(made.select("key", "c").mapInArrow(_first_states, _STATES), "states")
    states, entries = [], []
    # pairs are counted after words that may be contexts only
    seen = (None, _filter(made.select("key"), made.count()))
    for k in range(1, depth + 1):
        pairs = table(_counted(tokens, _pairs(k, *seen), lambda key, symbol: [state_of(key, symbol), symbol], 2, many, ENTRY, "state long, symbol long, n long"), "pairs")
        taken = pairs.groupBy("state").agg(F.sum(F.col("n") - DISCOUNT).alias("taken"))
        told = made.join(beside(taken), made["key"] == taken["state"]).drop("state")
        told = table(told.withColumn("beta", 1 - F.col("taken") / F.col("c")), "states")
        drop(made)
        rows = pairs.join(checked(told).select(F.col("key").alias("state"), "parent", "c", "beta"), "state")
        if k > 1:
            # what is seen after a context is seen after each shorter one, too
            up = entries[-1].select(F.col("state").alias("parent"), "symbol", F.col("p").alias("lower"))
            rows = rows.join(beside(up), ["parent", "symbol"])
        else:
            rows = rows.join(beside(lower), "symbol")
        p = (F.col("n") - DISCOUNT) / F.col("c") + F.col("beta") * F.col("lower")
        # v: what an entry adds to log10 of the probability, beside log10 beta and that after the shorter context
        full = table(rows.select("state", "symbol", "n", p.alias("p"), F.log10(p / F.col("lower") / F.col("beta")).alias("v")), "entries")
        sums = full.groupBy("state").agg(F.sum("p").alias("sp"), F.sum(F.col("p") * F.col("v")).alias("spv"), F.count("*").alias("m"))
        drop(pairs)
        met = told.join(beside(sums), told["key"] == sums["state"])
        rest = F.greatest(1 - F.col("sp"), F.lit(1e-12))
        below = F.greatest(1 - (F.col("sp") - F.col("taken") / F.col("c")) / F.col("beta"), F.lit(1e-12))
        gain = F.col("c") * (F.col("spv") * F.lit(float(np.log(10))) + F.col("sp") * F.log("beta") + rest * F.log(rest / below))
        cost = F.lit(0.5 * float(np.log(max(n, 2)))) * (1 + F.col("m"))
        states.append(table(met.select(*_STATE, "beta", (gain > cost).alias("diverges")), "states"))
        drop(told)
        entries.append(full)
        if k < depth:
            # a context and a symbol, seen often enough, are a context one word longer
            often = full.where((F.col("n") >= CONTEXT) & (F.col("symbol") != end)).select("state", "symbol", F.col("n").alias("c"))
            words_of = states[-1].select(F.col("key").alias("state"), *(f"w{i}" for i in range(1, k + 1)))
            grown = often.join(beside(words_of), "state").mapInArrow(_grown(k), _STATES)
            made = table(grown.join(beside(states[-1].select(F.col("key").alias("parent"))), "parent", "left_semi").select(_STATE), "states")
            after = full.select("state", "symbol").mapInArrow(_entry_keys, "key long")
            seen = (_filter(after, full.count()), _filter(made.select("key"), made.count()))
    return _kept(n, v, words, states, entries)


_STATE = ["key", "parent", "c", *(f"w{i}" for i in range(1, DEPTH + 1))]
_STATES = ", ".join(f"{c} long" for c in _STATE)


def _state_batch(key, parent, c, words) -> pa.RecordBatch:
    signed = lambda x: pa.array(x.view(np.int64))
    cols = [signed(w) for w in words] + [pa.nulls(len(key), pa.int64())] * (DEPTH - len(words))
    return pa.RecordBatch.from_arrays([signed(key), signed(parent), c, *cols], _STATE)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _first_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of one word, from (key, c)."""
    for batch in batches:
        w = _column(batch, "key")
        root = np.full(len(w), _ROOT)
        yield _state_batch(longer(root, w), root, batch.column("c"), [w])


def _grown(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A state's words w1 (the youngest) to wk and a symbol, seen c times, make the state symbol, w1, ... wk."""
        for batch in batches:
            words = [_column(batch, "symbol"), *(_column(batch, f"w{i}") for i in range(1, k + 1))]
            key = parent = np.full(batch.num_rows, _ROOT)
            for w in words:
                key, parent = longer(key, w), key
            yield _state_batch(key, parent, batch.column("c"), words)

    return run


def _entry_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(entry(_column(batch, "state"), _column(batch, "symbol")).view(np.int64))], ["key"])


def _pairs(k: int, follows: Filter | None, made: Filter):
    """Occurrences of a symbol after the k words before it, where the filters allow it: entry key and symbol.

    follows: entries of the contexts one word shorter; made: the contexts of k words.
    """

    def keys(h: np.ndarray, place: np.ndarray):
        shorter = state = None
        for here in contexts(h, place, k):
            shorter, state = state, here
        at = np.flatnonzero(place >= k)
        if follows is not None:
            at = at[follows.has(entry(shorter[at], h[at]))]
        at = at[made.has(state[at])]
        return [entry(state[at], h[at]), h[at]]

    return keys


def _kept(n: int, v: int, words: DataFrame, states: list[DataFrame], entries: list[DataFrame]) -> Tree:
    """Prune the tree, and lay out what scoring adds up."""
    need = None
    for k in range(len(states) - 1, -1, -1):
        s, e = states[k], entries[k]
        ok = s.where("diverges")
        if need is not None:
            ok = ok.unionByName(s.join(beside(need), s["key"] == need["parent"], "left_semi")).dropDuplicates(["key"])
        states[k] = table(ok.drop("diverges"), "kept")
        keys = table(states[k].select(F.col("key").alias("state")), "keys")
        entries[k] = table(e.join(checked(keys), "state", "left_semi").select("state", "symbol", "n", "v"), "kept")
        drop(s, e, keys)
        need = states[k].select(F.col("parent")).distinct()
    values = words.select("key", F.lit(0).alias("side"), F.log10(F.col("c") + 1.0).alias("v"), "c")
    for s, e in zip(states, entries, strict=True):
        values = values.unionByName(s.select("key", F.lit(1).alias("side"), F.log10("beta").alias("v"), "c"))
        more = e.select("state", "symbol", "v", "n").mapInArrow(_entry_values, "key long, side int, v double, c long")
        values = values.unionByName(more)
    values = table(values.select("key", "side", "v", (F.col("c") >= max(1.0, HEAVY * n)).alias("big")), "values")
    big = F.col("big")
    rows = values.count()
    known = _filter(values.select("key"), rows)
    # three numbers each; far fewer buckets than counting takes, so a text's keys meet in fewer and have fewer sums to bring back
    many = P.buckets(3 * rows)
    heavy = [_heavy(values.where(big & (F.col("side") == side)), "v") for side in (0, 1)]
    packed = table(values.where(~big).select("key", "side", "v").mapInArrow(_packed_values(many), P.SCHEMA), "packed")
    drop(words, values)
    return Tree(n, v, states, entries, packed, *heavy, known, many)


def _entry_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = entry(_column(batch, "state"), _column(batch, "symbol"))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.ones(len(key), np.int32)), batch.column("v"), batch.column("n")], ["key", "side", "v", "c"])


def _found(tree: Tree):
    """Packs: of side 1 the keys that are left for the join, of side 2 what the heavy part adds to each row.

    A block has one pack for each bucket, with all its keys in order, and one for its rows.
    """
    known, words, heavy, many, depth = tree.known, tree.heavy_words, tree.heavy, tree.buckets, len(tree.states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, place, size in _blocks(batches, SCORED):
            rid = rows.column("rid").to_numpy()
            row = np.repeat(np.arange(len(rid)), size)

            def look(key, at, table, rid=rid, row=row):
                """Sums and numbers of values per row of tokens `at`; keys that may be elsewhere go on.  None of those is common."""
                hit, v = table.find(key)
                here, key, of = row[at[hit]], key[~hit], row[at[~hit]]
                left.append((key, rid[of]))
                return np.bincount(here, v, len(rid)), np.bincount(here, minlength=len(rid))

            left: list[tuple[np.ndarray, np.ndarray]] = []
            at = np.flatnonzero(known.has(h))
            base, seen = look(h[at], at, words)
            model = base.copy()
            # a longer state is kept only with the shorter one, and has entries only of symbols that the shorter one has
            kept, follows = np.ones(len(h), dtype=bool), np.ones(len(h), dtype=bool)
            for k, state in enumerate(contexts(h, place, depth), 1):
                at = np.flatnonzero((place >= k) & kept)
                at = at[known.has(state[at])]
                kept[:] = False
                kept[at] = True
                model += look(state[at], at, heavy)[0]
                at = at[follows[at]]
                key = entry(state[at], h[at])
                ok = known.has(key)
                at, key = at[ok], key[ok]
                follows[:] = False
                follows[at] = True
                model += look(key, at, heavy)[0]
            key, of = (np.concatenate(c) for c in zip(*left, strict=True))
            if len(key):
                by = np.argsort(key)
                yield P.in_order(key[by], [of[by]], many, 1)
            together = np.repeat(B.mix(rid[:1].view(np.uint64)), len(rid))
            yield P.dealt(together, [rid, size.astype(np.int64), seen.astype(np.int64), base, model], many, 2)

    return run


def _packed_values(many: int):
    """The values of the join, in packs of side 0; a word's key carries 1 in its last column."""

    def deal(held: list[tuple]) -> pa.RecordBatch:
        key, v, side = (np.concatenate(c) for c in zip(*held, strict=True))
        return P.dealt(key, [key, v, 1 - side.astype(np.int64)], many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append((_column(batch, "key"), batch.column("v").to_numpy(), batch.column("side").to_numpy()))
            rows += batch.num_rows
            if rows >= TOKENS:
                yield deal(held)
                held, rows = [], 0
        if rows:
            yield deal(held)

    return run


def _together(packs: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The packs, in order, in runs of about `most` bytes."""
    held, size = [], 0
    for raw in packs:
        held.append(raw)
        size += len(raw)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


_SUMS = (np.int64, np.int64, np.int64, np.float64, np.float64)


def _joined(many: int):
    def meet(packs: dict[int, list[bytes]]) -> pa.RecordBatch | None:
        """What a bucket adds to rows, in packs dealt by row: rid, size, known, base, model.

        A row's size comes with its heavy part only.
        """
        out = [P.unpack(raw, _SUMS) for raw in packs.get(2, ())]
        if 0 in packs and 1 in packs:
            key, v, word = P.columns(packs[0], (np.uint64, np.float64, np.int64))
            order = np.argsort(key)
            key, v, word = key[order], v[order], word[order]
            for some in _together(packs[1]):
                # a pack's keys are in order, which spares most of the time that a search through a large table takes
                k, rid = P.columns(some, (np.uint64, np.int64))
                at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                ok = np.flatnonzero(key[at] == k)
                if not len(ok):
                    continue
                ok = ok[np.argsort(rid[ok])]
                at, rid = at[ok], rid[ok]
                first = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
                add = lambda x: np.add.reduceat(x, first)
                out.append([rid[first], np.zeros(len(first), np.int64), add(word[at]), add(v[at] * word[at]), add(v[at])])
        if not out:
            return None
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return P.dealt(B.mix(cols[0].view(np.uint64)), cols, many)

    return meet


def _summed_rows(packs: dict[int, list[bytes]]) -> pa.RecordBatch:
    """(rid, n_tokens, known, base, model) of the rows of a bucket."""
    rid, *cols = P.columns(packs[0], _SUMS)
    ids, of = np.unique(rid, return_inverse=True)
    size, known, base, model = (np.bincount(of, c, len(ids)) for c in cols)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, size.astype(np.int64), known.astype(np.int64), base, model)], ["rid", "n_tokens", "known", "base", "model"])


def score(tokens: DataFrame, tree: Tree) -> DataFrame:
    """Every row of `tokenize`: doc_id, n_tokens, n_known, train_tokens, base_score, score, for its whole text.

    score sums log10 P(token | longest kept context before it within the text); base_score is that of single words.
    Both are sums over a text's tokens of values by key: log10 (c + 1) of the token; for each kept context before it log10
    beta; and for each entry log10 (p / (beta * lower)).  So the walk down the tree is a join of keys with values.  Heavy
    ones are looked up where the tokens are read; of the others a filter passes those that may have a value.  The rows are
    scored in ROUNDS shares, one after the other, so that the keys of one share only are on disk at a time.

    An empty text consists of its end; with no training text at all every token has probability 1.  Rows are scored one
    by one, repeated or not.
    """
    sums = None
    for k in range(ROUNDS):
        some = tokens.where(F.pmod(F.xxhash64("rid"), F.lit(ROUNDS)) == k).select("rid", "tokens")
        part = P.gathered(tree.values.unionByName(some.mapInArrow(_found(tree), P.SCHEMA)), _joined(tree.buckets), P.SCHEMA)
        part = table(P.gathered(part, _summed_rows, "rid long, n_tokens long, known long, base double, model double"), "scores")
        sums = part if sums is None else sums.unionByName(part)
    out = tokens.select("rid", "doc_id").join(beside(sums), "rid")
    none = F.lit(float(np.log10(tree.n + tree.v + 1))) * F.col("n_tokens")
    return out.select(
        "doc_id",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(tree.n).cast("long").alias("train_tokens"),
        (F.col("base") - none).alias("base_score"),
        (F.col("model") - none).alias("score"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 7; a null id counts as the text of nothing."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op4_lm(spark, sf_dir):
    """All documents, learnt from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = tokenize(docs)
    tree = train(tokens.where(~held_out()))
    # scoring reads the packed values only
    drop(*tree.states, *tree.entries)
    out = score(tokens, tree)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
