"""Hierarchical Pitman-Yor language model: one restaurant for each preceding word, all of them sharing the unigram restaurant as parent.

The corpus is cut into blocks of documents. Counts, table counts and probabilities travel as packed arrays between three kinds of tasks,
by Spark's shuffles: blocks hold token sequences, pair parts (by a hash of context and word) hold the seatings of the restaurants'
dishes, and word parts (by a hash of the word) hold each word's seating in the parent and the tables of its restaurant. A pair's part
depends on both words, so that no frequent word or context gathers in one task. Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_slices
from .common import dropped, fold, lean, stored

#: Hashes of what is no word: the context of a text's first token, and the token that ends a text.
START, END = 1, 2
BLOCK_TOKENS, PART_TOKENS = 1 << 20, 3 << 20
#: Dishes of up to so many customers are drawn exactly.
EXACT = 2048
#: The sender of a ``words`` row that holds samples.
SAMPLED = -2
MIX = np.uint64(0x9E3779B97F4A7C15)


def packed(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"", 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (u ^ (u >> np.uint64(29))) * MIX + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)


def _dealt(to: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Receivers and the places of what each gets. None gets an empty message, so messages are as many as what they hold at most, however many receivers there are."""
    order = np.argsort(to, kind="stable")
    who, start = np.unique(to[order], return_index=True)
    return list(zip(who.tolist(), np.split(order, start[1:]), strict=True)) if len(to) else []


Rows = Iterator[pa.RecordBatch]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(spec: str) -> tuple[str, pa.Schema]:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return spec, pa.schema([(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])


BLOCKS = _schema("block long, n long, doc_ids binary, missing binary, held binary, lens binary, words binary, tokens binary")
#: What parts and blocks send: to a part or block, from one, of a kind, with arrays.
SENT = _schema("to long, kind string, sender long, a binary, b binary, c binary, d binary, e binary")
EMPTY = packed(np.zeros(0, np.uint8))


def _grouped(sent: DataFrame, answer: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """Answers of each receiver to all that it is sent, computed once."""
    schema = SENT[1]

    def each(group: pa.Table) -> pa.Table:
        lean()
        out = answer(group.to_pylist())
        return pa.Table.from_batches([_batch(out, schema)] if out else [], schema=schema)

    return stored(sent.groupBy("to").applyInArrow(each, SENT[0]), "seating")


def blocks(docs: DataFrame, id_col: str, text_col: str, held_out: int) -> DataFrame:
    schema = BLOCKS[1]

    def row(k: int, ids: list, held: list, lens: list[np.ndarray], words: list[pa.Array]) -> pa.RecordBatch:
        coded = pa.concat_arrays(words).dictionary_encode()
        found, places = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
        often = np.argsort(-np.bincount(places, minlength=len(found)), kind="stable")  # frequent words get small numbers, which pack well
        hashes = np.concatenate([np.array([START, END], np.uint64), np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))[often]])
        rank = np.empty(len(found), np.uint32)
        rank[often] = np.arange(2, len(found) + 2)
        lens = np.concatenate(lens) + 1
        tokens = np.ones(lens.sum(), np.uint32)
        inside = np.ones(len(tokens), bool)
        inside[np.cumsum(lens) - 1] = False
        tokens[inside] = rank[places]
        parts = (packed(np.array([x or 0 for x in ids], np.int64)), packed(np.array([x is None for x in ids], np.uint8)), packed(np.array(held, np.uint8)), packed(lens), packed(hashes), packed(tokens))
        return _batch([((TaskContext.get().partitionId() << 33) + k, len(tokens), *parts)], schema)

    def each(batches: Rows) -> Rows:
        lean()
        number = itertools.count()
        state, size = ([], [], [], []), 0
        for batch in in_slices(batches):
            split = pc.ascii_split_whitespace(pc.ascii_lower(batch.column(2)))
            real = pc.not_equal(split.flatten(), "")  # white space at an end of a text makes an empty word
            counts = np.diff(np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy() - split.offsets[0].as_py()])
            for kept, more in zip(state, (batch.column(0).to_pylist(), batch.column(1).to_pylist()), strict=False):
                kept += more
            state[2].append(counts.astype(np.int64))
            state[3].append(split.flatten().filter(real))
            size += int(counts.sum()) + len(counts)
            if size >= BLOCK_TOKENS:
                yield row(next(number), *state)
                state, size = ([], [], [], []), 0
        if size:
            yield row(next(number), *state)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, held_out) == 0).alias("held"), text.alias("text"))
    return stored(slim.mapInArrow(each, BLOCKS[0]), "blocks")


class Block:
    """A block's documents, its tokens with their contexts as places in its dictionary, and its distinct pairs by hash."""

    def __init__(self, row: dict) -> None:
        self.lens, self.words, self.w = unpacked(row["lens"], np.int64), unpacked(row["words"], np.uint64), unpacked(row["tokens"], np.uint32).astype(np.int64)
        self.held = unpacked(row["held"], np.uint8) > 0
        self.starts = np.cumsum(self.lens) - self.lens
        self.u = np.roll(self.w, 1)
        self.u[self.starts] = 0
        self.train = np.repeat(~self.held, self.lens)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context and word of each distinct pair, as places in the dictionary and in their order, and each token's pair."""
        keys, which = np.unique(self.u << 32 | self.w, return_inverse=True)
        return keys >> 32, keys & 0xFFFFFFFF, which

    def by_part(self, u: np.ndarray, w: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
        """The parts that have pairs, each with its pairs in their order."""
        return _dealt(_part(pair_hash(self.words[u], self.words[w]), parts))


def requests(blocks: DataFrame, parts: int) -> DataFrame:
    """To pair parts: each block's distinct pairs and their training counts. Contexts are told once for all their pairs."""
    schema = SENT[1]

    def of_block(row: dict) -> Rows:
        b = Block(row)
        u, w, which = b.pairs()
        count = np.bincount(which[b.train], minlength=len(u)).astype(np.uint32)
        for p, own in b.by_part(u, w, parts):
            pu, runs = np.unique(u[own], return_counts=True)
            used = np.unique(np.concatenate([pu, w[own]]))
            order = np.argsort(b.words[used])
            code = np.empty(len(used), np.uint32)
            code[order] = np.arange(len(used), dtype=np.uint32)
            number = lambda x, used=used, code=code: code[np.searchsorted(used, x)]
            yield _batch([(p, "pairs", row["block"], packed(b.words[used[order]]), packed(number(pu)), packed(runs.astype(np.uint32)), packed(number(w[own])), packed(count[own]))], schema)

    def each(batches: Rows) -> Rows:
        lean()
        for one in in_slices(batches, 1):  # a block at a time
            yield from of_block(one.to_pylist()[0])

    return blocks.mapInArrow(each, SENT[0])


def _sums(place: np.ndarray, value: np.ndarray | None, n: int) -> np.ndarray:
    return np.rint(np.bincount(place, value, n)).astype(np.uint64)


def _told(kind: str, sender: int, parts: int, words: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """Messages to the word parts about ``words``."""
    blank = [EMPTY] * (4 - len(arrays))
    return [(p, kind, sender, packed(words[own]), *(packed(a[own]) for a in arrays), *blank) for p, own in _dealt(_part(words, parts))]


def counted(parts: int) -> Callable:
    """Of a pair part: ``reply`` for each block (its pairs' count codes, answered later), ``state`` (pairs of two or more), ``sums`` to word parts.

    Codes: 0 for a pair that training lacks, 1 for one that it has once, else the pair's place in the state, plus 2. A pair with one
    customer has one table in every sample, so only its part in the sums is kept.
    """

    def answer(rows: list[dict]) -> list[tuple]:
        part, lens = rows[0]["to"], []
        words = [unpacked(r["a"], np.uint64) for r in rows]
        u = np.concatenate([x[np.repeat(unpacked(r["b"], np.uint32), unpacked(r["c"], np.uint32))] for x, r in zip(words, rows, strict=True)])
        w = np.concatenate([x[unpacked(r["d"], np.uint32)] for x, r in zip(words, rows, strict=True)])
        del words
        n = [unpacked(r["e"], np.uint32) for r in rows]
        lens = np.cumsum([len(x) for x in n])[:-1]
        first, which = np.unique(pair_hash(u, w), return_index=True, return_inverse=True)[1:]
        u, w = u[first], w[first]
        count = _sums(which, np.concatenate(n), len(first))
        del first, n
        many = count > 1
        code = np.minimum(count, 1).astype(np.uint32)
        code[many] = np.arange(many.sum(), dtype=np.uint32) + 2
        out = [(part, "reply", r["sender"], packed(c), EMPTY, EMPTY, EMPTY, EMPTY) for r, c in zip(rows, np.split(code[which], lens), strict=True)]
        del code, which
        seen = count > 0
        words, at = np.unique(np.concatenate([u[seen], w[seen]]), return_inverse=True)
        pu, pw = np.split(at, [seen.sum()])
        k, once = len(words), ~many[seen]
        # customers as word and as context, tables of pairs that are seated for good, and those that start with one
        out += _told("sums", part, parts, words, _sums(pw, count[seen], k), _sums(pu, count[seen], k), _sums(pw[once], None, k) << np.uint64(32) | _sums(pu[once], None, k), _sums(pw[~once], None, k) << np.uint64(32) | _sums(pu[~once], None, k))
        own, at = np.unique(np.concatenate([u[many], w[many]]), return_inverse=True)
        pu, pw = np.split(at, [many.sum()])
        order = np.argsort(_part(own, parts), kind="stable")  # replies of word parts come part by part
        rank = np.argsort(order)
        out.append((part, "state", part, packed(own[order]), packed(rank[pu].astype(np.uint32)), packed(rank[pw].astype(np.uint32)), packed(count[many].astype(np.uint64)), packed(np.array([(count == 1).sum(), (count == 2).sum()], np.uint64))))
        return out

    return answer


@lru_cache(maxsize=4)
def _stirling(discount: float, most: int) -> list[np.ndarray]:
    """Logarithms of the generalised Stirling numbers S(n, t) for n of 0 to ``most`` and t of 1 to n: the weight of all ways to seat n customers at t tables."""
    rows, now = [np.zeros(0, np.float32), np.zeros(1, np.float32)], np.zeros(1)
    for n in range(1, most):
        t = np.arange(1, n + 1)
        stay = np.append(np.log(n - discount * t) + now, -np.inf)
        now = np.logaddexp(stay, np.append(-np.inf, now))
        rows.append(now.astype(np.float32))
    return rows


class _Large:
    """G(n, t) = S(n, t) d^(t-1) (t-1)! / S(n, 1) of large n and t up to ``MOST``, at a grid of n; it grows towards 1.

    G(n + 1, t) = G(n, t) + d (t - 1) / (n - d) (G(n, t - 1) - G(n, t)). From ``SLOW`` on, n grows by small shares of itself a step.
    """

    MOST, SLOW, RATIO = 4096, 1 << 16, 1.1

    def __init__(self, discount: float) -> None:
        self.discount, self.n = discount, 1
        self.now = np.zeros(self.MOST)
        self.now[0] = 1
        self.rate = discount * np.arange(self.MOST)
        self.grid: list[tuple[int, np.ndarray]] = []

    def row(self, n: int) -> np.ndarray:
        """Logarithms of G(n, t), between two rows of the grid by the logarithm of n."""
        while not self.grid or self.grid[-1][0] < n:
            until = EXACT if not self.grid else math.ceil(self.grid[-1][0] * self.RATIO)
            while self.n < until:
                jump = 1 if self.n < self.SLOW else min(until - self.n, self.n // self.SLOW * 4)
                self.now[1:] += np.minimum(jump * self.rate[1:] / (self.n - self.discount), 1) * (self.now[:-1] - self.now[1:])
                self.n += jump
            with np.errstate(divide="ignore"):
                self.grid.append((self.n, np.maximum(np.log(self.now), -1e6)))
        k = bisect.bisect_left([g[0] for g in self.grid], n)
        hi, above = self.grid[k]
        if hi == n or not k:
            return above
        lo, below = self.grid[k - 1]
        return below + (above - below) * (math.log(n / lo) / math.log(hi / lo))


@lru_cache(maxsize=4)
def _large(discount: float) -> _Large:
    return _Large(discount)


@lru_cache(maxsize=1)
def _factorials() -> np.ndarray:
    """Logarithms of (t - 1)!."""
    return np.cumsum(np.log(np.maximum(np.arange(_Large.MOST), 1)))


def sampled_tables(customers: np.ndarray, p: np.ndarray, other: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """A Gibbs draw of each dish's number of tables, given its customers, its probability ``p`` in the parent and the ``other`` tables of its restaurant.

    The whole dish is seated anew: P(t) is in proportion to p^t (s + d other) ... (s + d (other + t - 1)) S(customers, t), the sum over
    all seatings at t tables; S from a table up to ``EXACT`` customers, beyond that by :class:`_Large`. Where over half of the tables that
    it holds are expected, S is taken at its limit for many customers, which makes t - 1 negative binomial. Dishes without customers have
    no table.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    if len(few):
        few = few[np.argsort(customers[few], kind="stable")]
        sizes, start = np.unique(customers[few], return_index=True)
        known = _stirling(discount, EXACT)
        for n, same in zip(sizes.astype(int).tolist(), np.split(few, start[1:]), strict=True):
            for k in range(0, len(same), step := max(1, (1 << 20) // n)):
                own = same[k : k + step]
                log = np.cumsum(np.log(strength + discount * (other[own, None] + np.arange(n))) + np.log(p[own, None]), axis=1) + known[n]
                weight = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
                tables[own] = 1 + (weight < (rng.random(len(own)) * weight[:, -1])[:, None]).sum(axis=1)
    for i in np.flatnonzero(customers > EXACT):
        x, chance = strength / discount + other[i], min(float(p[i]), 1 - 1e-9)
        if (x + 1) * chance / (1 - chance) > _Large.MOST / 2:
            tables[i] = min(int(customers[i]), 1 + rng.negative_binomial(x + 1, 1 - chance))
            continue
        log = np.cumsum(np.log(x + np.arange(_Large.MOST)) + math.log(chance)) - _factorials() + _large(discount).row(int(customers[i]))
        weight = np.cumsum(np.exp(log - log.max()))
        tables[i] = 1 + np.searchsorted(weight, rng.random() * weight[-1], "right")
    return tables


def merged(rows: list[dict]) -> list[tuple]:
    """Of a word part: one ``words`` row with the sums of its words; d and e hold tables as word and as context in two halves of 64 bits."""
    words, at = np.unique(np.concatenate([unpacked(r["a"], np.uint64) for r in rows]), return_inverse=True)
    sums = []
    for k in "bcde":
        value = np.concatenate([unpacked(r[k], np.uint64) for r in rows])
        halves = (value >> np.uint64(32), value & np.uint64(0xFFFFFFFF)) if k in "de" else (value,)
        sums += [_sums(at, h.astype(float), len(words)) for h in halves]
    c, cu, tw1, tu1, tw2, tu2 = sums
    return [(rows[0]["to"], "words", -1, packed(words), packed(c), packed(cu), packed(np.concatenate([tw1, tu1])), packed(np.concatenate([tw2, tu2]).astype(float)))]


class Model:
    """The shared parent as all tasks need to know it: a few numbers."""

    def __init__(self, discount: float, strength: float, customers: float, tables: float, vocabulary: int) -> None:
        self.discount, self.strength, self.customers, self.tables, self.base = discount, strength, customers, tables, 1 / (vocabulary + 1)

    def parent(self, less: np.ndarray) -> np.ndarray:
        """Probability of words in the parent from their customers less the discounts of their tables; its own parent gives each of the vocabulary and one unknown word the same."""
        return (less + (self.strength + self.discount * self.tables) * self.base) / (self.strength + self.customers)


def seated_words(model: Model, seed: int, keep: int) -> Callable:
    """Of a word part: the new ``words`` row (its customers in the parent from the ``tables`` that pair parts told), and ``prob`` to pair parts.

    A ``words`` row: hashes, counts, context counts, fixed tables, and of the last ``keep`` samples [customers less discounts in the
    parent, tables in the parent, tables as context]. ``prob``: the first and the last of these for the words that a pair part told of.
    """

    def answer(rows: list[dict]) -> list[tuple]:
        part = rows[0]["to"]
        own = next((r for r in rows if r["kind"] == "words"), None)
        if own is None:
            return []
        words = unpacked(own["a"], np.uint64)
        tw1, tu1 = np.split(unpacked(own["d"], np.uint64).astype(float), 2)
        told = [r for r in rows if r["kind"] == "tables"]
        places = [np.searchsorted(words, unpacked(r["a"], np.uint64)) for r in told]
        at = np.concatenate([np.zeros(0, np.int64), *places])
        tw2, tu2 = (np.bincount(at, np.concatenate([np.zeros(0), *(unpacked(r[k], np.float64) for r in told)]), len(words)) for k in "bc")
        customers, tu = np.rint(tw1 + tw2).astype(np.int64), tu1 + tu2
        samples = unpacked(own["e"], np.float64)
        samples = samples[: len(samples) // (3 * len(words)) * 3 * len(words)] if own["sender"] == SAMPLED else samples[:0]
        before = samples[-2 * len(words) : -len(words)] if len(samples) else np.minimum(customers, 1)
        tables = sampled_tables(customers, np.full(len(words), model.base), np.maximum(model.tables - before, 0), model.discount, model.strength, np.random.default_rng([seed, part]))
        less = customers - model.discount * tables
        samples = np.concatenate([samples, less, tables, tu])[-3 * keep * len(words) :]
        out = [(part, "words", SAMPLED, own["a"], own["b"], own["c"], own["d"], packed(samples))]
        return out + [(r["sender"], "prob", part, packed(less[i].astype(np.float32)), packed(tu[i].astype(np.float32)), EMPTY, EMPTY, EMPTY) for r, i in zip(told, places, strict=True)]

    return answer


def told_words(parts: int) -> Callable:
    """Of a pair part's state: ``tables`` to word parts, all dishes at one table."""

    def answer(rows: list[dict]) -> list[tuple]:
        r = rows[0]
        words, u, w = unpacked(r["a"], np.uint64), unpacked(r["b"], np.uint32), unpacked(r["c"], np.uint32)
        return _told("tables", r["to"], parts, words, np.bincount(w, minlength=len(words)).astype(float), np.bincount(u, minlength=len(words)).astype(float))

    return answer


def seated_pairs(parts: int, model: Model, discount: float, strength: float, seed: int, kept: bool, last: bool) -> Callable:
    """Of a pair part: a draw of its dishes' tables given the parent; ``tables`` to word parts, ``seats`` (tables, and their sum over kept draws).

    The ``last`` draw also gives ``mean``: customers less discounts, averaged over the kept draws.
    """

    def answer(rows: list[dict]) -> list[tuple]:
        own = next((r for r in rows if r["kind"] == "state"), None)
        if own is None:
            return []
        part, words = own["to"], unpacked(own["a"], np.uint64)
        u, w, customers = unpacked(own["b"], np.uint32), unpacked(own["c"], np.uint32), unpacked(own["d"], np.uint64)
        heard = sorted((r for r in rows if r["kind"] == "prob"), key=lambda r: r["sender"])
        less, tu = (np.concatenate([unpacked(r[k], np.float32) for r in heard] or [np.zeros(0, np.float32)]).astype(float) for k in "ab")
        seats = next((r for r in rows if r["kind"] == "seats"), None)
        before = unpacked(seats["a"], np.uint32) if seats else np.ones(len(customers), np.uint32)
        total = unpacked(seats["b"], np.uint32) if seats else np.zeros(len(customers), np.uint32)
        draws = unpacked(seats["c"], np.uint32)[0] if seats else 0
        tables = sampled_tables(customers.astype(np.int64), model.parent(less)[w], np.maximum(tu[u] - before, 0), discount, strength, np.random.default_rng([seed, part]))
        if kept:
            total, draws = (total + tables).astype(np.uint32), draws + 1
        out = _told("tables", part, parts, words, np.bincount(w, tables, len(words)), np.bincount(u, tables, len(words)))
        if last:
            return [*out, (part, "mean", part, packed(customers - discount * total / max(1, draws)), EMPTY, EMPTY, EMPTY, EMPTY)]
        return [*out, (part, "seats", part, packed(tables.astype(np.uint32)), packed(total), packed(np.array([draws], np.uint32)), EMPTY, EMPTY)]

    return answer


def answered(rows: list[dict]) -> list[tuple]:
    """Of a pair part, to blocks: each pair's customers less discounts for pairs of two or more, 0 for others, beside the code of the rest."""
    mean = next((unpacked(r["a"], np.float64) for r in rows if r["kind"] == "mean"), np.zeros(0))
    found = np.concatenate([[0, 0], mean]).astype(np.float32)
    out = []
    for r in rows:
        if r["kind"] == "reply":
            code = unpacked(r["a"], np.uint32)
            out.append((r["sender"], "pairs", r["to"], packed(np.minimum(code, 2).astype(np.uint8)), packed(found[code[code > 1]]), EMPTY, EMPTY, EMPTY))
    return out


def asked(blocks: DataFrame, parts: int) -> DataFrame:
    """To word parts: each block's words."""
    schema = SENT[1]

    def each(batches: Rows) -> Rows:
        for batch in batches:
            for block, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _batch(_told("asked", block, parts, unpacked(words, np.uint64)), schema)

    return blocks.select("block", "words").mapInArrow(each, SENT[0])


def informed(models: list[Model]) -> Callable:
    """Of a word part, to blocks: count, count as context, and for each kept sample probability in the parent and tables as context, of the words asked for."""

    def answer(rows: list[dict]) -> list[tuple]:
        own = next((r for r in rows if r["kind"] == "words"), None)
        words = unpacked(own["a"], np.uint64) if own else np.zeros(0, np.uint64)
        c, cu = (np.append(unpacked(own[k], np.uint64), np.uint64(0)) if own else np.zeros(1, np.uint64) for k in "bc")
        samples = unpacked(own["e"], np.float64).reshape(len(models), 3, -1) if own else np.zeros((len(models), 3, 0))
        p = np.stack([m.parent(np.append(x[0], 0)) for m, x in zip(models, samples, strict=True)]).astype(np.float32)
        tu = np.stack([np.append(x[2], 0) for x in samples]).astype(np.float32)
        out = []
        for r in rows:
            if r["kind"] == "asked":
                a = unpacked(r["a"], np.uint64)
                i = np.searchsorted(words, a)
                i[np.append(words, 0)[i] != a] = len(words)
                i = np.minimum(i, len(words))
                out.append((r["sender"], "words", r["to"], packed(c[i]), packed(cu[i]), packed(p[:, i].ravel()), packed(tu[:, i].ravel()), EMPTY))
        return out

    return answer


SCORES = _schema("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_blocks(blocks: DataFrame, heard: DataFrame, parts: int, discount: float, strength: float, total: int, vocabulary: int, samples: int) -> DataFrame:
    """A row per document from the blocks and what pair and word parts answered."""
    schema = SCORES[1]

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        row = left.to_pylist()[0]
        b = Block(row)
        rows = sorted(right.to_pylist(), key=lambda r: r["sender"])
        order = np.argsort(_part(b.words, parts), kind="stable")
        told = [r for r in rows if r["kind"] == "words"]

        def heard_of(field: str, kind: type, samples: int) -> np.ndarray:
            x = np.zeros((samples, len(b.words)))
            x[:, order] = np.concatenate([unpacked(r[field], kind).reshape(samples, -1) for r in told], axis=1)
            return x

        (c,), (cu,), p, tu = heard_of("a", np.uint64, 1), heard_of("b", np.uint64, 1), heard_of("c", np.float32, samples), heard_of("d", np.float32, samples)
        u, w, which = b.pairs()
        order = np.concatenate([own for _, own in b.by_part(u, w, parts)])
        told = [r for r in rows if r["kind"] == "pairs"]
        code = np.concatenate([unpacked(r["a"], np.uint8) for r in told])
        less = np.where(code == 1, 1 - discount, 0.0)
        less[code == 2] = np.concatenate([unpacked(r["b"], np.float32) for r in told])
        seated = np.zeros(len(u))
        seated[order] = less
        # the parent's part, averaged over the kept samples
        backed = np.mean([(strength + discount * t[u]) * q[w] for t, q in zip(tu, p, strict=True)], axis=0)
        base = np.log10((c[b.w] + 0.1) / (total + 0.1 * (vocabulary + 1)))
        own = np.log10((seated + backed) / (strength + cu[u]))[which]
        add = lambda x: np.add.reduceat(x, b.starts)
        missing = unpacked(row["missing"], np.uint8) > 0
        ids = pa.array(unpacked(row["doc_ids"], np.int64), mask=missing)
        known = add((c[b.w] > 0).astype(np.int64))
        score = add(own)
        perplexity = 10 ** np.minimum(-score / b.lens, 300)
        return pa.Table.from_arrays([ids, pa.array(b.held), pa.array(b.lens), pa.array(known), pa.array(np.full(len(known), total)), pa.array(add(base)), pa.array(score), pa.array(perplexity)], schema=schema)

    return blocks.groupBy("block").cogroup(heard.withColumnRenamed("to", "block").groupBy("block")).applyInArrow(each, SCORES[0])


def _totals(words: DataFrame) -> dict[str, float]:
    """Sums over all words before any sample: counts, distinct words, customers in the parent, and how many words have 1 or 2 of these."""

    def each(batches: Rows) -> Rows:
        for batch in batches:
            for row in batch.to_pylist():
                c, fixed, more = unpacked(row["b"], np.uint64), unpacked(row["d"], np.uint64).astype(float), unpacked(row["e"], np.float64)
                seats = np.rint(np.split(fixed, 2)[0] + np.split(more, 2)[0])
                yield pa.RecordBatch.from_pydict({"n": [float(c.sum())], "v": [float((c > 0).sum())], "one": [float((seats == 1).sum())], "two": [float((seats == 2).sum())]})

    return _summed(words, each, ("n", "v", "one", "two"))


def _seated_totals(words: DataFrame, discount: float) -> dict[str, float]:
    """Customers and tables of the parent in the last sample."""

    def each(batches: Rows) -> Rows:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(unpacked(row["a"], np.uint64))
                less, tables, _ = np.split(unpacked(row["e"], np.float64)[-3 * n :], 3)
                yield pa.RecordBatch.from_pydict({"customers": [float((less + discount * tables).sum())], "tables": [float(tables.sum())]})

    return _summed(words, each, ("customers", "tables"))


def _summed(words: DataFrame, each: Callable, names: tuple[str, ...]) -> dict[str, float]:
    found = words.mapInArrow(each, ", ".join(f"{n} double" for n in names)).groupBy().sum().first()
    return {k: float(x or 0) for k, x in zip(names, found, strict=True)}


def _discount(one: float, two: float) -> float:
    """The usual estimate from how many dishes have one and two customers."""
    return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5


def text_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 10, rounds: int = 3, keep: int = 2, strength: float = 1.0, seed: int = 7) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text) and perplexity (of a token by ``score``).

    Rows whose crc32(id as text) modulo ``held_out`` isn't 0 train the model. Words are runs of anything but white space in ASCII lower case,
    and an end token follows the last. In each of ``rounds`` rounds of Gibbs sampling, the words' tables in the parent are drawn given the
    tables of all context restaurants, then every dish (a word after a context) is seated anew given the parent
    (:func:`sampled_tables`); tables that other dishes of a restaurant hold are those of the round before, so that all restaurants are
    drawn at once. Of the last ``keep`` samples, P(w | u) = (c_uw - d t_uw + (s + d t_u) P(w)) / (s + c_u) is averaged; each of these
    sums to one over all words and the unknown one, and so does their mean.

    A null text counts as empty, a null id as the empty text in the checksum, repeated rows count and are answered each, an empty table
    gives an empty result, other columns are ignored. Without training texts every score is 0 and every perplexity 1.
    """
    own = blocks(docs, id_col, text_col, held_out)
    size = own.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(size / PART_TOKENS))
    first = _grouped(requests(own, parts), counted(parts))
    words = _grouped(first.filter("kind = 'sums'"), merged)
    state = first.filter("kind = 'state'")

    def numbers(batches: Rows) -> Rows:
        for batch in batches:
            for row in batch.to_pylist():
                one, two = unpacked(row["e"], np.uint64).astype(float)
                yield pa.RecordBatch.from_pydict({"one": [one], "two": [two]})

    discount = _discount(*(x or 0.0 for x in state.select("e").mapInArrow(numbers, "one double, two double").groupBy().sum().first()))
    at = _totals(words)
    total, vocabulary = round(at["n"]), round(at["v"])
    # The parent starts with a table for every word, the restaurants with one for every dish.
    model = Model(_discount(at["one"], at["two"]), strength, 0, vocabulary, vocabulary)
    told, models = _grouped(state, told_words(parts)), []
    for k in range(rounds + 1):
        heard = _grouped(words.unionByName(told.filter("kind = 'tables'")), seated_words(model, seed + 1000 * k, keep))
        dropped(words)
        words = heard.filter("kind = 'words'")
        model = Model(model.discount, strength, *_seated_totals(words, model.discount).values(), vocabulary)
        models = [*models, model][-keep:]
        if k < rounds:
            before = told
            sent = state.unionByName(heard.filter("kind = 'prob'")).unionByName(told.filter("kind = 'seats'"))
            told = _grouped(sent, seated_pairs(parts, model, discount, strength, seed + 1000 * k + 500, k >= rounds - keep, k == rounds - 1))
            dropped(before)
    pairs = first.filter("kind = 'reply'").unionByName(told.filter("kind = 'mean'"))
    heard = _grouped(pairs, answered).unionByName(_grouped(words.unionByName(asked(own, parts)), informed(models)))
    dropped(first, told, words)
    return score_blocks(own, heard, parts, discount, strength, total, vocabulary, len(models))
