"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_slices
from .common import fold, stored

#: Rows of the embedding table (2 to this power) and its width; the lengths of character n-grams; words of a bag; the longest word, longer ones are cut.
BITS, WIDTH, GRAMS, BAG, LONGEST = 16, 8, (3, 4, 5, 6), 4, 32
#: Code points whose n-grams are made at once.
PIECE = 1 << 20
_APART = re.compile(r"\W*\s\W*")
_MIX, _POWERS = np.uint32(2654435761), np.cumprod(np.full(LONGEST + 1, 0x9E3779B1, np.uint32), dtype=np.uint32)


def plain(text: str) -> str:
    """Lower-case words with one blank around each; marks at their edges are gone, words of over LONGEST code points are cut into pieces."""
    spaced = _APART.sub(" ", f" {text.lower()} ")
    if max(map(len, spaced.split(" "))) > LONGEST:
        spaced = re.sub(rf"(\S{{{LONGEST}}})(?=\S)", r"\1 ", spaced)
    return spaced


def grams(spaced: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and word numbers of the words and of their character n-grams, blanks at the edges being part of these; one pair for each kind."""
    code = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = code == 32
    number = np.cumsum(blank) - 1  # of the word that a code point is in
    inner = np.flatnonzero(~blank)
    if not len(inner):
        return
    place = np.arange(len(code)) - np.maximum.accumulate(np.where(blank, np.arange(len(code)), 0))
    whole = np.add.reduceat((code * _MIX * _POWERS[np.minimum(place, LONGEST)])[:-1], np.flatnonzero(blank)[:-1], dtype=np.uint32)
    yield _bucket(whole), np.arange(len(whole))
    rolled = code
    inside = np.ones(len(code), bool)
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * _MIX + code[n - 1 :]
        inside = inside[:-1] & ~blank[n - 2 : -1] if n > 2 else inside[:-1]
        if n in GRAMS:
            at = np.flatnonzero(inside)
            yield _bucket(rolled[at] + np.uint32(n)), number[at + 1]


def _bucket(hashed: np.ndarray) -> np.ndarray:
    hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (hashed ^ (hashed >> np.uint32(13))) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class Model:
    """``weight`` of every bucket (its vector times the difference of the two softmax rows) and the difference of the biases: all that scores need."""

    weight: np.ndarray
    bias: float

    def words(self, spaced: str) -> np.ndarray:
        """For every word the mean weight of its buckets."""
        total = count = 0
        n = spaced.count(" ") - 1
        for bucket, word in grams(spaced):
            total = total + np.bincount(word, self.weight[bucket], n)
            count = count + np.bincount(word, minlength=n)
        return total / count if n > 0 else np.zeros(0)

    def odds(self, text: str) -> float:
        """Log odds of the likeliest bag of BAG words in a row; a shorter text is one bag, an empty one has the bias only."""
        spaced, found, at = plain(text), [], 0
        while at < len(spaced) - 1:
            end = spaced.find(" ", min(at + PIECE, len(spaced) - 1))
            found.append(self.words(spaced[at : end + 1]))
            at = end
        values = np.concatenate(found) if found else np.zeros(0)
        if len(values) <= BAG:
            return self.bias + float(values.mean() if len(values) else 0)
        total = np.concatenate([[0.0], np.cumsum(values)])
        return self.bias + float((total[BAG:] - total[:-BAG]).max()) / BAG

    def score(self, text: str) -> float:
        """The probability of those odds."""
        return _sigmoid(self.odds(text))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


@dataclass
class Bags:
    """Bags of word numbers, padded with -1; ``owner``: the text of each; the words' buckets, one list after the other."""

    words: np.ndarray
    owner: np.ndarray
    buckets: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: Iterable[str]) -> Bags:
        number: dict[str, int] = {}
        bags, owner = [], []
        for k, text in enumerate(texts):
            ids = np.array([number.setdefault(w, len(number)) for w in plain(text).split()], np.int32)
            n = max(1, -(-len(ids) // BAG))
            own = np.full(n * BAG, -1, np.int32)
            own[: len(ids)] = ids
            bags.append(np.unique(own.reshape(n, BAG), axis=0))  # lines repeated a thousand times don't tell a thousand times
            owner.append(np.full(len(bags[-1]), k))
        bucket, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*grams(" " + "".join(f"{w} " for w in number)), strict=True)) if number else (np.zeros(0, np.int64),) * 2
        order = np.argsort(word, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(number)))]).astype(np.int64)
        return cls(np.concatenate(bags), np.concatenate(owner), bucket[order].astype(np.int64), starts)


def trained(bags: Bags, which: np.ndarray, label: np.ndarray, rounds: int, rate: float, pull: float, batch: int = 2048, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax rows and biases by Adagrad over the bags ``which`` with their labels; gradients go through the average into every n-gram's vector.

    ``pull`` is the strength with which used vectors shrink towards zero. In every batch a word shows a random half of its n-grams, so that each
    half learns to speak for the word and a misspelling that keeps some of them is still known.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    rows, bias = rng.normal(0, 0.1, (2, WIDTH)).astype(np.float32), np.zeros(2, np.float32)
    seen = [np.full(x.shape, 1e-6, np.float32) for x in (table, rows, bias)]
    for _ in range(rounds):
        order = rng.permutation(len(which))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            ids = bags.words[which[pick]]
            there = ids >= 0
            used, place = np.unique(ids[there], return_inverse=True)
            size = bags.starts[used + 1] - bags.starts[used]
            offset = np.concatenate([[0], np.cumsum(size)[:-1]])
            flat = bags.buckets[np.repeat(bags.starts[used] - offset, size) + np.arange(size.sum())]
            spread = np.repeat(np.arange(len(used)), size)
            shown = rng.random(len(flat)) < 0.5
            flat, spread = flat[shown], spread[shown]
            size = np.maximum(np.bincount(spread, minlength=len(used)), 1)
            vectors = np.stack([np.bincount(spread, table[flat, d], len(used)) for d in range(WIDTH)], axis=1) / size[:, None]
            n = np.maximum(there.sum(axis=1), 1)
            owner = np.nonzero(there)[0]
            mean = np.stack([np.bincount(owner, vectors[place, d], len(pick)) for d in range(WIDTH)], axis=1) / n[:, None]
            odds = mean @ rows.T + bias
            p = np.exp(odds - odds.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), label[pick]] -= 1
            back = (p @ rows) / n[:, None]
            by_word = np.stack([np.bincount(place, back[owner, d], len(used)) for d in range(WIDTH)], axis=1) / size[:, None]
            at, where = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(where, by_word[spread, d], len(at)) for d in range(WIDTH)], axis=1) + pull * table[at] * len(pick) / len(order)
            for x, g, s, i in ((table, grad, seen[0], at), (rows, p.T @ mean, seen[1], slice(None)), (bias, p.sum(axis=0), seen[2], slice(None))):
                s[i] += g * g
                x[i] -= rate * g / np.sqrt(s[i])
    return table, rows, bias


def fit(texts: list[str], labels: list[int], odds: float | None = None, rounds: int = 6, rate: float = 0.2, pull: float = 1.0) -> Model:
    """From whole texts and their labels (0 or 1); ``odds``: how many toxic texts count for each other one, by default as many as are given.

    A label tells of a text, not of its bags. First all bags take their text's label: a bag that toxic and other texts share so stays near the
    prior. Then, of a toxic text, only the bags that the first model finds likelier than not count as toxic and the others don't count, and the
    model is trained anew. Every fourth text of each class is left out of both; its likeliest bag's log odds are fitted to its label, so that
    scores are probabilities of texts (Platt's scaling). Without four texts of each class the model is a bias alone.
    """
    y = np.array(labels, np.int64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if min(y.sum(), len(y) - y.sum()) < 4:
        return Model(np.zeros(1 << BITS, np.float32), math.log(share / (1 - share)))
    turn = np.zeros(len(y), np.int64)
    for k in (0, 1):
        turn[y == k] = np.arange((y == k).sum()) % 4
    own = np.flatnonzero(turn < 3)
    bags = Bags.of(texts[k] for k in own)
    mark = y[own][bags.owner]
    every = np.arange(len(mark))
    model = _model(trained(bags, every, mark, rounds, rate, pull))
    word = np.bincount(np.repeat(np.arange(len(bags.starts) - 1), np.diff(bags.starts)), model.weight[bags.buckets], len(bags.starts) - 1) / np.maximum(np.diff(bags.starts), 1)
    there = bags.words >= 0
    found = model.bias + np.where(there, np.append(word, 0)[bags.words], 0).sum(axis=1) / np.maximum(there.sum(axis=1), 1)
    keep = every[(mark == 0) | (found > 0)]
    if mark[keep].any():
        model = _model(trained(bags, keep, mark[keep], rounds, rate, pull))
    rest = np.flatnonzero(turn == 3)
    x = np.array([model.odds(texts[k]) for k in rest])
    weight = np.where(y[rest] == 1, odds * (y[rest] == 0).sum() / y[rest].sum(), 1.0) if odds else np.ones(len(rest))
    slope, shift = platt(x, y[rest], weight)
    return Model((model.weight * slope).astype(np.float32), model.bias * slope + shift)


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """slope and shift of a logistic curve from ``x`` to ``y``, by Newton's steps; targets are softened as Platt does, the slope isn't negative."""
    up, down = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(float(np.abs(x).max()), 1.0)
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    a = np.array([scale, math.log(up / down)])
    loss = lambda a: float((weight * (np.logaddexp(0, z @ a) - target * (z @ a))).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -500, 500)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (weight * (p - target)))
        size = 1.0
        while size > 1e-6 and loss(a - size * step) > loss(a):
            size /= 2
        a = a - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(a[0]) / scale, 1e-6), float(a[1])


def _model(parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Model:
    table, rows, bias = parts
    return Model((table @ (rows[1] - rows[0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, of_each: dict[int, int], points: int, held_out: int, remainder: int) -> list[tuple[str, int]]:
    """Labelled texts that aren't held out: of each label those whose ids have the smallest hashes, at most ``of_each`` and together ``points`` code points.

    The bounds are on ids first, so that only their texts are read together, and then on rows and code points. Whole texts only.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label is not null and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label")).filter(fold("doc_id", held_out) != remainder).withColumn("rank", F.xxhash64("doc_id"))
    ids = None
    for label, most in of_each.items():
        own = marks.filter(F.col("label") == label).orderBy("rank", "doc_id").limit(most)
        ids = own if ids is None else ids.unionByName(own)
    ids = stored(ids, "toxic-sample")  # at most the sum of of_each
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = stored(rows.withColumn("size", F.length("text")), "toxic-sample")
    taken, keys = [], set()
    for label, most in of_each.items():
        room = points // len(of_each)
        for r in rows.filter(F.col("label") == label).select("doc_id", "size", F.xxhash64("text").alias("text_key"), "rank").orderBy("rank", "doc_id", "size", "text_key").limit(most).collect():
            if r["size"] <= room:
                room -= r["size"]
                keys.add((r.doc_id, r.text_key))
    if not keys:
        return []
    chosen = docs.sparkSession.createDataFrame(sorted(keys), "doc_id long, text_key long")
    for r in rows.withColumn("text_key", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).collect():
        taken.append((r["rank"], r.doc_id, r.text_key, r.text, r.label))
    return [(text, label) for *_, text, label in sorted(taken)]


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 3, remainder: int = 1, limit: float = 0.7,
    toxic: int = 2000, clean: int = 4000, points: int = 20_000_000, **training,
) -> DataFrame:
    """One row per input row: doc_id, held_out (crc32 of the id modulo ``held_out`` is ``remainder``), score (0 to 1) and predicted (score >= limit).

    Word vectors are means of the vectors of a word and its character n-grams, so a word never seen has the vectors of the n-grams that it
    shares. A bag is BAG words in a row, its vector their mean; a linear softmax over it is trained together with the vectors (:func:`fit`).
    A text's score is that of its likeliest bag, so a few words in a long text count as much as in a short one. The whole text counts.

    The model is trained on the driver from a bounded sample of labelled rows that aren't held out: at most ``toxic`` and ``clean`` rows of the
    two labels, and ``points`` code points. Scoring runs in tasks with the one number that each n-gram has come to (256 KB).

    A null text counts as empty, and empty texts get the bias' score; a null id counts as the empty text in the checksum and never trains; null
    labels don't count, of several labels of one id the largest does; repeated rows score each and train once. Without four labelled rows of
    each class every score is the share of the toxic ones (0.5 without any). An empty table gives an empty result; other columns are ignored.
    """
    found = sample(docs, labels, id_col, text_col, label_col, {0: clean, 1: toxic}, points, held_out, remainder)
    model = fit([t for t, _ in found], [y for _, y in found], **{"odds": 0.5, **training})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            score = np.array([model.score(t) for t in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= limit).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return slim.select("doc_id", (fold("doc_id", held_out) == remainder).alias("held_out"), "text").mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")
