from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tesserae.llm import queries, toxicity
from tesserae.llm.toxicity import Bags, Model, fit, grams, plain, platt, toxicity_scores

from .helpers import none, odd

MEDIUM = "/root/testdata/sf0.01"


def held(i) -> bool:
    return zlib.crc32(str(i).encode()) % 3 == 1


def made(n: int, seed: int = 1):
    """Texts of made-up words; every fourth has one to three words of three stems with endings, in a place of its own."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "tos", "ul", "ba", "shi", "an", "der", "fo", "que"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(20, 400))]
        if k % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(["grumzx", "wyvrek", "plochz"]) + rng.choice(["", "ed", "ing", *syllables])
        rows.append((k, " ".join(words) + "."))
    return rows


def grams_plainly(word: str) -> set[str]:
    marked = f" {word} "
    return {marked[k : k + n] for n in toxicity.GRAMS for k in range(len(marked) - n + 1) if " " not in marked[k + 1 : k + n - 1]}


def test_grams_of_words():
    """Equal n-grams share a bucket wherever they stand; each word has as many as a plain loop finds, and one more for itself."""
    text = plain("Élan, the (idiot) 😀 a-b! " + "x" * 70 + " the")
    own = text.split()
    count = np.zeros(len(own), int)
    for _, word in grams(text):
        count += np.bincount(word, minlength=len(own))
    assert own[:4] == ["élan", "the", "idiot", "a-b"] and [len(w) for w in own[4:]] == [32, 32, 6, 3]
    assert count.tolist() == [1 + sum(max(0, len(w) + 2 - n + 1) for n in toxicity.GRAMS) for w in own]
    alone = {int(b) for bucket, _ in grams(" idiot ") for b in bucket}
    inside = {int(b) for bucket, word in grams(text) for b in bucket[word == 2]}
    assert alone == inside and len(alone) == len(grams_plainly("idiot")) + 1


def test_score_is_the_likeliest_bag():
    """Against a loop over all bags, and in pieces as in one."""
    model = Model(np.random.default_rng(1).normal(0, 3, 1 << toxicity.BITS).astype(np.float32), -1.0)
    for text in ("", " \n ", "one", "one two three", " ".join(t for _, t in made(3)), "word " * 50 + "other"):
        own = plain(text).split()
        values = [float(model.words(f" {w} ")[0]) for w in own]
        bags = [np.mean(values[k : k + toxicity.BAG]) for k in range(max(1, len(values) - toxicity.BAG + 1))] if values else [0.0]
        assert model.odds(text) == pytest.approx(max(bags) - 1.0, abs=1e-6)
        whole, toxicity.PIECE = model.odds(text), 40
        assert model.odds(text) == pytest.approx(whole, abs=1e-6)
        toxicity.PIECE = 1 << 20


def test_gradients_move_words_with_their_grams():
    bags = Bags.of(["bad stuff here", "good stuff here"] * 4)
    table, rows, bias = toxicity.trained(bags, np.arange(8), np.array([1, 0] * 4), 60, 0.2, 0.0)
    model = toxicity._model((table, rows, bias))
    bad, good, badly = (float(model.words(f" {w} ")[0]) for w in ("bad", "good", "badd"))
    assert bad > badly > good


def test_calibration():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * x - 1)))).astype(int)
    slope, shift = platt(x, y, np.ones(len(x)))
    assert slope == pytest.approx(1.5, abs=0.1) and shift == pytest.approx(-1, abs=0.1)
    assert platt(-x, y, np.ones(len(x)))[0] > 0


def test_unseen_spellings():
    """Endings and misspellings that training never saw are caught through shared n-grams; words of the others aren't."""
    rows = made(1600)
    model = fit([t for _, t in rows], [int(k % 4 == 0) for k, _ in rows], 0.5)
    fresh = made(400, 2)
    score = np.array([model.score(t) for _, t in fresh])
    toxic = np.array([k % 4 == 0 for k, _ in fresh])
    assert (score[toxic] >= 0.7).mean() > 0.95 and (score[~toxic] >= 0.7).mean() < 0.01
    clean = fresh[1][1]
    caught = [model.score(f"{clean} {w} {clean}") >= 0.7 for w in ("grumzxly", "wyvreks", "plochzer", "xgrumzx", "wyvrekk", "plochzz")]
    assert sum(caught) >= 5


def test_query(spark):
    rows = queries.op11_toxicity(spark, MEDIUM).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    tested = [(r.score, label[r.doc_id]) for r in rows if r.held_out and label.get(r.doc_id) is not None]
    up, down = [s for s, y in tested if y == 1], [s for s, y in tested if y == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a in up for b in down]) > 0.7  # some 34 noisy labels of class 1 to learn from
    assert np.mean([s >= 0.7 for s in down]) < 0.05


def test_held_out_labels_have_no_say(spark):
    rows = [(k, t) for k, t in made(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    make = lambda f: spark.createDataFrame([(k, f(k)) for k, _ in rows], "doc_id long, toxic int")
    score = lambda labels: sorted((r.doc_id, r.score) for r in toxicity_scores(docs, labels, rounds=1).collect())
    plain_ = score(make(lambda k: int(k % 4 == 0)))
    assert plain_ == score(make(lambda k: 1 - int(k % 4 == 0) if held(k) else int(k % 4 == 0)))
    assert plain_ == sorted((r.doc_id, r.score) for r in toxicity_scores(docs.repartition(7), make(lambda k: int(k % 4 == 0)).repartition(3), rounds=1).collect())


def test_odd_rows(spark):
    df = odd(spark)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 10)] + [(None, 1, 1), (1, None, None), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        rows = toxicity_scores(df, marks).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is not None, r.doc_id or 0) for r in df.collect())
        assert all(0 <= r.score <= 1 for r in rows) and len({round(r.score, 12) for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity_scores(df, labels.limit(0)).first().score == 0.5
    assert toxicity_scores(none(spark), labels).count() == 0
