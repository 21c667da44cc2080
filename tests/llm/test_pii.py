"""Personal data against a plain version of the base contract, and what the model adds."""

from __future__ import annotations

import hashlib
import re
import time

import numpy as np
import pytest

from tesserae.llm import pii, queries

from .helpers import none, odd, texts

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def passes(kind: str, m: str) -> bool:
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[str]:
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p in BASE.items() for m in re.finditer(p, text, re.ASCII) if passes(kind, m[0])]


TRICKY = [
    "mail a.b@x.org, a@b and c@d.e.f. then x@y..z and q@w.e-r", "1.2.3.4 256.1.1.1 1.2.3.4.5 10.20.30.400 00012.1.1.1 1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 5500000000000004x 41111111111111114111111111111111", "+1 (555) 010-9999, +49.30.1234567- +1-2 ++3 44 55 66 77 8", "😀 +33 1 23 45 67 89 é a@é.fr é@b.fr",
    "a@b.c@d.e", "@a.b x@.y %@a.b", "1" * 3000, "+" + "1" * 3000, "a" * 3000 + "@" + "b" * 3000 + ".c", "1.2.3.4" * 500, "0 " * 2000,
]


def test_base_spans(spark):
    rows = pii.find(spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")).select("doc_id", "spans").collect()
    names = [k.name for k in pii.KINDS]
    for r in rows:
        assert [f"{names[s.kind]}:{s.start}:{s.end}" for s in r.spans if s.base] == base_spans(TRICKY[r.doc_id]), TRICKY[r.doc_id][:60]


def test_query(spark, sf_dir):
    docs = texts(spark, sf_dir)
    rows = queries.op1_weak_pii(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in spans) for k in BASE)
        assert set(spans) <= set(r.spans.split(",")) | {""}


def test_model_adds_spans(spark):
    rows = [(k, f"Please contact {n} (at) mail{k}.org or call tel (555) 234-{k + 1000} today; see host {k % 200 + 1}.2.3.4 too.") for k, n in enumerate(["ann", "bob", "cy", "dee"] * 40)]
    rows += [(1000 + k, f"write to ann{k}@mail.org soon, chapter 234 555-1{k}") for k in range(200)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = [s for r in found for s in r.spans if not s.base]
    assert sum(s.kind == 0 for s in added) > 100 and sum(s.kind == 3 for s in added) > 100


def test_mask(spark):
    text = "Write a.b@x.org or +1 555 010 9999 from 1.2.3.4 with 4111 1111 1111 1111."
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", None), (4, "nothing", "k")], "doc_id long, text string, keep string")
    rows = {r.doc_id: r for r in pii.mask(df).collect()}
    assert rows[1].text == "Write <EMAIL> or <PHONE> from <IP> with <CARD>."
    assert rows[2].text is None and rows[3].text == "" and rows[4].text == "nothing" and rows[1].keep == "k"


def test_long_texts_take_time_in_proportion(spark):
    """A megabyte of addresses, found and masked; a list that is copied at every match would take minutes."""
    many = 125_000
    df = spark.createDataFrame([(1, "1.2.3.4 " * many)], "doc_id long, text string")
    began = time.perf_counter()
    row = pii.find(df).selectExpr("size(spans) as n", "spans[1].start as second", "element_at(spans, -1).end as last").first()
    assert tuple(row) == (many, 8, 8 * many - 1)
    assert pii.mask(df).selectExpr("md5(text)").first()[0] == hashlib.md5(b"<IP> " * many).hexdigest()
    assert time.perf_counter() - began < 60


def test_mask_of_overlapping_spans_over_pieces(spark):
    """Spans that overlap, in texts of several pieces and with characters of several bytes, against a plain loop."""
    rng = np.random.default_rng(8)
    parts = ["+49 170 1234567 ", "4111 1111 1111 1111 ", "é😀 " * 40, "10.0.0.1@x.org ", "+1 4111 1111 1111 1111 ", "text " * 300]
    said = ["".join(parts[k] for k in rng.integers(0, len(parts), 60)) for _ in range(30)] + ["+1 4111 1111 1111 1111 " * 700]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    for r in pii.mask(df).collect():
        text, at, out = said[r.doc_id], 0, []
        for s in sorted(spans[r.doc_id], key=lambda s: (s.start, -s.end, s.kind)):
            if s.start >= at:
                out += [text[at : s.start], pii.KINDS[s.kind].mask]
            at = max(at, s.end)
        assert r.text == "".join(out) + text[at:]


def test_odd_rows(spark):
    df = odd(spark)
    assert pii.find(df).count() == df.count()
    assert pii.mask(df).columns == df.columns and pii.mask(df).count() == df.count()
    assert pii.find(none(spark)).count() == 0 and pii.mask(none(spark)).count() == 0


def test_reliabilities():
    """Three labelers of unlike quality, each better than a guess, as identifying them needs."""
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    votes = [np.where(rng.random(20_000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.7)]
    seen: dict = {}
    for v in zip(*votes, strict=True):
        seen[tuple(int(x) for x in v)] = seen.get(tuple(int(x) for x in v), 0) + 1
    _, share, table = pii.reliabilities([(0, v, n) for v, n in seen.items()])
    assert share[0] == pytest.approx(0.3, abs=0.05)
    assert [table[0, k, 1, 2] for k in range(3)] == pytest.approx([0.95, 0.9, 0.7], abs=0.05)
