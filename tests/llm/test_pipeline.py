from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tesserae.llm import exact_dedup, pii, quality_model, simhash
from tesserae.llm.components import components

from .helpers import odd
from .test_exact_dedup import plain as exact
from .test_near_jaccard import kept as similar
from .test_texts import check_packed


def test_stages(spark, sf_dir):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, seen[-1], sf_dir)
        assert df.columns == docs.columns, name
        seen.append(spark.createDataFrame(df.collect(), docs.schema))
    ids = [sorted(r.doc_id for r in df.collect()) for df in seen]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert ids[1] == sorted(r.doc_id for r in quality_model.quality_scores(docs, labels).collect() if r.predicted)
    assert ids[2] == sorted(r[0] for r in exact([(x.doc_id, x.text) for x in seen[1].collect()]) if r[3])
    assert ids[3] == similar({r.doc_id: r.text for r in seen[2].collect()})  # all pairs of five-word shingle sets, 0.8 or more
    assert ids[4] == ids[3]
    before = {r.doc_id: r.text for r in seen[3].collect()}
    spans = {r.doc_id: r.spans for r in pii.find(seen[3]).collect()}
    for r in seen[4].collect():
        text, at, out = before[r.doc_id] or "", 0, []
        for s in sorted(spans[r.doc_id], key=lambda s: (s.start, -s.end, s.kind)):
            if s.start >= at:
                out += [text[at : s.start], pii.KINDS[s.kind].mask]
            at = max(at, s.end)
        assert (r.text or "") == "".join(out) + text[at:]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    last = {r.doc_id: r.text or "" for r in seen[4].collect()}
    want = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for d, x in last.items()}
    rows = corpus_pipeline.STAGES[-1][1](spark, seen[4], sf_dir).collect()
    check_packed(rows, want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sum(r.length for r in again) == sum(r.length for r in rows)


NAMES = ("row", "doc", "kept", "__kept", "__t", "__n", "__p", "__o", "__spans", "__masked", "__email", "__ip", "__card", "__phone", "__row", "id", "n", "rank", "size", "digest", "body", "salt", "root", "x", "label", "fold", "score", "key", "a.b", "a`c")


def test_stages_keep_rows_and_columns(spark, sf_dir):
    """Repeated and null ids, and extra columns with the names that stages use: every row that stays has the values it came with, and the right rows stay."""
    base = odd(spark, extra=False).collect()
    rows = [(*r, *(f"{k}:{n}" for n in NAMES)) for k, r in enumerate(base)]
    rows.append((2, base[1].text + "  ", "en", "z", 9, *(f"long:{n}" for n in NAMES)))  # longer than the rows that it equals, and of a repeated id
    rows.append((None, base[6].text, "en", "z", 9, *(f"null:{n}" for n in NAMES)))
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n.replace('`', '``')}` string" for n in NAMES)])
    df = spark.createDataFrame(rows, schema).repartition(3)
    first = len(df.columns) - len(NAMES)
    by_tag = {r[first].split(":")[0]: r for r in map(tuple, df.collect())}
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, df, sf_dir)
        assert found.columns == df.columns and found.schema == df.schema, name
        got = list(map(tuple, found.collect()))
        out[name] = {r[first].split(":")[0] for r in got}
        assert len(out[name]) == len(got), f"{name} repeats a row"
        for r in got:
            want = by_tag[r[first].split(":")[0]]
            assert r[first:] == want[first:] and (r[0], r[2], r[3]) == (want[0], want[2], want[3]), name
            if name != "personal_data":
                assert r == want
        assert stage(spark, df.limit(0), sf_dir).count() == 0
    scores = {t: quality_model.quality_scores(df.filter(f"row = '{t}:row'"), spark.read.parquet(f"{sf_dir}/labels.parquet")).first().predicted for t in by_tag}
    assert out["quality"] == {t for t, p in scores.items() if p}
    groups: dict = {}
    for t, r in by_tag.items():
        groups.setdefault((r[1] or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}), []).append((t, r))
    for own in groups.values():
        stay = [(t, r) for t, r in own if t in out["exact_duplicates"]]
        assert len(stay) == 1
        named = [(-len(r[1] or ""), r[0]) for _, r in own if r[0] is not None]
        if named:
            assert (-len(stay[0][1][1] or ""), stay[0][1][0]) == min(named)
    assert out["personal_data"] == set(by_tag)
    packed = corpus_pipeline.STAGES[-1][1](spark, df, sf_dir)
    assert packed.filter("offset + length > 2048").count() == 0 and packed.count() >= len(rows) and corpus_pipeline.STAGES[-1][1](spark, df.limit(0), sf_dir).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    rng = np.random.default_rng(4)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (6001, 6000)]
    rng.shuffle(edges)
    out = {r.node: r.root for r in components(spark.createDataFrame([tuple(map(int, e)) for e in edges], "a long, b long")).collect()}
    assert {out[k] for k in range(301)} == {0} and {out[1000 + k] for k in range(200)} == {1000} and out[6001] == 6000 and 5000 not in out


def test_drops_leave_clean_documents(spark, sf_dir):
    docs = spark.createDataFrame([(k, f"document {k} " + " ".join(f"w{k * 100 + j}" for j in range(120))) for k in range(60)], "doc_id long, text string")
    assert exact_dedup.drop_exact(docs).count() == 60 and simhash.drop_near(docs, width=5).count() == 60
    assert pii.mask(docs).exceptAll(docs).count() == 0


def test_a_round_of_components_shuffles_thrice(spark):
    """A node's smallest neighbour is told by a window: nothing is joined back, so a round has a third of the stages and the driver a third of the tasks to keep account of."""
    from tesserae.llm.components import _star

    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (3, 4)], "a long, b long")
    plan = _star(_star(edges, True), False).distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 3 and "Join" not in plan
