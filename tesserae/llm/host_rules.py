"""Host-level quality rules: failures of a host's documents, shrunk by an empirical beta prior, decide on the host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_slices
from .common import SPACES, spread_join, stored

SYMBOLS = b"#*$%&|<>"
#: A host fails a rule if its shrunk rate is so many standard deviations of the prior beyond the prior's mean; the limit is kept between two shares.
FLOOR, CEILING, DEVIATIONS = 0.3, 0.5, 3.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that the text has twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        if k > 1:  # numbers of the pairs so far, so that the next product fits 64 bits for any text
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(index) + ids[k : k + n]
    _, where, often = np.unique(key, return_inverse=True, return_counts=True)
    inside = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(often[where] > 1)
    np.add.at(inside, hit, 1)
    np.add.at(inside, hit + width, -1)
    return int(np.count_nonzero(np.cumsum(inside[:-1])))


def _counts(text: str) -> tuple[int, ...]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), len(data) - len(data.translate(None, SYMBOLS)), again, repeated_words(words)


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts of every row's whole text (null: no words), with one flag for each rule that it fails."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            counts = np.array([_counts(t or "") for t in batch.column(2).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, counts.T.copy())], ["doc_id", "host", *COUNTS])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(each, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


#: Rules on a document; the first two are the base.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "duplicate_lines": "n_dup_lines > 0 and 10 * n_dup_lines > n_words",
}


def host_rates(counted: DataFrame) -> DataFrame:
    """One row per host: documents, and for each rule the failures, the rate shrunk by a beta prior fitted to all hosts by moments, and the limit.

    The limit of a rule lies ``DEVIATIONS`` standard deviations of its prior beyond the prior's mean, but between ``FLOOR`` and ``CEILING``:
    a host fails where it stands out among all hosts and much of it fails, or where half of it does.

    The prior's mean is the pooled rate. Its strength follows from the variance of the hosts' rates beyond the binomial one; where there
    is none (or one host only) the strength is the mean number of documents of a host. Hosts with no document don't occur; rows without
    a host count as one host.
    """
    flagged = counted.select("host", *[F.expr(rule).cast("long").alias(name) for name, rule in RULES.items()])
    hosts = flagged.groupBy("host").agg(F.count(F.lit(1)).alias("documents"), *[F.sum(name).alias(name) for name in RULES])
    n = F.col("documents")
    pooled = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum(n).alias("total"),
        F.sum(n * n).alias("squares"),
        *[F.sum(name).alias(f"{name}_sum") for name in RULES],
        *[F.sum(F.col(name) * F.col(name) / n).alias(f"{name}_square") for name in RULES],
    )
    prior = pooled.select(*[_prior(name).alias(f"{name}_prior") for name in RULES])
    rated = hosts.crossJoin(F.broadcast(prior))  # one row
    mean, strength = (lambda r: F.col(f"{r}_prior.mean")), (lambda r: F.col(f"{r}_prior.strength"))
    rates = [((F.col(r) + mean(r) * strength(r)) / (n + strength(r))).alias(f"{r}_rate") for r in RULES]
    limits = [F.least(F.lit(CEILING), F.greatest(F.lit(FLOOR), mean(r) + DEVIATIONS * F.sqrt(mean(r) * (1 - mean(r)) / (strength(r) + 1)))).alias(f"{r}_limit") for r in RULES]
    return rated.select("host", "documents", *RULES, *rates, *limits)


def _prior(name: str):
    """Mean and strength (a + b) of the beta prior: between-host variance as in a one-way random-effects model."""
    k, total, squares = F.col("hosts").cast("double"), F.col("total").cast("double"), F.col("squares").cast("double")
    mean = F.col(f"{name}_sum") / total
    binomial = mean * (1 - mean)
    # The expected weighted spread of the rates is (k - 1) binomial variances and (N - sum n^2 / N) variances between hosts.
    spread = F.col(f"{name}_square") - total * mean * mean
    between = (spread - (k - 1) * binomial) / F.nullif(total - squares / total, F.lit(0.0))
    strength = F.when((between > 0) & (binomial > 0), F.greatest(binomial / between - 1, F.lit(1.0))).otherwise(total / k)
    return F.struct(F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(strength, F.lit(1.0)).alias("strength"))


def host_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, host_failed and kept.

    base_failed: under 50 words, or over half of the words inside repeated windows. host_failed: the shrunk rate of one of ``RULES`` for
    the document's host is over the rule's limit (:func:`host_rates`). kept: neither. A null text has no words and fails; rows without a
    host share one entry and are never failed by it. Repeated rows count each. An empty table gives an empty result; other columns are
    ignored.
    """
    counted = stored(rule_counts(docs, id_col, text_col, host_col), "rule-counts")
    failed = F.greatest(*[F.col(f"{r}_rate") > F.col(f"{r}_limit") for r in RULES])
    bad = host_rates(counted).filter("host is not null").filter(failed).select("host", F.lit(True).alias("bad"))
    base = F.expr(f"({RULES['few_words']}) or ({RULES['repeats']})")
    joined = spread_join(counted, bad, ["host"], F.col("doc_id"))
    return joined.select("doc_id", *COUNTS, base.alias("base_failed"), F.col("bad").isNotNull().alias("host_failed"), (~base & F.col("bad").isNull()).alias("kept"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    flags = ", ".join(f"CAST({rule} AS INTEGER) AS {name}" for name, rule in RULES.items())
    sums = ", ".join(f"sum({name}) AS {name}" for name in RULES)
    moments = ", ".join(f"sum({name}) / sum(n)::DOUBLE AS {name}_mean, sum({name} * {name} / n::DOUBLE) AS {name}_square" for name in RULES)
    between = lambda r: f"(({r}_square - total * {r}_mean * {r}_mean) - (k - 1) * {r}_mean * (1 - {r}_mean)) / nullif(total - squares / total, 0)"
    strengths = ", ".join(f"CASE WHEN {between(r)} > 0 AND {r}_mean * (1 - {r}_mean) > 0 THEN greatest({r}_mean * (1 - {r}_mean) / ({between(r)}) - 1, 1) ELSE total / k END AS {r}_strength" for r in RULES)
    fails = " OR ".join(f"({r} + {r}_mean * {r}_strength) / (n + {r}_strength) > least({CEILING}, greatest({FLOOR}, {r}_mean + {DEVIATIONS} * sqrt({r}_mean * (1 - {r}_mean) / ({r}_strength + 1))))" for r in RULES)
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT rid, doc_id, source, text, list_filter(string_split_regex(text, '[ 	-
]+'), lambda x: x <> '') AS ws FROM d),
        places AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) > 2),
        often AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM places),
        repeated AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM often, (VALUES (0), (1), (2)) AS offsets(o) WHERE n > 1 GROUP BY 1),
        lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d), dups AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines WHERE regexp_matches(l, '[^ 	-
]') GROUP BY 1),
        c AS (SELECT doc_id, source AS host, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN repeated USING (rid) LEFT JOIN dups USING (rid)),
        f AS (SELECT host, {flags} FROM c), h AS (SELECT host, count(*) AS n, {sums} FROM f GROUP BY 1),
        m AS (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS total, sum(n * n)::DOUBLE AS squares, {moments} FROM h), p AS (SELECT *, {strengths} FROM m),
        bad AS (SELECT DISTINCT host FROM h, p WHERE host IS NOT NULL AND ({fails}))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({RULES["few_words"]}) OR ({RULES["repeats"]}) AS base_failed, bad.host IS NOT NULL AS host_failed,
            NOT (({RULES["few_words"]}) OR ({RULES["repeats"]})) AND bad.host IS NULL AS kept FROM c LEFT JOIN bad ON bad.host = c.host
    """
