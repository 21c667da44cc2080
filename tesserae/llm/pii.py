"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, expectation-maximisation estimates
their reliabilities, and a span classifier is trained on the resulting soft labels. All work on documents is DataFrame functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field, stored, whole


@dataclass(frozen=True)
class Kind:
    """Patterns are possessive where that changes no match, so that no text makes the regex engine backtrack or recurse over long runs."""

    name: str
    guard: str  #: a text without this has no candidate
    base: str  #: leftmost, non-overlapping matches; those that pass ``check`` are base spans
    check: str  #: SQL on ``m``
    extra: str  #: more candidates, in what the base pattern leaves
    known: str  #: SQL on ``m``: the gazetteer knows a part of it
    cue: str  #: words just before that speak for the kind
    mask: str


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"""case when length({_DIGITS}) between 13 and 19 then pmod(aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) ->
    case when d = '' then 0 when i % 2 = 0 then cast(d as int) else cast(d as int) * 2 - (case when cast(d as int) > 4 then 9 else 0 end) end), 0, (a, x) -> a + x), 10) = 0 else false end"""
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Top-level domains, calling codes and card issuers' first digits.
DOMAINS = "com|org|net|edu|gov|mil|info|biz|io|co|us|uk|de|fr|es|it|nl|be|ch|at|pt|pl|se|no|dk|fi|ie|eu|ca|mx|br|ar|cl|au|nz|jp|cn|kr|in|ru|za|example"
CALLING = "1|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|7|81|82|84|86|90|91|92|93|94|95|98|351|352|353|354|358|359|370|371|372|380|385|386|420|421"
ISSUERS = "4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|30[0-5]|36|38|35|6011|64[4-9]|65|62"

#: In the order of the result.
KINDS = (
    Kind(
        "email",
        "contains(__t, '@') or lower(__t) rlike '[(\\\\[{]at[)\\\\]}]'",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?+(?:\(at\)|\[at\]|\{at\}) ?+[A-Za-z0-9-]++(?: ?+(?:\(dot\)|\[dot\]|\{dot\}|\.) ?+[A-Za-z0-9-]++)++",
        f"lower(m) rlike '(?:[.)}}\\\\]] ?)(?:{DOMAINS})$'",
        "e-?mail|mail|contact|write|reach",
        "<EMAIL>",
    ),
    Kind(
        "ip",
        "__t rlike '[0-9][.]' or contains(__t, ':')",
        r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        rf"m rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'",
        r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
        "m rlike '^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[.]' and not m rlike '^127[.]'",
        "ip|host|server|client|address|from|login",
        "<IP>",
    ),
    Kind(
        "card",
        "__t rlike '[0-9][ -]?[0-9]'",
        r"[0-9](?:[\x20-]?+[0-9])++",
        _LUHN,
        r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
        f"{_DIGITS} rlike '^(?:{ISSUERS})' and length({_DIGITS}) between 13 and 19",
        "card|visa|master|amex|credit|debit|payment",
        "<CARD>",
    ),
    Kind(
        "phone",
        "__t rlike '[0-9]'",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        f"length({_DIGITS}) between 9 and 15",
        r"(?<![0-9.+-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9.-])",
        f"case when m like '+%' then {_DIGITS} rlike '^(?:{CALLING})' else {_DIGITS} rlike '^[2-9][0-9]{{2}}[2-9]' end",
        "phone|tel|call|mobile|cell|fax|whatsapp|sms",
        "<PHONE>",
    ),
)
#: Words just before a candidate that speak against any kind.
AGAINST = "version|release|isbn|issn|order|serial|section|chapter|figure|table|article|total|id|no"
NEAR = 24
LABELERS = ("regex", "gazetteer", "context")
#: Matches a block of running sums, and code points a piece of a text that is masked.
BLOCK, PIECE = 256, 1024
#: A candidate's features for the classifier: each has a few values, so that all combinations together are few.
FEATURES = ("extra", "size", "digits", "marks", "joined_left", "joined_right", "cue")


def _q(s: str) -> str:
    return "r'" + s.replace("'", "\\'") + "'"


def _starts(lengths: str) -> str:
    """SQL: where each match begins, from an array of struct(gap, size) of code points before and in each match.

    A growing array is copied at every step, so the sums run over blocks of matches: time stays in proportion to their number.
    """
    blocks = f"transform(sequence(0, cast((size({lengths}) - 1) / {BLOCK} as int)), b -> slice({lengths}, b * {BLOCK} + 1, {BLOCK}))"
    inner = "aggregate(block, named_struct('at', acc.at, 'out', cast(array() as array<int>)), (i, x) -> named_struct('at', i.at + x.gap + x.size, 'out', concat(i.out, array(i.at + x.gap))), i -> i.out)"
    total = "aggregate(block, 0, (n, x) -> n + x.gap + x.size)"
    step = f"named_struct('at', acc.at + {total}, 'out', concat(acc.out, array({inner})))"
    return f"aggregate({blocks}, named_struct('at', 0, 'out', cast(array() as array<array<int>>)), (acc, block) -> {step}, acc -> flatten(acc.out))"


def _candidates(kind: Kind, text: str, pattern: str, extra: int) -> str:
    """SQL: array of struct(a, z, base, votes, features) for the matches of ``pattern`` in column ``text``; places from the lengths of what lies between."""
    matches, between = f"regexp_extract_all({text}, {_q(pattern)}, 0)", f"split({text}, {_q(pattern)}, -1)"
    zipped = f"zip_with(slice({between}, 1, size({matches})), {matches}, (s, m) -> struct(s, m))"
    nexts = f"slice({between}, 2, size({matches}))"
    # One element that is the array of lengths, so that it is made once.
    starts = f"flatten(transform(array(transform({zipped}, x -> named_struct('gap', length(x.s), 'size', length(x.m)))), lengths -> {_starts('lengths')}))"
    item = f"zip_with(zip_with({zipped}, {nexts}, (x, r) -> struct(x.s as s, x.m as m, r as r)), {starts}, (x, a) -> struct(x.s as s, x.m as m, x.r as r, a))"
    left = f"lower(right(x.s, {NEAR}))"
    # `m` in a kind's SQL is the match
    of = lambda sql: f"exists(array(x.m), m -> ({sql}))"
    passed = "false" if extra else of(kind.check)
    regex = "0" if extra else f"case when {of(kind.check)} then 1 else -1 end"
    cue = f"case when {left} rlike '\\\\b(?:{kind.cue})[^a-z0-9]*(?:[a-z]{{1,6}}[^a-z0-9]+)?$' then 1 when {left} rlike '\\\\b(?:{AGAINST})[^a-z0-9]*$' then -1 else 0 end"
    digits = "length(regexp_replace(x.m, '[^0-9]', ''))"
    feature = {
        "extra": str(extra),
        "size": "least(7, cast(length(x.m) / 4 as int))",
        "digits": f"cast(round(4 * {digits} / length(x.m)) as int)",
        "marks": "least(3, length(regexp_replace(x.m, '[A-Za-z0-9]', '')))",
        "joined_left": "cast(right(x.s, 1) rlike '[A-Za-z0-9_.=/-]' as int)",
        "joined_right": "cast(substring(x.r, 1, 1) rlike '[A-Za-z0-9_=/-]' as int)",
        "cue": cue,
    }
    votes = f"named_struct('regex', {regex}, 'gazetteer', case when {of(kind.known)} then 1 else -1 end, 'context', {cue})"
    struct = f"named_struct('a', x.a, 'z', x.a + length(x.m), 'base', {passed}, 'votes', {votes}, 'features', named_struct({', '.join(f'{k!r}, {v}' for k, v in feature.items())}))"
    return f"transform({item}, x -> {struct})"


def _empty() -> str:
    zeros = ", ".join(f"'{f}', 0" for f in FEATURES)
    votes = ", ".join(f"'{v}', 0" for v in LABELERS)
    return f"filter(array(named_struct('a', 0, 'z', 0, 'base', false, 'votes', named_struct({votes}), 'features', named_struct({zeros}))), x -> false)"


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and for each kind a column ``__<kind>`` with its candidate spans (a, z in code points, end exclusive), their votes and features."""
    out = {}
    for kind in KINDS:
        # What the base pattern matched, passed or not, is blanked for the other pattern; the length stays.
        parts = f"zip_with(split(__t, {_q(kind.base)}, -1), regexp_extract_all(__t, {_q(kind.base)}, 0), (s, m) -> array(s, coalesce(repeat('\\u0001', length(m)), '')))"
        rest = f"array_join(flatten({parts}), '')"
        more = f"case when __t rlike {_q(kind.extra)} then {_candidates(kind, rest, kind.extra, 1)} else {_empty()} end"
        base = f"case when __t rlike {_q(kind.base)} then {_candidates(kind, '__t', kind.base, 0)} else {_empty()} end"
        out[f"__{kind.name}"] = F.expr(f"case when {kind.guard} then concat({base}, {more}) else {_empty()} end")
    return docs.withColumn("__t", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumns(out)


def _spans(found: DataFrame) -> DataFrame:
    """A row per candidate: kind (its number), votes and features."""

    def own(i: int, name: str) -> Column:
        return F.transform(F.col(f"__{name}"), lambda c: F.struct(F.lit(i).alias("kind"), c["votes"].alias("votes"), c["features"].alias("features")))

    each = F.concat(*[own(i, k.name) for i, k in enumerate(KINDS)])
    return found.select(F.explode(each).alias("c")).select("c.kind", "c.votes.*", *[F.col(f"c.features.{f}").alias(f"f_{f}") for f in FEATURES])


def reliabilities(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (kind, votes, count), of which there are 3 ** labelers a kind at most.

    Labelers vote -1, 0 (abstain) or 1, independently given whether the span is of the kind. Returns the posterior of each pattern, the
    share of true spans by kind, and P(vote | truth) by kind, labeler, truth and vote. It starts from labelers that are right four times
    in five, with counts of one case smoothed in, so that labelers that never vote are no harm and no patterns give the start.
    """
    kinds = len(KINDS)
    kind = np.array([p[0] for p in patterns], int)
    votes = np.array([p[1] for p in patterns], int).reshape(-1, len(LABELERS)) + 1
    count = np.array([p[2] for p in patterns], float)
    start = np.array([[0.45, 0.4, 0.15], [0.15, 0.4, 0.45]])
    table = np.tile(start, (kinds, len(LABELERS), 1, 1))
    share = np.full(kinds, 0.5)
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        log = [np.log(share[kind] if y else 1 - share[kind]) + sum(np.log(table[kind, j, y, votes[:, j]]) for j in range(len(LABELERS))) for y in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        for y, weight in ((0, (1 - new) * count), (1, new * count)):
            for k in range(kinds):
                own = kind == k
                for j in range(len(LABELERS)):
                    table[k, j, y] = np.bincount(votes[own, j], weight[own], 3) + 3 * start[y]
                    table[k, j, y] /= table[k, j, y].sum()
        share = np.array([((new * count)[kind == k].sum() + 1) / (count[kind == k].sum() + 2) for k in range(kinds)])
        done, post = len(new) == 0 or np.abs(new - post).max() < 1e-9, new
        if done:
            break
    return post, share, table


def _design(kind: np.ndarray, features: np.ndarray) -> np.ndarray:
    """One-hot kind by feature value."""
    width, columns = 9, []
    for k in range(len(KINDS)):
        own = (kind == k).astype(float)
        columns.append(own)
        columns += [own * (features[:, j] + 1 == v) for j in range(features.shape[1]) for v in range(width)]
    return np.array(columns).T


def train(kind: np.ndarray, features: np.ndarray, soft: np.ndarray, count: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method on feature combinations with soft labels and counts; ``penalty`` on squared weights."""
    x = _design(kind, features)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (count * (soft - p)) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(found: DataFrame, limit: float = 0.9) -> list[str]:
    """Codes of the kinds and feature combinations that the classifier gives a probability over ``limit``, from all candidates of ``found``.

    Votes and features take few values, so the table of their combinations that reaches the driver has a fixed bound.
    """
    rows = _spans(found).groupBy("kind", *LABELERS, *[F.col(f"f_{f}") for f in FEATURES]).count().collect()
    if not rows:
        return []
    rows.sort(key=lambda r: tuple(r)[:-1])
    seen: dict[tuple, float] = {}
    for r in rows:
        key = (r["kind"], tuple(r[j] for j in LABELERS))
        seen[key] = seen.get(key, 0) + r["count"]
    patterns = sorted((k, v, n) for (k, v), n in seen.items())
    belief = {(k, v): p for (k, v, _), p in zip(patterns, reliabilities(patterns)[0], strict=True)}
    kind = np.array([r["kind"] for r in rows])
    features = np.array([[r[f"f_{f}"] for f in FEATURES] for r in rows])
    soft = np.array([belief[r["kind"], tuple(r[j] for j in LABELERS)] for r in rows])
    w = train(kind, features, soft, np.array([r["count"] for r in rows], float))
    p = 1 / (1 + np.exp(-_design(kind, features) @ w))
    return sorted({",".join(map(str, [k, *f])) for k, f, x in zip(kind.tolist(), features.tolist(), p, strict=True) if x > limit})


def chosen(accepted: list[str]) -> Column:
    """Of the candidate columns: base spans, and others with an accepted code, as an array of struct(kind number, start, end, base) by kind, then start."""
    good = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<string>")

    def kept(i: int, name: str) -> Column:
        code = lambda c: F.concat_ws(",", F.lit(str(i)), *[c["features"][f].cast("string") for f in FEATURES])
        some = F.filter(F.col(name), lambda c: c["base"] | F.array_contains(good, code(c)))
        return F.array_sort(F.transform(some, lambda c: F.struct(F.lit(i).alias("kind"), c["a"].alias("start"), c["z"].alias("end"), c["base"].alias("base"))))

    return F.concat(*[kept(i, f"__{k.name}") for i, k in enumerate(KINDS)])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.9) -> DataFrame:
    """One row per input row: doc_id and spans, an array of struct(kind number, start, end, base) by kind, then start.

    Base spans always stay; other candidates are added if the classifier gives them a probability over ``limit``. All candidates of all
    rows vote. A null or empty text has no spans, a null id is carried, repeated rows count and are answered each, an empty table gives
    an empty result, and other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(candidates(rows).drop("text", "__t"), "pii-candidates")
    return found.select("doc_id", chosen(learn(found, limit)).alias("spans"))


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _piece(start: str, end: str) -> str:
    """SQL: code points [start, end) of the text that ``__p`` holds in pieces; ``substring`` would walk from the text's beginning each time."""
    k = PIECE
    first, last = f"cast({start} / {k} as int)", f"cast(({end} - 1) / {k} as int)"
    return f"""case when {end} <= {start} then '' when {first} = {last} then substring(__p[{first}], {start} % {k} + 1, {end} - {start})
        else concat(substring(__p[{first}], {start} % {k} + 1, {k}), array_join(slice(__p, {first} + 2, {last} - {first} - 1), ''), substring(__p[{last}], 1, ({end} - 1) % {k} + 1)) end"""


def mask(docs: DataFrame, text_col: str = "text", limit: float = 0.9) -> DataFrame:
    """``docs`` with each span of a text replaced by its kind's mark; other columns and null texts stay as they are.

    Spans are replaced from the left, the longer first; one that overlaps the one before goes with it.
    """
    found = candidates(docs.select(whole(docs), F.col(text_col).alias("text")))
    accepted = learn(found, limit)
    marks = "array(" + ", ".join(f"'{k.mask}'" for k in KINDS) + ")"
    ordered = "array_sort(__spans, (x, y) -> case when x.start <> y.start then x.start - y.start when x.end <> y.end then y.end - x.end else x.kind - y.kind end)"
    blocks = f"transform(sequence(0, cast((size(__o) - 1) / {BLOCK} as int)), b -> slice(__o, b * {BLOCK} + 1, {BLOCK}))"
    step = f"""case when s.end <= i.at then i when s.start < i.at then named_struct('at', s.end, 'out', i.out)
        else named_struct('at', s.end, 'out', concat(i.out, array({_piece("i.at", "s.start")}, {marks}[s.kind]))) end"""
    inner = f"aggregate(block, named_struct('at', acc.at, 'out', cast(array() as array<string>)), (i, s) -> {step}, i -> array_join(i.out, ''))"
    reach = "greatest(acc.at, aggregate(block, 0, (n, s) -> greatest(n, s.end)))"
    outer = f"aggregate({blocks}, named_struct('at', 0, 'out', cast(array() as array<string>)), (acc, block) -> named_struct('at', {reach}, 'out', concat(acc.out, array({inner}))), acc -> concat(array_join(acc.out, ''), {_piece('acc.at', '__n')}))"
    spans = found.withColumn("__spans", chosen(accepted))
    cut = spans.withColumns({"__o": F.expr(ordered), "__n": F.length("__t"), "__p": F.when(F.size("__spans") > 0, F.regexp_extract_all("__t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))})
    out = cut.withColumn("__masked", F.expr(f"case when size(__spans) = 0 then __t else {outer} end"))
    return out.select(*[F.when(field(c).isNotNull(), F.col("__masked")).alias(c) if c == text_col else field(c).alias(c) for c in docs.columns])
