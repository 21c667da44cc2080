"""Licence recognition by sentence rules: normalised sentences map to identifiers, and sequences of identifiers match ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of licences after "licensed under the" and the like, normalised, and their identifiers.
NAMES = {
    "mit license": "MIT", "mit": "MIT", "expat license": "MIT", "isc license": "ISC", "zlib license": "Zlib",
    "bsd license": "BSD", "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "simplified bsd license": "BSD-2-Clause",
    "new bsd license": "BSD-3-Clause", "modified bsd license": "BSD-3-Clause", "unlicense": "Unlicense", "boost software license version 1.0": "BSL-1.0",
    "apache license": "Apache", "apache license version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache 2.0 license": "Apache-2.0",
    "apache license version 1.1": "Apache-1.1", "mozilla public license version 1.1": "MPL-1.1", "mozilla public license version 2.0": "MPL-2.0",
    "mozilla public license 2.0": "MPL-2.0", "eclipse public license version 1.0": "EPL-1.0", "eclipse public license version 2.0": "EPL-2.0",
    "eclipse public license 2.0": "EPL-2.0", "european union public license version 1.2": "EUPL-1.2", "artistic license 2.0": "Artistic-2.0",
    "open software license version 3.0": "OSL-3.0", "open database license": "ODbL-1.0", "sil open font license version 1.1": "OFL-1.1",
    "gnu general public license": "GPL", "gnu lesser general public license": "LGPL", "gnu affero general public license": "AGPL",
    "gnu free documentation license": "GFDL", "public domain": "Public-Domain", "cc0": "CC0-1.0", "cc0 1.0": "CC0-1.0", "cc0 1.0 universal": "CC0-1.0",
}
# Families that come in versions; names follow from them in NUMBERED.
GNU = {"gnu general public license": ("GPL", "2.0 3.0"), "gnu lesser general public license": ("LGPL", "2.1 3.0"), "gnu affero general public license": ("AGPL", "3.0")}
CREATIVE = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
CREATIVE_VERSIONS = "1.0 2.0 2.5 3.0 4.0".split()

# Sentences of licence texts and headers, as they are written.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at",
    "apache-copy-url": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. ",
    "two": "2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "json-good": "The Software shall be used for Good, not Evil.",
}
# Headings of licences that are quoted whole, and their identifiers.
HEADS = {
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": "GPL-2.0",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "GPL-3.0",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "LGPL-2.1",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "LGPL-3.0",
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "AGPL-3.0",
    "Apache License Version 2.0, January 2004": "Apache-2.0",
    "Mozilla Public License Version 2.0": "MPL-2.0",
    "Eclipse Public License - v 1.0": "EPL-1.0",
    "Eclipse Public License - v 2.0": "EPL-2.0",
    "Boost Software License - Version 1.0 - August 17th, 2003": "BSL-1.0",
    "CC0 1.0 Universal": "CC0-1.0",
}
#: Sentences with a variable part (holder, organisation, kind of work), as patterns on normalised sentences that Java and RE2 read alike.
_ENDORSE = "may (?:not )?be used to endorse or promote products derived from this [a-z]+ without specific prior written permission"
_DAMAGES = "for any direct indirect incidental special exemplary or consequential damages"
SLOTS = (
    ("bsd-names", f"neither the names? of .+ {_ENDORSE}"),
    ("bsd-names", f"the names? of .+ {_ENDORSE}"),
    ("bsd-as-is", "this [a-z]+ is provided by .+ as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-liability", f"in no event shall .+ be liable {_DAMAGES} .+ even if advised of the possibility of such damages?"),
    ("mit-liability", "in no event shall .+ be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the [a-z]+ or the use or other dealings in the [a-z]+"),
    ("isc-as-is", "the [a-z]+ is provided as is and .+ disclaims? all warranties with regard to this [a-z]+ including all implied warranties of merchantability and fitness"),
    ("isc-liability", "in no event shall .+ be liable for any special direct indirect or consequential damages or any damages whatsoever .+ in connection with the use or performance of this [a-z]+"),
    ("bsd-advert", "all advertising materials mentioning features or use of this [a-z]+ must display the following acknowledge?ment( this product includes .+)?"),
    ("gnu-hope", "this [a-z]+ is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gnu-see", "see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("gnu-received", "you should have received a copy of the gnu (?:lesser |library |affero )?general public license .+"),
)
#: Nothing but these can begin a sentence with a variable part.
SLOT_STARTS = "(?:neither the name|the name|this|in no event shall|the|all advertising materials|see the gnu|you should have received) .+"
#: Sentences that stand between a licence's own without parting them: copyright lines, numbers of list items.
THROUGH = "(?:all rights reserved|copyright .+|c [0-9]+ .+|[0-9]{1,2}|[a-z])"
#: Family (1), version (2) and whether later ones are allowed (3) of a GNU header.
GNU_HEADER = "[a-z ]+ is free software you can redistribute it and or modify it under the terms of the (gnu (?:lesser |library |affero )?general public license)(?: as published by the free software foundation)?(?: either)? version ([0-9.]+)(?: of the license)?( or at your option any later version| or any later version)?"
SPDX_TAG = "spdx license identifier .+"
# Ordered rules. A rule is a licence and a sequence of sentence identifiers; sentences that a rule matched are spent.
RULES = [
    ("BSD-4-Clause", "bsd-grant bsd-source bsd-binary bsd-advert bsd-names bsd-as-is bsd-liability"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-names bsd-as-is bsd-liability"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-as-is bsd-liability"),
    ("JSON", "mit-grant mit-notice json-good mit-as-is mit-liability"),
    ("MIT", "mit-grant mit-notice mit-as-is mit-liability"),
    ("ISC", "isc-grant isc-as-is isc-liability"),
    ("Apache-2.0", "apache-grant apache-copy apache-url apache-as-is apache-see"),
    ("Apache-2.0", "apache-grant apache-copy-url apache-as-is apache-see"),
    ("Apache-2.0", "apache-grant"),
    ("MPL-2.0", "mpl-subject two mpl-copy"),
    ("Unlicense", "unlicense-domain unlicense-anyone"),
    ("Public-Domain", "unlicense-domain"),
]


def _numbered() -> dict[str, str]:
    """Names that follow from a family and a version."""
    out = {}
    for name, (short, versions) in GNU.items():
        for v in versions.split():
            for said in {v, v.removesuffix(".0")}:
                for form in ("{} version {}", "{} v{}", "{} {}"):
                    out[form.format(name, said)] = f"{short}-{v}-only"
                    out[form.format(name, said) + " or later"] = f"{short}-{v}-or-later"
    for short, long in CREATIVE.items():
        for v in CREATIVE_VERSIONS:
            spdx = f"CC-{short.upper().replace(' ', '-')}-{v}"
            out |= {f"cc {short} {v}": spdx, f"creative commons {long} {v} international license": spdx, f"creative commons {long} {v} license": spdx}
    return out


def _clean(s: str) -> str:
    import re

    return re.sub("[^a-z0-9.]+", " ", s.lower()).strip(" .")


def known() -> dict[str, str]:
    """Normalised sentence to identifier; ``head:``, ``under:`` and a licence is a heading or a statement that names one."""
    out = {_clean(s): k for k, s in SENTENCES.items()}
    out = {("under " + s.removeprefix("licensed under the ") if s.startswith("licensed under the ") else s): k for s, k in out.items()}
    out |= {_clean(s): f"head:{spdx}" for s, spdx in HEADS.items()}
    return out | {f"under {name}": f"under:{spdx}" for name, spdx in (NAMES | _numbered()).items()}


def spdx_names() -> dict[str, str]:
    """Identifiers by their lower case."""
    return {x.lower(): x for x in sorted({*NAMES.values(), *_numbered().values(), *HEADS.values(), *(r[0] for r in RULES), "Classpath-exception-2.0", "LLVM-exception", "GCC-exception-3.1"})}


#: Whole-text replacements (pattern, replacement), which Java and RE2 read alike: \x01 ends a sentence, other line feeds end a line of it.
STEPS = (
    (r"licence", "license"),
    (r"(^|[^a-z])(inc|ltd|corp|co)[.]([ \t\r\n])", r"\1\2\3"),  # no end of a sentence
    (r"\n[ \t*#/-]*[(]?(?:[0-9]{1,2}|[a-z])[.)][ \t]+", "\x01"),  # the mark of a list item
    (r"[.!?]+[ \t\r\n]+|\n[ \t\r]*\n", "\x01"),
    (r"[^a-z0-9.\x01\n]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"(^|[\x01\n]) ?(?:(?:this|the) [a-z]+ is )?(?:dual |multi )?(?:licensed|licenced|released|distributed|published|provided|available|offered)[ \n]under[ \n](?:the[ \n])?(?:terms of the )?", r"\1under "),
)


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\x01", "\\u0001").replace("\n", "\\n") + "'"


def _classified(w: str, match, extract, of_names) -> str:  # noqa: ANN001
    """SQL: a normalised sentence's identifier, empty for one that is passed over, ``-`` for an unknown one; ``match`` and ``extract`` are the engine's."""
    table = known()
    inside = ", ".join(map(_plain_q, table))
    slots = " ".join(f"WHEN {match(w, pattern)} THEN '{k}'" for k, pattern in SLOTS)
    version = extract(w, GNU_HEADER, 2)
    family = " ".join(f"WHEN '{name}' THEN '{short}'" for name, (short, _) in (GNU | {"gnu library general public license": ("LGPL", "")}).items())
    gnu = f"'gnu:' || CASE {extract(w, GNU_HEADER, 1)} {family} END || '-' || {version} || CASE WHEN {version} LIKE '%.%' THEN '' ELSE '.0' END || CASE WHEN {extract(w, GNU_HEADER, 3)} = '' THEN '-only' ELSE '-or-later' END"
    # `or later` belongs to an identifier, any other `or` joins two
    tag = f"replace(replace(replace(replace(substr({w}, 25), ' or later', '-or-later'), ' or ', '|OR|'), ' and ', '|AND|'), ' with ', '|WITH|')"
    return f"""CASE WHEN {w} IN ({inside}) THEN {of_names(w, table, None)} WHEN {match(w, THROUGH)} OR {w} = '' THEN '' WHEN {match(w, SPDX_TAG)} THEN 'spdx:' || {of_names(tag, spdx_names(), "|")}
        WHEN {match(w, GNU_HEADER)} THEN {gnu} WHEN {match(w, SLOT_STARTS)} THEN CASE {slots} ELSE '-' END ELSE '-' END"""


def _plain_q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spark_names(value: str, table: dict[str, str], parts: str | None) -> str:
    entries = "map(" + ", ".join(f"{_q(k)}, {_q(v)}" for k, v in table.items()) + ")"
    if parts is None:
        return f"element_at({entries}, {value})"
    return f"array_join(transform(split({value}, '[|]'), p -> coalesce(try_element_at({entries}, replace(btrim(p), ' ', '-')), replace(btrim(p), ' ', '-'))), ' ')"


def _duck_names(value: str, table: dict[str, str], parts: str | None) -> str:
    entries = "MAP {" + ", ".join(f"{_plain_q(k)}: {_plain_q(v)}" for k, v in table.items()) + "}"
    if parts is None:
        return f"{entries}[{value}]"
    return f"array_to_string(list_transform(string_split({value}, '|'), lambda p: coalesce({entries}[replace(trim(p), ' ', '-')], replace(trim(p), ' ', '-'))), ' ')"


#: What follows a GNU header; a rule takes as much of it as is there.
GNU_RULE = "<gnu:([^>]+)>(?:<gnu-hope>)?(?:<gnu-see>)?(?:<gnu-received>)?"
NAMED = ("head", "spdx", "under")


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences and seq: the identifiers of the known sentences of every row's whole text in order, each as ``<id>``.

    A text is cut into sentences after ``.``, ``!`` or ``?`` before white space and at empty lines; a sentence that isn't known whole, or
    begins with an SPDX tag, is looked up line by line. Normalised: lower case, all but letters, digits and dots a space, dots and spaces at the ends gone, and the
    many ways to say "licensed under the" one. Unknown text between known sentences is ``<->``, so that no rule matches across it;
    copyright lines and numbers of list items are passed over.
    """
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for pattern, to in STEPS:
        text = F.regexp_replace(text, F.expr(_q(pattern)), F.expr(_q(to.replace("\\", "$"))))
    match = lambda w, p: f"{w} rlike {_q('^(?:' + p + ')$')}"
    extract = lambda w, p, k: f"regexp_extract({w}, {_q('^(?:' + p + ')$')}, {k})"
    one = lambda w: f"element_at(transform(array({w}), w -> {_classified('w', match, extract, _spark_names)}), 1)"
    lines = f"transform(split(s, '\n'), l -> {one(_trimmed('l'))})"
    whole = f"transform(array({one(_trimmed('s'))}), k -> case when (k = '-' or k like 'spdx:%') and contains(s, '\n') then {lines} else array(k) end)[0]"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.split(text, "\x01").alias("sentences"))
    n = F.size(F.filter("sentences", lambda s: F.btrim(s, F.lit(" .\n")) != "")).cast("long")
    units = rows.select("doc_id", n.alias("n_sentences"), F.expr(f"flatten(transform(sentences, s -> {whole}))").alias("units"))
    seq = "regexp_replace(regexp_replace(array_join(transform(filter(units, u -> u <> ''), u -> concat('<', u, '>')), ''), '(?:<->)+', '<->'), '^<->|<->$', '')"
    return units.select("doc_id", "n_sentences", F.expr(f"case when exists(units, u -> u not in ('', '-')) then {seq} else '' end").alias("seq"))


def _trimmed(s: str) -> str:
    return f"btrim(replace({s}, '\n', ' '), ' .')"


def matched(seq: Column) -> Column:
    """struct(rest, licences): ordered rules over a row's sequence; a rule's matches become ``;``. Headings, tags and statements come last."""
    steps = F.array(*[F.struct(F.lit(spdx).alias("licence"), F.lit("".join(f"<{i}>" for i in ids.split())).alias("seq")) for spdx, ids in RULES])
    start = F.struct(seq.alias("rest"), F.array().cast("array<string>").alias("licences"))

    def one(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["seq"])
        return F.when(hit, F.struct(F.replace(acc["rest"], rule["seq"], F.lit(";")).alias("rest"), F.array_append(acc["licences"], rule["licence"]).alias("licences"))).otherwise(acc)

    def taken(acc: Column, pattern: str) -> Column:
        found = F.regexp_extract_all(acc["rest"], F.lit(pattern), F.lit(1))
        return F.struct(F.regexp_replace(acc["rest"], pattern, ";").alias("rest"), F.concat(acc["licences"], found).alias("licences"))

    def named(acc: Column) -> Column:
        for pattern in (GNU_RULE, *[f"<{k}:([^>]+)>" for k in NAMED]):
            acc = taken(acc, pattern)
        return acc

    return F.aggregate(steps, start, one, named)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_sentences, sentence_ids (comma-joined, in order), licences (comma-joined, in the order of the rules) and
    n_unmatched (known sentences that no rule took).

    Whole texts are read. A null or empty text has no sentence and no licence; null ids are carried, repeated rows are answered each, an
    empty table gives an empty result, and other columns are ignored.
    """
    found = recognised(docs, id_col, text_col).withColumn("m", F.when(F.col("seq") != "", matched(F.col("seq"))))
    rest = F.replace(F.col("m.rest"), F.lit("<->"), F.lit(""))
    left = F.coalesce(F.length(rest) - F.length(F.replace(rest, F.lit("<"), F.lit(""))), F.lit(0))
    ids = F.replace(F.btrim("seq", F.lit("<>")), F.lit("><"), F.lit(","))
    return found.select("doc_id", "n_sentences", ids.alias("sentence_ids"), F.coalesce(F.array_join(F.array_distinct("m.licences"), ","), F.lit("")).alias("licences"), left.cast("long").alias("n_unmatched"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    e = lambda s: "e" + _plain_q(s.replace("\\", "\\\\").replace("\x01", "\\x01").replace("\n", "\\n"))
    text = "lower(coalesce(text, ''))"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {e(pattern)}, {e(to)}, 'g')"
    match = lambda w, p: f"regexp_full_match({w}, {e(p)})"
    extract = lambda w, p, k: f"regexp_extract({w}, {e('^(?:' + p + ')$')}, {k})"
    of = lambda w: _classified(w, match, extract, _duck_names)
    stages, last = [], "joined"
    steps = [(_plain_q("".join(f"<{i}>" for i in ids.split())), f"[{_plain_q(spdx)}]") for spdx, ids in RULES]
    for n, (seq, add) in enumerate(steps):
        stages.append(f"r{n} AS (SELECT rid, replace(rest, {seq}, ';') AS rest, CASE WHEN contains(rest, {seq}) THEN found || {add} ELSE found END AS found FROM {last})")
        last = f"r{n}"
    for n, pattern in enumerate((GNU_RULE, *[f"<{k}:([^>]+)>" for k in NAMED])):
        stages.append(f"n{n} AS (SELECT rid, regexp_replace(rest, {e(pattern)}, ';', 'g') AS rest, found || regexp_extract_all(rest, {e(pattern)}, 1) AS found FROM {last})")
        last = f"n{n}"
    return rf"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split({text}, chr(1)) AS parts FROM documents),
        units AS (SELECT rid, unnest(parts) AS u, generate_subscripts(parts, 1) AS i FROM docs),
        whole AS (SELECT rid, i, u, trim(replace(u, chr(10), ' '), ' .') AS w FROM units),
        kinds AS (SELECT w, {of("w")} AS k FROM (SELECT DISTINCT w FROM whole)),
        lines AS (SELECT rid, i, unnest(string_split(u, chr(10))) AS l, generate_subscripts(string_split(u, chr(10)), 1) AS j FROM whole JOIN kinds USING (w) WHERE (k = '-' OR k LIKE 'spdx:%') AND contains(u, chr(10))),
        line_kinds AS (SELECT l, {of("trim(l, ' .')")} AS k FROM (SELECT DISTINCT l FROM lines)),
        lined AS (SELECT rid, i, 0 AS j, k FROM whole JOIN kinds USING (w) WHERE NOT ((k = '-' OR k LIKE 'spdx:%') AND contains(u, chr(10))) UNION ALL SELECT rid, i, j, k FROM lines JOIN line_kinds USING (l)),
        raw AS (SELECT rid, string_agg('<' || k || '>', '' ORDER BY i, j) AS seq FROM lined WHERE k <> '' GROUP BY rid HAVING bool_or(k <> '-')),
        joined AS (SELECT rid, regexp_replace(regexp_replace(seq, '(?:<->)+', '<->', 'g'), '^<->|<->$', '', 'g') AS seq, seq AS rest, CAST([] AS VARCHAR[]) AS found FROM raw),
        j2 AS (SELECT rid, seq AS rest, found FROM joined),
        {", ".join(stages).replace("FROM joined)", "FROM j2)")}
        SELECT doc_id, CAST(len(list_filter(parts, lambda x: trim(x, ' .' || chr(10)) <> '')) AS BIGINT) AS n_sentences, coalesce(replace(trim(seq, '<>'), '><', ','), '') AS sentence_ids,
            coalesce((SELECT string_agg(x, ',' ORDER BY k) FROM (SELECT x, min(k) AS k FROM (SELECT unnest(found) AS x, generate_subscripts(found, 1) AS k) GROUP BY x)), '') AS licences,
            CAST(coalesce(length(replace(rest, '<->', '')) - length(replace(replace(rest, '<->', ''), '<', '')), 0) AS BIGINT) AS n_unmatched
        FROM docs LEFT JOIN (SELECT rid, seq FROM joined) USING (rid) LEFT JOIN {last} USING (rid)
    """
