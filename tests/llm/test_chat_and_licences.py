from __future__ import annotations

import duckdb
import pytest

from tesserae.llm import licences, preferences, queries

from .helpers import none, odd

TURNS = "conv_id long, turn long, role string, text string, head string, learned string, first string"


def talk(spark, rows):
    return preferences.turns(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS))


def same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = ", ".join(sorted(df.columns))
    want = con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", ["op2_preference_format", "op8_licence_sentences", "op10_exact_dedup"])
def test_queries_as_sql(spark, name):
    same_as_sql(spark, "/root/testdata/sf0.01", name)


def test_pairs(spark):
    chosen = talk(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"), (2, 0, "user", "same"), (3, 0, "user", "only chosen"), (5, 0, "user", "<|im_end|>x"), (5, 1, "assistant", "a<|im_start|>b")])
    rejected = talk(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "less"), (1, 3, "assistant", "yes"), (1, 4, "assistant", "and"), (2, 0, "user", "same"), (4, 0, "assistant", "only rejected"), (5, 0, "user", "<|im_end|>x")])
    rows = {r.pair_id: r for r in preferences.paired(preferences.preference_messages(chosen, rejected)).collect()}
    learned = lambda text, mask: [text[int(x) : int(y)] for x, y in (m.split(":") for m in mask.split(",") if m)]
    one = rows[1]
    assert one.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n"
    assert one.chosen == "<|im_start|>user\nmore<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert learned(one.chosen, one.chosen_mask) == ["yes<|im_end|>"]
    assert learned(one.rejected, one.rejected_mask) == ["yes<|im_end|>", "and<|im_end|>"]
    assert (rows[2].chosen, rows[2].rejected) == ("", "") and rows[2].prompt
    assert (rows[3].prompt, rows[3].rejected, rows[3].chosen_mask) == ("", "", "")
    assert rows[4].rejected_mask.endswith(f":{len(rows[4].rejected) - 1}")
    assert rows[5].prompt.count("<|im_end|>") == 1 and rows[5].chosen.count("<|im_start|>") == 1


def test_long_pairs_go_on_in_chunks(spark):
    """Offsets over several blocks of turns; the chunks put together are the side."""
    said = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " * (k % 5)) for k in range(3000)]
    messages = preferences.preference_messages(talk(spark, said), talk(spark, [(1, 0, "user", "other")]))
    rows = sorted(preferences.paired(messages, chunk=10_000).collect(), key=lambda r: r.chunk)
    whole = "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for _, _, role, text in said)
    assert len(rows) > 5 and "".join(r.chosen for r in rows) == whole and max(len(r.chosen) for r in rows) < 10_100
    learned = [r.chosen[int(x) : int(y)] for r in rows for x, y in (m.split(":") for m in r.chosen_mask.split(",") if m)]
    assert learned == [f"{text}<|im_end|>" for _, _, role, text in said if role == "assistant"]


def test_odd_turns(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", ""), (None, 0, "user", "x"), (None, 1, "user", "y"), (1, None, "user", "x"), (2, 5, "assistant", "z. y. x"), (2, 5, "assistant", "z. y. x")]
    c = talk(spark, rows)
    assert sorted((r.pair.missing, r.pair.id, r.turn, r.role, r.text) for r in c.collect()) == [
        (False, 1, -1, "user", "x"), (False, 1, 0, "user", ""), (False, 1, 1, "assistant", ""), (False, 2, 5, "assistant", "z. y. x"), (True, 0, 0, "user", "x"), (True, 0, 1, "user", "y"),
    ]
    out = {r.pair_id: r for r in preferences.paired(preferences.preference_messages(c, preferences.cut_short(c))).collect()}
    assert set(out) == {1, 2, None} and out[1].prompt.count("<|im_start|>") == 3 and out[1].chosen == "" and out[2].prompt == "" and out[2].chosen != out[2].rejected and out[None].prompt.count("<|im_start|>user") == 2
    assert preferences.paired(preferences.preference_messages(c.limit(0), c.limit(0))).count() == 0


MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
"""
BSD = """Copyright (c) {who}. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
{names}
THIS SOFTWARE IS PROVIDED BY {who} AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.  IN NO EVENT SHALL {who} OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE.
"""
NAMES = """3. Neither the name of {who} nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
GOOD = MIT.replace("THE SOFTWARE IS PROVIDED", "The Software shall be used for Good, not Evil.\n\nTHE SOFTWARE IS PROVIDED")
CASES = [
    (MIT, "MIT", 0),
    (GPL, "GPL-3.0-or-later", 0),
    ("Some prose\nReleased under the MIT License.", "MIT", 0),
    ("Some prose\nReleased under the MIT Licence.", "MIT", 0),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only", 0),
    ("Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", "Apache-2.0,CC-BY-NC-4.0", 0),
    ("# SPDX-License-Identifier: BSD-3-Clause\ncode", "BSD-3-Clause", 0),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "MIT OR Apache-2.0", 0),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */", "GPL-2.0-or-later WITH Classpath-exception-2.0", 0),
    ("A licence is a fine thing. Released under pressure.", "", 0),
    (MIT.replace("The above copyright", "The below copyright"), "", 3),
    ("All rights reserved.", "", 0),
    (LGPL, "LGPL-2.1-or-later", 0),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy it.\n", "GPL-3.0", 0),
    (BSD.format(who="Google Inc.", names=NAMES.format(who="Google Inc.")), "BSD-3-Clause", 0),
    (BSD.format(who="THE REGENTS", names=NAMES.format(who="the University")), "BSD-3-Clause", 0),
    (BSD.format(who="the author", names=""), "BSD-2-Clause", 0),
    (BSD.format(who="the author", names="3. Nobody may use this on Sundays, and everybody knows why.\n"), "", 5),  # an unknown clause in between
    (GOOD, "JSON", 0),
]


def test_licence_texts(spark):
    rows = licences.licences(spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "doc_id long, text string")).collect()
    for r in rows:
        assert (r.licences, r.n_unmatched) == CASES[r.doc_id][1:], (r, CASES[r.doc_id][0][:80])


def test_apache_header(spark):
    r = licences.licences(spark.createDataFrame([(0, APACHE)], "doc_id long, text string")).first()
    assert r.licences == "Apache-2.0"


def test_every_known_sentence_is_recognised(spark):
    table = licences.known()
    rows = licences.recognised(spark.createDataFrame([(k, s.replace("under ", "licensed under the ", 1) if s.startswith("under ") else s) for k, s in enumerate(table)], "doc_id long, text string")).collect()
    wrong = [(list(table)[r.doc_id], r.seq) for r in rows if r.seq != f"<{list(table.values())[r.doc_id]}>"]
    assert not wrong


def test_odd_rows(spark):
    df = odd(spark)
    assert licences.licences(df).count() == df.count() and licences.licences(none(spark)).count() == 0
    assert {r.n_sentences for r in licences.licences(df).filter("doc_id in (3, 4, 5)").collect()} == {0}
