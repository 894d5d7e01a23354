"""op9: known texts, order, and the SQL twin."""

import re
import textwrap

import duckdb
import pytest

from turnloom.llm import license_rules as L

MIT = """MIT License

Copyright (c) 2020 Some Body

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
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: \n"
SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
CASES = [
    (1, MIT, "MIT"), (2, None, ""), (3, "", ""), (4, "Prose. Released under the MIT License.", "MIT"),
    (5, "a heading\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    (6, BSD + SOURCE + BINARY + NAMES + AS_IS, "BSD-3-Clause"), (7, BSD + SOURCE + BINARY + AS_IS, "BSD-2-Clause"),
    (8, BINARY + SOURCE + AS_IS, "unknown"), (9, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "CC-BY-NC-4.0,MIT"),
    (10, "The word license alone. Warranty void.", ""), (11, "Copyright (c) 2020 A permission slip. Prose", ""),
    (12, "x. " * 50_000 + "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    (None, "Released under the MIT License. Released under the MIT License.", "MIT"), (4, "Released under the MIT License!", "MIT"),
]


def frame(spark, cases):
    return spark.createDataFrame([(d, t, "x") for d, t, _ in cases], "doc_id long, text string, licences string")


def test_cases(spark):
    rows = L.digest(L.scanned(frame(spark, CASES))).collect()
    assert sorted(((r.doc_id, r.licences) for r in rows), key=str) == sorted(((d, want) for d, _, want in CASES), key=str)


GPL3 = """This file is part of Some Thing.

    Some Thing is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    Some Thing is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
int main() { return 0; }
"""
APACHE = """# Copyright 2019 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#      http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
MORE = [
    (GPL3, "GPL-3.0-or-later"), (GPL3.replace("version 3", "version 2").replace("software:", "software;"), "GPL-2.0-or-later"), (MPL, "MPL-2.0"), (APACHE, "Apache-2.0"),
    ("This file is licensed under the MIT License.", "MIT"), ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"), ("// SPDX-License-Identifier: GPL-2.0-only\n", "GPL-2.0-only"),
    ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */", "Apache-2.0,MIT"), ("SPDX-License-Identifier: Made-Up", ""), ("the licensed plumber under the sink", ""),
    ("\n".join(f" * {line}" for line in MIT.splitlines()), "MIT"), ("Permission is hereby granted by the licence board.", ""),
]


def wrapped(text, mark="", width=64):
    """The notice as in a file: paragraphs filled anew, each line behind the mark, below a copyright notice."""
    lines = ["Copyright (c) 2021 The Holders", ""]
    for paragraph in text.strip().split("\n\n"):
        lines += [*textwrap.wrap(" ".join(paragraph.split()), width), ""]
    return "\n".join(f"{mark}{line}".rstrip() for line in lines)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- ", ";; "])
def test_published_notices(spark, mark):
    cases = [(i, wrapped(notice, mark), licence) for i, (licence, notice) in enumerate(L.NOTICES)]
    assert len({c[2] for c in cases}) >= 40
    got = {r.doc_id: r.licences for r in L.digest(L.scanned(frame(spark, cases))).collect()}
    assert [(c[2], got[c[0]]) for c in cases if got[c[0]] != c[2]] == []


def test_texts_as_they_are_found(spark):
    cases = [(i, text, want) for i, (text, want) in enumerate(MORE)]
    got = {r.doc_id: r.licences for r in L.digest(L.scanned(frame(spark, cases))).collect()}
    assert [(text, got[i], want) for i, text, want in cases if got[i] != want] == []


def test_rules():
    assert {p for _, parts in L.RULES for p in parts} <= set(L.SENTENCES.values())
    assert [len(parts) for _, parts in L.RULES] == sorted((len(parts) for _, parts in L.RULES), reverse=True) and all(parts for _, parts in L.RULES)
    assert all(re.search(L.GATE, notice) for _, notice in L.NOTICES)
    assert len({parts for _, parts in L.RULES}) == len(L.RULES)  # no two licences have one sequence


def test_sql_agrees(spark):
    cases = CASES + [(100 + i, t, "") for i, (t, _) in enumerate(MORE)] + [(200 + i, wrapped(t, "# "), "") for i, (_, t) in enumerate(L.NOTICES)]
    documents = frame(spark, cases).toPandas()  # noqa: F841  DuckDB reads it by name
    want = duckdb.sql(L.oracle_sql()).fetchall()
    got = [tuple(r) for r in L.digest(L.scanned(frame(spark, cases))).collect()]
    key = lambda r: [(x is None or x != x, str(x)) for x in r]
    clean = [tuple(None if x != x else int(x) if isinstance(x, float) else x for x in r) for r in want]
    assert sorted(got, key=key) == sorted(clean, key=key)


def test_plan_is_native(spark):
    plan = L.digest(L.scanned(frame(spark, CASES)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("EvalPython", "PythonUDF", "Pandas", "Arrow", "Exchange"))


def test_empty(spark):
    assert L.scanned(frame(spark, CASES).limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Licensed under CC BY 4.0. ", "licensed   under\tCC-BY 4.0"])
def test_marks_do_not_matter(spark, text):
    assert L.scanned(frame(spark, [(1, text, "")])).first().licences == ["CC-BY-4.0"]
