import pathlib
import re

import pytest

from scriptorium.llm import licenses

from .helpers import documents, empty, odd_documents


def brute(text, threshold=licenses.THRESHOLD):
    text = text or ""
    lines = text.split("\n")
    parts = lines + [s for x in lines for s in re.split(r"(?<=[.!?;])\s+", x)] + re.split(r"\n[ \t\r]*\n", text)
    best = {}
    for p in parts:
        words = re.sub(r"[\W_]+", " ", p.lower()).split()
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        for name, templates in licenses.TEMPLATES.items():
            for t in templates:
                want = licenses.bigrams(t)
                dice = 2 * len(set(grams) & set(want)) / (len(grams) + len(want)) if grams else 0
                if dice >= threshold:
                    best[name] = max(best.get(name, 0), dice)
    return sorted(best.items())


TEXTS = [
    "Prose first.\nLicensed under the Apache License, Version 2.0.\nMore prose.",
    "It says: x. LICENSED UNDER THE APACHE LICENSE -- VERSION 2.0! And on it goes.",
    "Released under the MIT license\nReleased under the MIT License.",
    "This work is licensed under the GNU General Public License, version 2.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files.",
    "Permission is granted, free of charge, to any person obtaining a copy of this software and its associated documentation files.",
    "the the the the", "license", "", None, "Licensed under the Apache License, Version 2.0. " * 3,
]


def test_against_brute_force(spark):
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])
    rows = {r["doc_id"]: [(m["name"], pytest.approx(m["dice"])) for m in r["licenses"]] for r in licenses.scan(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert brute(t) == rows[i]
    assert rows[0] and rows[1] and rows[4]


LONG = [
    (["GPL-3.0"], "Preface.\nSome words first. This work is licensed under the\nGNU General Public License, version 3. It goes on for a while, with many more words in the paragraph.\nLast line of it."),
    (["Apache-2.0"], "As all of our other tools this one, too, is licensed under the Apache License, Version 2.0, and we hope that you like it a lot."),
    (["MIT"], "Copyright (c) 2020 A. Author\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software."),
    (["GPL-3.0"], "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n# It is distributed in the hope that it will be useful."),
    (["GPL-2.0"], "We say again that this program is licensed under the GNU General Public License, version 2, as it always was in years before."),
    (["LGPL-3.0"], "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy."),
    ([], "This license of the software is under the copyright of the author of the work, and the general public may use this program as it is in any version."),
]


def test_notices_inside_longer_text(spark):
    rows = {r["doc_id"]: [m["name"] for m in r["licenses"]] for r in licenses.scan(documents(spark, [(i, t, "s") for i, (_, t) in enumerate(LONG)])).collect()}
    assert [rows[i] for i in range(len(LONG))] == [names for names, _ in LONG]


#: Notices as they are published, wrapped.
MIT='''MIT License

Copyright (c) 2020 Jane Roe

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
'''
GPL='''    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
'''
APACHE='''   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
'''
BSD='''Copyright (c) 2020, Jane Roe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
MPL='''// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
'''
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"


def test_published_notices(spark):
    """Wrapped, joined to one line, inside other text, behind comment marks."""
    published = {"MIT": MIT, "GPL-3.0": GPL, "Apache-2.0": APACHE, "BSD-2-Clause": BSD, "MPL-2.0": MPL, "ISC": ISC}
    forms = [lambda t: t, lambda t: t.replace("\n", " "), lambda t: f"Words before it go on and on. {t} And some more come after.", lambda t: "\n".join(f"# {x}" for x in t.split("\n"))]
    rows = [(i * 10 + j, f(t), "s") for i, t in enumerate(published.values()) for j, f in enumerate(forms)]
    got = {r["doc_id"]: {m["name"] for m in r["licenses"]} for r in licenses.scan(documents(spark, rows)).collect()}
    assert all(name in got[i * 10 + j] for i, name in enumerate(published) for j in range(4)), got
    assert all("GPL-2.0" not in x for x in got.values()) and not got[50] & {"MIT", "GPL-3.0"}


def window_brute(text, name):
    """Best coefficient of any run of bigrams with any template of a license that holds its telling bigrams."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    grams, best = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)], 0
    for t in licenses.TEMPLATES.get(name, []) + licenses.HEADERS.get(name, []):
        want = licenses.bigrams(t)
        low, high = licenses.bounds(len(want))
        telling = {g for g in licenses.TELLING.get(name, []) if g in want}
        for a in range(len(grams)):
            for b in range(a + low, min(len(grams), a + high) + 1):
                run = set(grams[a:b])
                if telling <= run:
                    best = max(best, 2 * len(run & set(want)) / (b - a + len(want)))
    return best


def test_windows_against_brute_force(spark):
    texts = [t for _, t in LONG] + [APACHE, MPL]
    rows = {r["doc_id"]: {m["name"]: m["dice"] for m in r["licenses"]} for r in licenses.scan(documents(spark, [(i, t.replace("\n", " ").replace(".", ","), "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        for name in ("Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "MPL-2.0"):
            best = window_brute(t.replace("\n", " ").replace(".", ","), name)
            passage = dict(brute(t.replace("\n", " ").replace(".", ","))).get(name, 0)
            want = passage or (best if best >= licenses.THRESHOLD else 0)
            assert rows[i].get(name, 0) == pytest.approx(want), (i, name)


#: Names of the system's license texts that are told by a template of this module; the others have none.
SYSTEM = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_whole_license_texts(spark):
    """A license's own text gives its name and no other's, though licenses mention one another. BSD-3-Clause holds the first clauses of BSD-2-Clause."""
    files = [p for p in sorted(pathlib.Path("/usr/share/common-licenses").glob("*")) if not p.is_symlink()]
    if not files:
        pytest.skip("this system has no license texts")
    docs = spark.createDataFrame([(p.name, p.read_text(encoding="utf-8", errors="replace")) for p in files], "file string, text string")
    told = {r["file"]: {m["name"] for m in r["licenses"]} - {"BSD-2-Clause"} for r in licenses.scan(docs).collect()}
    assert told == {p.name: {SYSTEM[p.name]} if p.name in SYSTEM else set() for p in files}


def test_a_mention_is_no_title(spark):
    texts = ["You may opt to apply the terms of the GNU General Public License, version 2, instead of this one.", "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991", "the GNU Library General Public License, version 2", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"]
    rows = licenses.scan(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [[m["name"] for m in r["licenses"]] for r in rows] == [[], ["GPL-2.0"], [], ["LGPL-2.1"]]


def test_columns_of_any_name(spark):
    df = spark.sql("SELECT 1 AS doc_id, 'Released under the MIT License.' AS text, 2 AS grams, 3 AS hits, 4 AS _grams, 5 AS _hits, map('a', 1) AS m")
    out = licenses.scan(df)
    assert out.columns == [*df.columns, "licenses"] and out.first()["_grams"] == 4 and out.first()["licenses"][0]["name"] == "MIT"


def test_odd_rows_and_columns(spark):
    docs = odd_documents(spark)
    out = licenses.scan(docs)
    assert out.columns == [*docs.columns, "licenses"] and out.count() == docs.count()
    assert all(r["licenses"] == [] for r in out.collect())
    assert licenses.scan(empty(spark)).count() == 0


def test_bounds_lose_nothing():
    for n in range(1, 40):
        low, high = licenses.bounds(n)
        for k in range(1, 90):
            assert (2 * min(k, n) / (k + n) >= licenses.THRESHOLD - 1e-12) == (low <= k <= high)


def test_templates_are_checked(spark):
    with pytest.raises(ValueError, match="two words"):
        licenses.scan(empty(spark), {"x": ["word"]})
