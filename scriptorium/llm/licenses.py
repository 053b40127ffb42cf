"""License scans: texts compared with license templates by Dice coefficient over word bigrams. DataFrame functions only.

A text is normalised (lower case; all but letters and digits parts words). Its passages are
its lines, the sentences of lines, its paragraphs (a text without blank lines is one). A
passage of w words has w - 1 bigrams, repeats counted; it can reach a Dice coefficient of t
with a template of n bigrams only if it has between n * t / (2 - t) and n * (2 - t) / t of
them; passages and templates outside these bounds are never compared.

Where no passage reaches the threshold for a license, windows of words do: all runs of the
whole text's bigrams, of any size inside the bounds, that hold the bigrams of TELLING for
that template (a run cut out of another license's notice lacks them). A best run begins and
ends with a bigram of the template, so only such are looked at, and only in texts with one of
a few words that every run over the threshold must hold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

THRESHOLD = 0.8
#: Common license notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

#: Standard file headers and first lines of full texts. They are long and alike, so they need their telling bigrams in passages as well.
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
HEADERS = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": [_GNU.format("program", "GNU General Public License", 3), "GNU General Public License Version 3, 29 June 2007"],
    "GPL-2.0": [_GNU.format("program", "GNU General Public License", 2), "GNU General Public License Version 2, June 1991"],
    "LGPL-3.0": [_GNU.format("library", "GNU Lesser General Public License", 3), "GNU Lesser General Public License Version 3, 29 June 2007"],
    "AGPL-3.0": [_GNU.format("program", "GNU Affero General Public License", 3), "GNU Affero General Public License Version 3, 19 November 2007"],
    "MIT": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "MPL-1.1": ["Mozilla Public License Version 1.1"],
    "GPL-1.0": ["GNU General Public License Version 1, February 1989"],
    "LGPL-2.0": ["GNU Library General Public License Version 2, June 1991"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "GFDL-1.2": ["GNU Free Documentation License Version 1.2, November 2002"],
    "GFDL-1.3": ["GNU Free Documentation License Version 1.3, 3 November 2008"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
}
#: Whole short licenses, and the notices of long ones that files carry.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
_BOOST = """Distributed under the Boost Software License, Version 1.0."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
for _name, _texts in {"MIT": [_MIT], "BSD-2-Clause": [_BSD2], "BSD-3-Clause": [_BSD3], "ISC": [_ISC], "Apache-2.0": [_APACHE], "Zlib": [_ZLIB], "BSL-1.0": [_BOOST], "Unlicense": [_UNLICENSE], "MPL-2.0": [_MPL]}.items():
    HEADERS.setdefault(_name, []).extend(_texts)
#: Bigrams that tell a license from others; asked for where the template has them. A title has a date, which a mention of it in another license lacks.
TELLING = {
    "Apache-2.0": ["apache license", "version 2", "january 2004"], "MIT": ["mit license"], "GPL-3.0": ["gnu general", "version 3", "june 2007"], "GPL-2.0": ["gnu general", "version 2", "june 1991"], "LGPL-3.0": ["gnu lesser", "version 3", "june 2007"], "AGPL-3.0": ["gnu affero", "version 3", "november 2007"],
    "CC-BY-NC-4.0": ["by nc", "nc 4"], "CC-BY-4.0": ["commons attribution", "attribution 4"], "CC-BY-SA-4.0": ["attribution sharealike", "sharealike 4"], "MPL-2.0": ["mozilla public", "v 2", "version 2"],
    "MPL-1.1": ["mozilla public", "version 1", "1 1"], "GPL-1.0": ["gnu general", "february 1989"], "LGPL-2.0": ["gnu library", "june 1991"], "LGPL-2.1": ["gnu lesser", "february 1999"], "GFDL-1.2": ["free documentation", "november 2002"], "GFDL-1.3": ["free documentation", "november 2008"],
    "CC0-1.0": ["cc0 1"],
}


def bigrams(text: str) -> list[str]:
    """Word bigrams of a normalised template, once each."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    found = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    if not found:
        raise ValueError("a template needs two words")
    return list(dict.fromkeys(found))


def bounds(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Least and most bigrams of a passage that can reach the threshold with a template of n."""
    least = next(k for k in range(n + 1) if 2 * min(k, n) >= threshold * (k + n) - 1e-12)
    most = n
    while 2 * n >= threshold * (most + 1 + n) - 1e-12:
        most += 1
    return least, most


def _words_of_all(known: list[tuple[str, list[str]]], least: list[int]) -> list[str]:
    """A few words of which every run over the threshold holds one: without them each template keeps fewer bigrams than a run needs."""
    chosen: list[str] = []
    while True:
        lacking = [[g.split() for g in b] for (_, b), k in zip(known, least, strict=True) if sum(not set(g.split()) & set(chosen) for g in b) >= k]
        if not lacking:
            return chosen
        open_ = [{w for g in b for w in g} - set(chosen) for b in lacking]
        words = sorted(set().union(*open_))
        chosen.append(max(words, key=lambda w: (len(w) > 4, sum(w in x for x in open_), len(w), w)))


def _runs(hits: Column, t: list[str], need: int, high: int, telling: list[str], n: int) -> Column:
    """Best coefficient of a run with one template; null without one. hits: (i, g), places and bigrams, in order.

    From each hit one walk over the next ones that a run may reach keeps the bigrams seen so
    far and the best coefficient at any of them.
    """
    own = F.filter(hits, lambda h: h["g"].isin(t))
    told = lambda seen: F.forall(F.array(*map(F.lit, telling)), lambda g: F.array_contains(seen, g)) if telling else F.lit(True)

    def walk(own: Column, k: Column) -> Column:
        begin = F.element_at(own, k.cast("int"))["i"]
        near = F.filter(F.slice(own, k, F.lit(high)), lambda h: h["i"] - begin < high)

        def step(s: Column, h: Column) -> Column:
            seen = F.when(F.array_contains(s["seen"], h["g"]), s["seen"]).otherwise(F.array_append(s["seen"], h["g"]))
            return F.transform(F.array(seen), lambda seen: F.struct(seen.alias("seen"), F.greatest(s["best"], F.when((F.size(seen) >= need) & told(seen), F.size(seen) * 2.0 / (h["i"] - begin + 1 + n)).otherwise(0.0)).alias("best")))[0]

        return F.aggregate(near, F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0.0).alias("best")), step, lambda s: s["best"])

    def inside(own: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(own) - (need - 1)), lambda k: F.element_at(own, (k + need - 1).cast("int"))["i"] - F.element_at(own, k.cast("int"))["i"] < high)
        return F.array_max(F.transform(starts, lambda k: walk(own, k)))

    return F.transform(F.array(own), lambda own: F.when(F.size(own) >= need, inside(own)))[0]


def _normal(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " "))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `licenses`, an array of (name, dice), the best match of every license found, by name.

    A null, empty or one-word text has none; a license is listed once with its highest
    coefficient, however often its notice is repeated; rows and columns of docs are kept as
    they are (an old `licenses` column is replaced). The coefficient is that of the best passage
    where one reaches the threshold, else that of the best window. Own `templates` come without
    headers, and their names' telling bigrams are asked for as well. No shuffle, and no Python in the plan.
    """
    known = [(name, bigrams(t)) for name, texts in (templates or TEMPLATES).items() for t in texts]
    limits = [bounds(len(b), threshold) for _, b in known]
    headers = [] if templates else [(name, bigrams(t)) for name, texts in HEADERS.items() for t in texts]
    sliding = [(name, b, *bounds(len(b), threshold)) for name, b in known + headers]
    fewest, most = min(a for a, _ in limits), max(b for _, b in limits)
    g, h = free_names(docs, "grams", "hits")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, r"\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?;])\s+")))
    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    words = F.transform(F.array_distinct(F.concat(lines, sentences, paragraphs)), lambda p: F.split(_normal(p), " "))
    fitting = F.filter(words, lambda w: F.size(w).between(fewest + 1, most + 1))
    pairs = F.transform(fitting, lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    every = F.array(*[F.lit(g) for g in sorted({g for _, b in known for g in b})])
    grams = F.filter(pairs, lambda g: F.arrays_overlap(g, every))

    def dice(t: list[str], low: int, high: int) -> Column:
        common = lambda g: F.size(F.array_intersect(g, F.array(*map(F.lit, t))))
        return F.array_max(F.transform(g, lambda g: F.when(F.size(g).between(low, high), common(g) * 2.0 / (F.size(g) + len(t)))))

    def best(name: str) -> Column:
        return F.greatest(*[dice(t, low, high) for (n, t), (low, high) in zip(known, limits, strict=True) if n == name], F.lit(0.0), F.lit(0.0))

    def window(name: str) -> Column:
        return F.greatest(*[_runs(F.col(h), t, low, high, [g for g in TELLING.get(name, []) if g in t], len(t)) for n, t, low, high in sliding if n == name], F.lit(0.0), F.lit(0.0))

    gate = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(_words_of_all([(n, t) for n, t, _, _ in sliding], [low for _, _, low, _ in sliding]))})(?![\p{{L}}\p{{N}}])"
    all_grams = sorted({g for _, t, _, _ in sliding for g in t})
    # words of one run are joined in pairs and looked up at once; their places are those in the whole text
    pairs_of = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    placed = lambda g: F.filter(F.transform(g, lambda x, i: F.struct(i.alias("i"), x.alias("g"))), lambda h: h["g"].isin(all_grams))
    hits = F.when(text.rlike(gate), F.transform(F.array(F.split(_normal(text), " ")), lambda w: placed(pairs_of(w)))[0])

    names = sorted(dict.fromkeys(n for n, *_ in sliding))
    passage = F.array(*[F.struct(F.lit(name).alias("name"), best(name).alias("dice")) for name in names])
    windows = F.array(*[F.struct(F.lit(name).alias("name"), window(name).alias("dice")) for name in names])
    either = lambda a, b: F.when(a["dice"] >= threshold, a).otherwise(b)
    told = F.when(F.size(h) > 1, F.zip_with(passage, windows, either)).otherwise(passage)
    out = docs.withColumn(g, grams).withColumn(h, hits).withColumn("licenses", F.filter(told, lambda m: m["dice"] >= threshold))
    return out.drop(g, h)

