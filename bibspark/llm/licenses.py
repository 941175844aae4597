"""Licence scan: pieces of text compared to licence notices and full licence texts by the Dice coefficient over word bigrams.

Words are runs of letters and digits in lower case. Compared are each line with a word, each paragraph of two lines or more, the whole
text where it has several paragraphs, and windows: for each template the words around each place of its anchor, its rarest word, as
many as the template has, so a notice inside a longer line or over several lines is found where it stands.

Two sets of a and b bigrams can only reach the coefficient t if b lies between a * t / (2 - t) and a * (2 - t) / t: templates outside
these bounds are not compared. A piece takes the template with the highest coefficient, the earlier of equal ones. A text that has
none of the cue words is passed over: any piece that reaches t with a template has one of that template's cues (see `cues`).

Everything is an expression over a document's own row: no shuffle. Null and empty texts have no pieces. Texts of any length are
compared whole. Repeated rows, ties and null doc_ids are judged one by one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

LEAST = 0.8

# Notices and licence texts by licence identifier.
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", _MIT),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_END}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
)


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _bigrams(w: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def template_rows(templates=TEMPLATES, least: float = LEAST) -> list[tuple[str, list[str], int, int]]:
    """(licence, sorted bigrams, least and most bigrams of a piece that can match) of each template."""
    out = []
    for name, text in templates:
        grams = sorted(_bigrams(_words(text)))
        n = len(grams)
        out.append((name, grams, int(-(-n * least // (2 - least))), int(n * (2 - least) // least)))
    return out


def anchors(templates=TEMPLATES) -> list[tuple[str, int, int]]:
    """(word, its first place, words) of each template: the word that fewest templates have, of these the longest, then the first. Once each."""
    every = [_words(text) for _, text in templates]
    held = Counter(w for ws in every for w in set(ws))
    out = []
    for ws in every:
        word = min(ws, key=lambda w: (held[w], -len(w), ws.index(w)))
        out.append((word, ws.index(word), len(ws)))
    return list(dict.fromkeys(out))


#: Fixed value: words too common to be cues where others will do.
COMMON = "the of and or to in is this that any for with by be not as are under general available following including version source use work".split()


def cues(templates=TEMPLATES, least: float = LEAST) -> list[str]:
    """Words of which any piece that reaches `least` with a template has one.

    A match shares at least t / (2 - t) of a template's bigrams. Words are taken, those of most bigrams first and long ones before
    short ones, until the bigrams that hold none of them are fewer; the anchor joins them, as windows are laid around it.
    """
    out = {word for word, *_ in anchors(templates)}
    for _, text in templates:
        left = {tuple(g.split(" ")) for g in _bigrams(_words(text))}
        n = len(left)
        left = {g for g in left if not out & set(g)}
        while round(2 * len(left) / (len(left) + n), 6) >= least:
            count = Counter(w for g in left for w in set(g) if len(w) > 3 and w not in COMMON) or Counter(w for g in left for w in set(g))
            word = max(sorted(count), key=lambda w: (count[w] * len(w), len(w)))
            out.add(word)
            left = {g for g in left if word not in g}
    return sorted(out)


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    n = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    return let(words, lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, n(w)), F.slice(w, 2, n(w)), lambda a, b: F.concat_ws(" ", a, b))))


def units(text: Column) -> Column:
    """Lines with a word, paragraphs of two lines or more, and the whole text where it has several paragraphs."""
    t = F.coalesce(text, F.lit(""))
    some = lambda x: x.rlike(r"[\p{L}\p{N}]")
    parts = F.filter(F.transform(F.split(t, r"\n[ \t\r]*\n"), lambda p: F.regexp_replace(p, r"^\n+|\n+$", "")), some)
    paragraphs = F.filter(parts, lambda p: F.contains(p, F.lit("\n")))
    whole = F.when(F.size(parts) > 1, F.array(t)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.filter(F.split(t, "\n"), some), paragraphs, whole)


def windows(words: Column, templates=TEMPLATES) -> Column:
    """Word arrays around each place of each template's anchor, as long as the template."""

    def around(word: str, place: int, size: int) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())
        cut = lambda i: F.slice(words, F.greatest(i - place, F.lit(0)) + 1, F.lit(size))
        return F.when(F.array_contains(words, word), F.transform(at, cut)).otherwise(F.array().cast("array<array<string>>"))

    return F.array_distinct(F.concat(*[around(*a) for a in anchors(templates)]))


def best(grams: Column, templates=TEMPLATES, least: float = LEAST) -> Column:
    """struct<dice, license> of the best template of a piece's bigrams, or null. Each template is compared only within its bounds."""
    scores = []
    for i, (name, own, low, high) in enumerate(template_rows(templates, least)):
        dice = F.round(2 * F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in own]))) / (F.size(grams) + len(own)), 6)
        scores.append(F.when(F.size(grams).between(low, high), F.struct(dice.alias("dice"), F.lit(-i).alias("order"), F.lit(name).alias("license"))))
    top = F.array_max(F.array_compact(F.array(*scores)))
    return let(top, lambda x: F.when(x["dice"] >= least, F.struct(x["dice"].alias("dice"), x["license"].alias("license"))))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, n_units, found): per row of `docs` its lines, paragraphs and whole text, and its licences, array<struct<license, dice>> by licence with the best coefficient."""
    t = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(doc_id), t.alias("_text"), F.lower(t).alias("_low"), units(t).alias("_units"))
    words = cues(templates, least)
    short = "|".join(w for w in words if len(w) < 6)
    spotted = F.col("_low").rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{short})(?![\p{{L}}\p{{N}}])") if short else F.lit(False)
    for word in words:
        spotted = spotted | F.contains("_low", F.lit(word)) if len(word) > 5 else spotted
    pieces = let(split_words(F.col("_text")), lambda w: F.concat(F.transform("_units", split_words), windows(w, templates)))
    matches = F.array_compact(F.transform(F.transform(pieces, bigrams), lambda g: best(g, templates, least)))
    names = lambda m: F.array_sort(F.array_distinct(F.transform(m, lambda x: x["license"])))
    top = lambda m, n: F.array_max(F.transform(F.filter(m, lambda x: x["license"] == n), lambda x: x["dice"]))
    found = let(matches, lambda m: F.transform(names(m), lambda n: F.struct(n.alias("license"), top(m, n).alias("dice"))))
    none = F.array().cast("array<struct<license:string,dice:double>>")
    return split.select(doc_id, F.size("_units").cast("long").alias("n_units"), F.when(spotted, found).otherwise(none).alias("found"))
