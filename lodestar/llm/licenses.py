"""License scans by patience alignment.

A text is read as lower-case runs of letters and digits. Words that occur in a template mark
candidate stretches; within a stretch the words that are unique to both it and the template are
anchors, their longest increasing subsequence is kept, and each gap between anchors is aligned
the same way again. Without an anchor a gap aligns its common prefix and suffix. Coverage is the
share of the template's words that are aligned; a stretch matches at MIN_COVERAGE or above, if it is
not stretched over more than MAX_SPAN times the template's words. Of overlapping matches the
best by 2 * aligned / (template words + span words) stays, then the one with more aligned words.

Names and numbers tell licenses apart, so a template's DECIDING words and version numbers have all to be
aligned, and so have the words of its CLAUSES, those that make a license another one; the span may hold no QUALIFIERS beside
the aligned ones, nor, for a template with a version, another number of one digit. A notice right behind "not" is none, and one for a
single version isn't taken where "or" and a further version follow. Of two matches of one family the one that stands inside the
other and aligns fewer words goes, since longer licenses hold the shorter ones' clauses.

Defined cases: null and empty texts have no match and no row; repeated rows give repeated rows;
a license that stands twice in a text gives two rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel
from lodestar.llm.common import bounded_batches

MIN_COVERAGE, MAX_SPAN = 0.8, 1.6
#: A match inside a longer one of its family has this share of the other's aligned words at most.
INNER = 0.95
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License"
_FSF = "as published by the Free Software Foundation"
_ATTRIBUTIONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _gnu(name: str, kind: str, version: str, what: str = "program") -> dict[str, list[str]]:
    """The notices and file headers of a GNU license."""
    under = _GNU.format(kind=f"{kind} " if kind else "")
    title = f"GNU {kind} General Public License" if kind else "GNU General Public License"
    return {
        f"{name}-only": [
            f"This work is licensed under the {title}, version {version}.",
            f"This {what} is free software; {under} version {version} {_FSF}.",
            f"This {what} is free software: {under} {_FSF}, version {version}.",
        ],
        f"{name}-or-later": [
            f"This work is licensed under the {title}, version {version} or any later version.",
            f"This {what} is free software; {under} {_FSF}; either version {version} of the License, or (at your option) any later version.",
        ],
    }


_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE X CONSORTIUM BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

#: Notices, headers and opening texts by SPDX name; words in brackets have to be aligned.
_MARKED: dict[str, list[str]] = {
    **_gnu("GPL-2.0", "", "2"),
    **_gnu("GPL-3.0", "", "3"),
    **_gnu("LGPL-2.0", "Library", "2", "library"),
    **_gnu("LGPL-2.1", "Lesser", "2.1", "library"),
    **_gnu("LGPL-3.0", "Lesser", "3"),
    **_gnu("AGPL-3.0", "Affero", "3"),
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
    ],
    "MIT": ["Released under the MIT License.", f"{_MIT}, [subject to the following conditions]:"],
    "MIT-0": ["Released under the MIT-0 License.", f"{_MIT}."],
    "X11": [f"{_MIT}, subject to the following conditions: {_AS_IS} [Except as contained in this notice, the name] of the X Consortium [shall not be used in advertising] or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."],
    "ISC": ["Released under the ISC License.", f"{_FEE}, [provided that the above copyright notice] and this permission notice appear in all copies."],
    "0BSD": [f"{_FEE}."],
    "BSD-2-Clause": [_BSD],
    "BSD-3-Clause": [f"{_BSD} 3. [Neither the name] of the copyright holder nor the names of its contributors may be used to [endorse or promote] products derived from this software without specific prior written permission."],
    "BSD-4-Clause": [f"{_BSD} 3. [All advertising materials mentioning features or use] of this software [must display the following acknowledgement]: This product includes software developed by the organization. 4. Neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, [subject to the following restrictions]: 1. The origin of this software must not be misrepresented"],
    "BSL-1.0": [
        "Distributed under the [Boost] Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person [or organization] obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the [Eclipse] Public License [v1.0] which accompanies this distribution"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the [Eclipse] Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the [Eclipse] Public License, Version 2.0."],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    **{
        f"CC-{short}-{version}": [f"Licensed under CC {short} {version}.", f"This work is licensed under a Creative Commons {long} {version} {region} License."]
        for version, region in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"))
        for short, long in _ATTRIBUTIONS.items()
    },
}
#: Title lines of the licenses' own texts, short names, and a choice of two versions.
for _name, _more in {
    "GPL-2.0-only": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "licensed under the [GPLv2]"],
    "GPL-3.0-only": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "licensed under the [GPLv3]"],
    "LGPL-2.1-only": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "licensed under the [LGPLv2] 1"],
    "LGPL-3.0-only": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "licensed under the [LGPLv3]"],
    "AGPL-3.0-only": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "licensed under the [AGPLv3]"],
}.items():
    _MARKED[_name] = [*_MARKED[_name], *_more]
_MARKED["GPL-2.0-only OR GPL-3.0-only"] = ["This work is licensed under the GNU General Public License, version 2 [or] version 3.", "[SPDX-License-Identifier: GPL-2.0-only OR GPL-3.0-only]"]
#: An SPDX tag line names a license outright.
for _name in list(_MARKED):
    if " " not in _name:
        _MARKED[_name] = [*_MARKED[_name], f"[SPDX-License-Identifier: {_name}]"]
TEMPLATES = {name: [re.sub(r"[\[\]]", "", t) for t in own] for name, own in _MARKED.items()}
#: Of a template's text the parts in brackets.
CLAUSES = {re.sub(r"[\[\]]", "", t): re.findall(r"\[(.*?)\]", t) for own in _MARKED.values() for t in own}
#: Licenses that hold another one's clauses belong to its family; others are of the family their name begins with.
FAMILIES = {"0BSD": "ISC", "X11": "MIT"}
#: Words that have to be aligned where a template has them, and words that change a license's meaning.
DECIDING = {"affero", "lesser", "library", "later", "apache", "mozilla", "mit", "isc", "cc", "cc0", "by", "nc", "nd", "sa", "attribution", "noncommercial", "noderivatives", "sharealike"}
QUALIFIERS = {"affero", "lesser", "nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike"}
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MEMBER = np.zeros(256, bool)
_MEMBER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
SCHEMA = "doc_id long, license string, coverage double, aligned_words int, template_words int, span_words int, char_start long, char_end long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def family(name: str) -> str:
    return FAMILIES.get(name, name.split("-")[0])


def tokens(text: str) -> list[bytes]:
    return _WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def places(words: list[bytes], clauses: list[str]) -> set[int]:
    """Where the clauses stand among the words."""
    out: set[int] = set()
    for c in map(tokens, clauses):
        out |= {j for i in range(len(words) - len(c) + 1) if words[i : i + len(c)] == c for j in range(i, i + len(c))}
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by their first) whose second increases, by patience piles."""
    tops: list[int] = []
    index: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            index.append(i)
        else:
            tops[pile], index[pile] = b, i
        back[i] = index[pile - 1] if pile else -1
    out = []
    i = index[-1] if index else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two word lists."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        one_a: dict[int, int] = {}
        for i in range(a0, a1):
            one_a[a[i]] = -1 if a[i] in one_a else i
        one_b: dict[int, int] = {}
        for j in range(b0, b1):
            one_b[b[j]] = -1 if b[j] in one_b else j
        anchors = increasing([(i, one_b[w]) for w, i in one_a.items() if i >= 0 and one_b.get(w, -1) >= 0])
        if anchors:
            out += anchors
            for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
                todo.append((i + 1, i2, j + 1, j2))
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str | list[str]], coverage: float = MIN_COVERAGE):
        self.coverage = coverage
        digits = [str(d).encode() for d in range(10)]
        ids: dict[bytes, int] = {w: i for i, w in enumerate([*digits, *sorted(q.encode() for q in QUALIFIERS), b"not", b"or", b"version"])}
        named = [(name, tokens(t), places(tokens(t), CLAUSES.get(t, []))) for name, own in templates.items() for t in ([own] if isinstance(own, str) else own)]
        named = [n for n in named if n[1]]
        self.templates = [(name, [ids.setdefault(w, len(ids)) for w in t]) for name, t, _ in named]
        self.families = [family(name) for name, _ in self.templates]
        self.ids = {w: ids[w] for w in (b"not", b"or", b"version")}
        numbers, other = set(range(10)), {ids[q.encode()] for q in QUALIFIERS}
        deciding = {ids[w.encode()] for w in DECIDING if w.encode() in ids}
        self.must = []  # of each template the positions that have to be aligned
        self.bars = []  # and the words that may not stand in its span unaligned
        for (_, t), (_, _, own) in zip(self.templates, named, strict=True):
            version = [j for j, w in enumerate(t) if w in numbers and len(t) < 60]  # longer ones number their clauses
            self.must.append({j for j, w in enumerate(t) if w in deciding} | set(version) | own)
            self.bars.append(other | (numbers if version else set()))
        # a template is looked up by the word it has to have that fewest templates have; one without such a word is always tried
        common = Counter(w for (_, t), must in zip(self.templates, self.must, strict=True) for w in {t[j] for j in must})
        self.by: dict[int, list[int]] = {}
        self.always = []
        for i, ((_, t), must) in enumerate(zip(self.templates, self.must, strict=True)):
            if must:
                self.by.setdefault(min((t[j] for j in must), key=lambda w: (common[w], w)), []).append(i)
            else:
                self.always.append(i)
        data, offs = kernel.joined(list(ids))
        hashes = kernel.span_hash(kernel.running_hash(data), offs[:-1], offs[1:]) if ids else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def hits(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text with template words: its row, the words' places among its words, their ids, starts and ends in bytes."""
        low = kernel.fold(data)
        starts, ends = kernel.runs(_MEMBER[low], offs)
        h = kernel.span_hash(kernel.running_hash(low), starts, ends)
        at = np.minimum(np.searchsorted(self.sorted, h), max(0, len(self.sorted) - 1))
        known = np.flatnonzero(self.sorted[at] == h) if len(self.sorted) and len(h) else np.zeros(0, np.int64)
        first = np.searchsorted(starts, offs)
        cut = np.searchsorted(known, first)
        for d in np.flatnonzero(np.diff(cut)):
            k = known[cut[d] : cut[d + 1]]
            yield int(d), k - first[d], self.order[at[k]], starts[k] - offs[d], ends[k] - offs[d]

    def barred(self, t: int, got: list[tuple[int, int]], word: list[int]) -> bool:
        """Whether a word stands unaligned in the span that makes it another license."""
        aligned = {i for i, _ in got}
        return any(word[i] in self.bars[t] and i not in aligned for i in range(got[0][0], got[-1][0]))

    def disowned(self, t: int, got: list[tuple[int, int]], place: list[int], word: list[int]) -> bool:
        """Whether "not" stands right before the match, or it is a notice of one version and "or" with another version follows."""
        a, z = got[0][0], got[-1][0]
        begin = a - 1  # the template's first words may be unaligned
        while begin >= 0 and place[begin] >= place[a] - 1 - got[0][1]:
            if word[begin] == self.ids[b"not"]:
                return True
            begin -= 1
        if not self.templates[t][0].endswith("-only") or z + 2 >= len(word) or word[z + 1] != self.ids[b"or"] or place[z + 1] != place[z] + 1:
            return False
        k = z + 3 if word[z + 2] == self.ids[b"version"] and z + 3 < len(word) else z + 2
        return word[k] < 10 and place[k] - place[z + 1] <= 2

    def scan(self, place: list[int], word: list[int]) -> list[tuple[int, list[tuple[int, int]], float]]:
        """Matches of one text as (template, aligned pairs of hit and template position, score). place, word: of the hits."""
        have = Counter(word)
        found = []
        tried = [*self.always, *(t for w in have if w in self.by for t in self.by[w])]
        for t in sorted(tried):
            tmpl, must = self.templates[t][1], self.must[t]
            if not all(have[tmpl[j]] for j in must):
                continue
            kinds = Counter(tmpl)
            need = self.coverage * len(tmpl)
            # no more of a word can be aligned than stand on either side
            if sum(min(c, have[w]) for w, c in kinds.items()) < need:
                continue
            own = [i for i, w in enumerate(word) if w in kinds]
            # stretches start at hits; one is as long as a match may be
            reach = int(MAX_SPAN * len(tmpl)) + 1
            n, i, j = len(own), 0, 0
            inside: Counter[int] = Counter()
            most = 0  # the sum over words of the lesser count, in own[i:j] or the template
            while i < n:
                while j < n and place[own[j]] < place[own[i]] + reach:
                    w = word[own[j]]
                    most += inside[w] < kinds[w]
                    inside[w] += 1
                    j += 1
                if most >= need:
                    pairs = align([word[x] for x in own[i:j]], tmpl)
                    if len(pairs) >= need:
                        got = [(own[i + a], b) for a, b in pairs]
                        span = place[got[-1][0]] - place[got[0][0]] + 1
                        if span <= MAX_SPAN * len(tmpl) + 1 and must <= {b for _, b in got} and not self.barred(t, got, word) and not self.disowned(t, got, place, word):
                            found.append((t, got, 2 * len(got) / (len(tmpl) + span)))
                w = word[own[i]]
                inside[w] -= 1
                most -= inside[w] < kinds[w]
                i += 1
        whole = [(m[1][0][0], m[1][-1][0], len(m[1]), self.families[m[0]]) for m in found]
        found = [m for m, (a, z, n, f) in zip(found, whole, strict=True) if not any(f == f2 and a2 <= a and z <= z2 and n <= INNER * n2 for a2, z2, n2, f2 in whole)]
        found.sort(key=lambda m: (-m[2], -len(m[1]), m[1][0][0], m[0]))
        kept: list[tuple[int, list[tuple[int, int]], float]] = []
        for m in found:
            if all(m[1][-1][0] < k[1][0][0] or m[1][0][0] > k[1][-1][0] for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m[1][0][0])


def scan_licenses(df: DataFrame, templates: dict[str, str | list[str]] | None = None, text: str = "text", coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per match: SCHEMA. Texts are not shuffled."""
    bounded_batches(df.sparkSession)
    chosen = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        for b in batches:
            ids = b.column(0).to_pylist()
            data, offs = kernel.flat(b.column(1))
            rows: list[tuple] = []
            for lo, hi in kernel.chunks(offs):
                part, own = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                for d, place, word, starts, ends in scanner.hits(part, own):
                    for t, pairs, _ in scanner.scan(place.tolist(), word.tolist()):
                        name, tmpl = scanner.templates[t]
                        a, z = pairs[0][0], pairs[-1][0]
                        body = part[own[d] : own[d + 1]]
                        chars = [int(np.count_nonzero((body[:x] & 0xC0) != 0x80)) for x in (starts[a], ends[z])]
                        rows.append((ids[lo + d], name, len(pairs) / len(tmpl), len(pairs), len(tmpl), int(place[z] - place[a] + 1), *chars))
            cols = list(zip(*rows, strict=True)) or [()] * len(NAMES)
            types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], NAMES)

    return df.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, SCHEMA)
