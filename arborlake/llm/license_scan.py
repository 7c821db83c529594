"""License scans by a generalised suffix automaton (operator 5).

The automaton accepts every run of words of every template. Streaming a text
through it gives, at each word, the longest suffix that is a run of some
template (matching statistics), and by its suffix links the runs that end
there in every template. Runs of ``MIN_MATCH`` words or more that cannot be
extended are chained, in order on both sides, into the template span that
covers most words; a template whose chain covers enough of it adds its label.
Where spans of two licences lie over each other, the one whose template is
covered better stands. Licence names and short forms, mostly of fewer words than such a run,
add theirs where they stand whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import permutations, product

import pyarrow as pa
from pyspark.sql import DataFrame

from arborlake.llm.textvec import UPPER_TO_LOWER, by_text, project

#: Phrases whose places are counted, and the labels they give. (Fixed values.)
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label and wording of public licence texts and notices. (Fixed values.)
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "under the terms of the GNU General Public License"),
    ("gpl", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("boost", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at"),
)


def _creative_commons() -> list[tuple[str, str]]:
    """Label and wording of the six attribution licences, their parts in any order."""
    parts = {"nc": ("nc", "noncommercial", "non commercial"), "sa": ("sa", "sharealike", "share alike"), "nd": ("nd", "noderivatives", "no derivatives", "noderivs", "no derivs")}
    out = []
    for kind in ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        for order in permutations(kind):
            for said in product(*(parts[k] for k in order)):
                rest = "".join(f" {x}" for x in said)
                out += [("-".join(("cc", "by", *kind)), head + rest) for head in ("cc by", "cc attribution", "creative commons by", "creative commons attribution", "creativecommons org licenses by")]
    return out


#: Label and wording of licence names and short forms; of those that begin at one word the longest counts. (Fixed values.)
NOTICES = (
    *_creative_commons(),
    *(("cc0", x) for x in ("cc0", "cc zero", "creative commons zero", "creativecommons org publicdomain zero")),
    *(("cc", x) for x in ("creative commons license", "creative commons licence", "creative commons public license")),
    *(("lgpl", x) for x in ("lgpl", "lgplv2", "lgplv3", "lesser general public license", "lesser general public licence", "lesser gpl", "library general public license")),
    *(("agpl", x) for x in ("agpl", "agplv3", "affero general public license", "affero general public licence", "affero gpl")),
    *(("gpl", x) for x in ("gnu gpl", "gplv2", "gplv3", "gpl v2", "gpl v3", "gpl 2 0", "gpl 3 0", "gpl version 2", "gpl version 3", "gnu general public licence")),
    *(("mit", x) for x in ("mit licence", "mit licensed", "spdx license identifier mit", "opensource org licenses mit")),
    *(("apache", x) for x in ("apache 2 0", "apache licence", "apache software license", "apache org licenses license 2 0")),
    *(("bsd", x) for x in ("bsd license", "bsd licence", "bsd licensed", "bsd style license", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "2 clause bsd", "3 clause bsd", "4 clause bsd", "simplified bsd", "new bsd", "modified bsd")),
    *(("0bsd", x) for x in ("0bsd", "zero clause bsd", "bsd zero clause")),
    *(("isc", x) for x in ("isc license", "isc licence", "spdx license identifier isc")),
    *(("mpl", x) for x in ("mozilla public license", "mozilla public licence", "mpl 1 1", "mpl 2 0", "mplv2")),
    *(("epl", x) for x in ("eclipse public license", "epl 1 0", "epl 2 0")),
    *(("cddl", x) for x in ("cddl", "common development and distribution license")),
    *(("eupl", x) for x in ("eupl", "european union public license", "european union public licence")),
    *(("artistic", x) for x in ("artistic license", "artistic licence", "artistic 2 0")),
    *(("ofl", x) for x in ("open font license", "ofl 1 1")),
    *(("odbl", x) for x in ("odbl", "open database license", "open database licence")),
    *(("gfdl", x) for x in ("gfdl", "gnu free documentation license", "gnu free documentation licence")),
    *(("boost", x) for x in ("boost software license", "bsl 1 0")),
    *(("zlib", x) for x in ("zlib license", "zlib libpng license")),
    *(("psf", x) for x in ("python software foundation license", "psf license")),
    *(("unlicense", x) for x in ("the unlicense", "unlicense org")),
    ("wtfpl", "wtfpl"),
)
#: The two words alone are a licence only in capitals: a letter may say "please cc by noon".
_CC_BY = re.compile(r"\bCC[ _-]BY\b")
_VERSIONS = ([b"1"], [b"2"], [b"3"], [b"4"])
MIN_MATCH = 5
#: Share of a template that its chain must cover.
MIN_COVER = 0.5
#: A template of fewer words must be covered whole: half of one can be ordinary words.
SHORT = 16

_TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in UPPER_TO_LOWER)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, in UTF-8."""
    return text.encode().translate(_TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton over word ids."""

    def __init__(self, templates: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        #: for each state, where (template, past the end) its words end
        self.ends: list[set[tuple[int, int]]] = [set()]
        self.sizes = [len(t) for t in templates]
        self.templates: list[list[int]] = []
        for k, words in enumerate(templates):
            self.templates.append([self.ids.setdefault(w, len(self.ids)) for w in words])
            last = 0
            for at, w in enumerate(self.templates[-1]):
                last = self._extend(last, w)
                self._mark(last, (k, at + 1))

    def _new(self, length: int, moves: dict[int, int], link: int, ends: set[tuple[int, int]]) -> int:
        self.next.append(moves)
        self.len.append(length)
        self.link.append(link)
        self.ends.append(ends)
        return len(self.len) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q], set(self.ends[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier template has this run
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c)
        new, p = self._new(self.len[last] + 1, {}, 0, set()), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return new

    def _mark(self, state: int, end: tuple[int, int]) -> None:
        while state > 0:
            self.ends[state].add(end)
            state = self.link[state]

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(words read, state, longest suffix that is a run of some template) at each word where that is MIN_MATCH words or more."""
        inside = bytes(map(self.ids.__contains__, words))
        for stretch in re.finditer(b"\x01{%d,}" % MIN_MATCH, inside):
            state = size = 0
            for i in range(stretch.start(), stretch.end()):
                c = self.ids[words[i]]
                while state and c not in self.next[state]:
                    state = self.link[state]
                    size = self.len[state]
                if c in self.next[state]:
                    state, size = self.next[state][c], size + 1
                else:
                    state = size = 0
                if size >= MIN_MATCH:
                    yield i + 1, state, size

    def runs(self, words: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """template -> (first word in the text, first word in the template, words) of its runs that cannot be extended on either side."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for i, state, size in self.statistics(words):
            after = self.ids.get(words[i], -1) if i < len(words) else -1
            seen: set[tuple[int, int]] = set()
            while size >= MIN_MATCH:
                for k, end in self.ends[state] - seen:
                    if end == self.sizes[k] or self.templates[k][end] != after:
                        out.setdefault(k, []).append((i - size, end - size, size))
                seen |= self.ends[state]
                state = self.link[state]
                size = self.len[state]
        return out

    def spans(self, words: list[bytes]) -> dict[int, tuple[int, int, int]]:
        """template -> (words covered, first word, past the last word) of its best chain."""
        return {k: chain(found, self.sizes[k]) for k, found in self.runs(words).items()}


def chain(runs: list[tuple[int, int, int]], reach: int) -> tuple[int, int, int]:
    """(words covered, first word, past the last word) of the chain of runs that covers most words of a template.

    Runs of a chain begin and end in one order in the text and in the
    template, at most ``reach`` words of the text apart; where two overlap,
    the common words count once. Ties go to the earlier, then the shorter span.
    """
    runs = sorted(runs)
    best: list[tuple[int, int]] = []  # covered, less the first word
    low = 0
    top = (0, 0, 0)
    longest = max(n for _, _, n in runs)
    for at, (i, j, n) in enumerate(runs):
        while runs[low][0] + longest + reach < i:
            low += 1
        covered, first = n, -i
        for b in range(low, at):
            x, y, m = runs[b]
            if x < i and y < j and x + m < i + n and y + m < j + n and i - (x + m) <= reach:
                new = (best[b][0] + n - max(0, x + m - i, y + m - j), best[b][1])
                if new > (covered, first):
                    covered, first = new
        best.append((covered, first))
        if (covered, first, -(i + n)) > (top[0], -top[1], -top[2]):
            top = (covered, -first, i + n)
    return top


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.labels = [label for label, _ in templates]
        self.automaton = Automaton([words_of(t) for _, t in templates])
        self.phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES]
        self.notices: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for label, p in sorted(NOTICES, key=lambda x: -len(x[1].split())):
            words = p.encode().split()
            self.notices.setdefault(words[0], []).append((words, label))

    def noticed(self, text: str, words: list[bytes]) -> dict[str, tuple[int, int]]:
        """label -> (first word, past the last word) of the first of its notices."""
        out: dict[str, tuple[int, int]] = {}
        if self.notices.keys().isdisjoint(words):
            return out
        for at, w in enumerate(words):
            for notice, label in self.notices.get(w, ()):
                if words[at : at + len(notice)] == notice:
                    if notice != [b"cc", b"by"] or words[at + 2 : at + 3] in _VERSIONS or _CC_BY.search(text):
                        out.setdefault(label, (at, at + len(notice)))
                    break
        return out

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        places, base = [], set()
        if b"license" in words:
            for phrase, label in self.phrases:
                n, at = len(phrase), -1
                while True:
                    try:
                        at = words.index(phrase[-1], at + 1)
                    except ValueError:
                        break
                    if tuple(words[max(0, at - n + 1) : at + 1]) == phrase:
                        places.append(at - n + 1)
                        base.add(label)
        found = []
        for k, (covered, start, end) in self.automaton.spans(words).items():
            c = covered / self.automaton.sizes[k]
            if c >= (1.0 if self.automaton.sizes[k] < SHORT else MIN_COVER):
                found.append((-c, -covered, start, self.labels[k], end))
        share: dict[str, tuple[float, int, int]] = {}
        standing: list[tuple[str, int, int]] = []
        for c, _, start, label, end in sorted(found):
            # licences borrow from each other: a span that lies mostly in a better covered one of another licence does not count
            if any(x != label and 2 * (min(b, end) - max(a, start)) > end - start for x, a, b in standing):
                continue
            standing.append((label, start, end))
            share.setdefault(label, (-c, start, end))
        for label, (start, end) in self.noticed(text, words).items():
            if share.get(label, (0.0,))[0] < 1.0:
                share[label] = (1.0, start, end)
        labels = sorted(base | set(share))
        spans = [{"label": x, "first_word": s, "end_word": e, "cover": c} for x, (c, s, e) in sorted(share.items())]
        score = max([c for c, *_ in share.values()], default=0.5 if base else 0.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, spans


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())])


def scan_licenses(docs: DataFrame, make: Callable[[], Scanner] = Scanner) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the spans found.

    Null and empty texts have no words, no labels and score 0; texts of any
    length are scanned whole; of spans that cover alike the first counts.
    Repeated rows give repeated rows; an empty table gives no rows; other
    columns are ignored.
    """

    def one():
        return make().scan

    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])
    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,cover:double>>"
    return by_text(project(docs), one, schema, ddl)
