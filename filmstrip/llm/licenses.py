"""License scans: matching statistics against a generalised suffix automaton.

The automaton holds every run of words of all templates. Streaming a file's words
through it gives at each word the longest run ending there that some template has, and
where the template has it. Long matches of one template in order, close together, are
chained into spans; a template whose words are covered well enough is found. Only words
that occur in a template are streamed one by one; all others reset the match, and are
found without a Python object per word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import held, slices

# Phrases whose consecutive words are places of a licence.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Templates, as published: whole licences where they are short, else the
# notices that their authors ask to be put into files.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. "
    "You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
TEMPLATES = {
    "gpl": _GNU.format("General Public License", "3"),
    "agpl": _GNU.format("Affero General Public License", "3"),
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. "
    "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY + " "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause": _BSD + _BSD_END,
    "bsd-3-clause": _BSD + _BSD_THIRD + _BSD_END,
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "unlicense": "This is free and unencumbered software released into the public domain. "
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    + _WARRANTY + " IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
    "For more information, please refer to <http://unlicense.org/>",
}

#: Words of the shortest match that counts, of the widest gap within a chain, and the
#: share of a template that a chain must cover.
LEAST, GAP, COVER = 3, 8, 0.6

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


class Automaton:
    """A generalised suffix automaton of token sequences. Each state keeps the template
    and the end of its first occurrence."""

    def __init__(self, templates: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.where = [-1], [0], [(-1, -1)]
        for k, tokens in enumerate(templates):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token, (k, i))

    def _state(self, length: int, where: tuple[int, int], edges: dict, link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.where.append(where)
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: str) -> int:
        """The state for the runs of q that p's runs and the token make."""
        if self.length[p] + 1 == self.length[q]:
            return q
        twin = self._state(self.length[p] + 1, self.where[q], dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, token: str, where: tuple[int, int]) -> int:
        if token in self.next[last]:
            return self._split(last, self.next[last][token], token)
        new = self._state(self.length[last] + 1, where, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][token], token)
        return new

    def statistics(self, tokens) -> list[tuple[int, int]]:
        """(length, state) of the longest known run that ends at each token."""
        state = size = 0
        out = []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                size += 1
            out.append((size, state))
        return out


def _stretches(matches: list[tuple[int, int, int]]):
    """Matches (place in the file, place in the template, words), in order, in stretches
    that no chain joins."""
    part, end = [], 0
    for m in matches:
        if part and m[0] > end + 1 + GAP:
            yield part
            part = []
        end = max(end, m[0] + m[2] - 1) if part else m[0] + m[2] - 1
        part.append(m)
    if part:
        yield part


def _best_chain(matches: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(words of the template covered, first and last word in the file) of the best chain
    of matches that go on in file and template, over gaps of at most GAP words in the
    file. Of the earlier matches only those count that a match can still follow."""
    best, open_ = (0, 0, 0), []  # open: end in the file, end in the template, covered, first word
    for f, t, n in matches:
        open_ = [x for x in open_ if x[0] >= f - 1 - GAP]
        e, u = f + n - 1, t + n - 1
        covered, first = n, f
        for x in open_:
            if x[0] < e and x[1] < u:
                more = x[2] + min(n, u - x[1], e - x[0])
                if (more, x[3]) > (covered, first):
                    covered, first = more, x[3]
        open_.append((e, u, covered, first))
        if covered > best[0]:
            best = (covered, first, e)
    return best


class _Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.labels = list(templates)
        self.templates = [words(t) for t in templates.values()]
        self.automaton = Automaton(self.templates)
        self.places = [self._ends(k) for k in range(len(self.templates))]
        self.phrases = [(words(p), label) for p, label in phrases.items()]
        #: Templates of fewer words than a match has are looked for whole.
        self.short = [(t, k) for k, t in enumerate(self.templates) if 0 < len(t) < LEAST]
        self.shortest = min([LEAST, *(len(w) for w, _ in self.phrases + self.short)])
        known = sorted({w for t in self.templates for w in t} | {w for p, _ in self.phrases for w in p})
        h = np.array([scan.word_hash(w, scan.ALNUM)[0] for w in known], np.uint64)
        order = np.argsort(h)
        self.hashes, self.words = h[order], [known[i] for i in order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(h >> np.uint64(44)).astype(np.int64)] = True

    def _ends(self, k: int) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i, w in enumerate(self.templates[k]):
            out.setdefault(w, []).append(i)
        return out

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known words, and their numbers."""
        at = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[number] == h[at]
        return at[same], number[same]

    def matches(self, tokens: list[str], begin: int) -> list[tuple[int, int, int, int]]:
        """Maximal matches of LEAST words or more in a run of known words, in every
        template that has them: (template, place in it, place in the file, words)."""
        stats, out = self.automaton.statistics(tokens), []
        for i, (size, _) in enumerate(stats):
            if size >= LEAST and (i + 1 == len(stats) or stats[i + 1][0] <= size):
                run = tokens[i - size + 1 : i + 1]
                for k, t in enumerate(self.templates):
                    for e in self.places[k].get(run[-1], []):
                        if e + 1 >= size and t[e - size + 1 : e + 1] == run:
                            out.append((k, e - size + 1, begin + i - size + 1, size))
        return out

    def chains(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, share of the template covered) of chains of
        matches that cover enough: the best chain of a stretch of the file, then the best
        of what lies before it and after it."""
        out = []
        by_template: dict[int, list] = {}
        for k, t, f, n in found:
            by_template.setdefault(k, []).append((f, t, n))
        for k in sorted(by_template):
            size, todo = len(self.templates[k]), list(_stretches(sorted(by_template[k])))
            while todo:
                some = todo.pop()
                covered, first, last = _best_chain(some)
                if covered >= COVER * size:
                    out.append((k, first, last, covered / size))
                    todo += [x for x in ([m for m in some if m[0] + m[2] <= first], [m for m in some if m[0] > last]) if x]
        return sorted(out)

    def phrase_places(self, tokens: list[str], begin: int, phrases: list[tuple]) -> list[tuple]:
        out = []
        for phrase, label in phrases:
            n = len(phrase)
            out += [(begin + i, label) for i in range(len(tokens) - n + 1) if tokens[i] == phrase[0] and tokens[i : i + n] == phrase]
        return out

    def scan(self, h: np.ndarray):
        """(phrase places, spans) of a file's word hashes."""
        at, number = self.known(h)
        places, found = [], []
        first = np.flatnonzero(np.r_[True, np.diff(at) > 1]) if len(at) else []
        for a, b in zip(first, [*first[1:], len(at)]):
            if b - a < self.shortest:
                continue
            tokens = [self.words[i] for i in number[a:b]]
            places += self.phrase_places(tokens, int(at[a]), self.phrases)
            found += [(k, 0, i, len(self.templates[k])) for i, k in self.phrase_places(tokens, int(at[a]), self.short)]
            if b - a >= LEAST:
                found += self.matches(tokens, int(at[a]))
        return sorted(places), self.chains(found)


SPANS = "array<struct<label:string,first_word:long,last_word:long,cover:double>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans (label, first and last word, share covered).

    Null, empty and wordless texts have no places, empty labels and score 0. n_base
    counts all places of phrases, overlapping ones too; first_word and last_word are
    the smallest and largest start of a phrase, null if there is none; labels adds
    those of spans. score is the largest share of a template that a span covers, 1 if
    there is a phrase. Other columns are ignored."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    key = (tuple(templates.items()), tuple(phrases.items()))
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())]))

    def batches(it):
        scanners = held("licenses")
        if key not in scanners:
            scanners[key] = _Scanner(templates, phrases)
        scanner = scanners[key]
        for batch in slices(it, "text"):
            h, begin = scan.words(batch.column(1), scan.ALNUM)
            cols: list[list] = [[] for _ in names[1:]]
            for a, b in zip(begin, begin[1:]):
                places, spans = scanner.scan(h[a:b])
                base = {label for _, label in places}
                row = [b - a, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {scanner.labels[s[0]] for s in spans})), 1.0 if places else max((min(s[3], 1.0) for s in spans), default=0.0), [dict(zip(("label", "first_word", "last_word", "cover"), (scanner.labels[s[0]], *s[1:]))) for s in spans]]
                for c, x in zip(cols, row):
                    c.append(x)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span_type]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, types)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(batches, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}")
