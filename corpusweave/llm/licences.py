"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of tokens of every template. A file is streamed through it once:
at each token it knows the longest run ending there that some template also has (the matching
statistics). Long runs that follow each other in file and template are chained, and a chain that
covers enough of its template is a finding. Short phrases are found where the stream stands on
their last token with their whole length matched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.llm.common import slices, texts_of

# Phrases that name a licence, and the label of each.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Further short notices.
SHORT_NOTICES = (
    ("cc by", "cc"), ("creative commons attribution", "cc"), ("creative commons license", "cc"), ("all rights reserved", "proprietary"), ("mozilla public license", "mpl"), ("eclipse public license", "epl"), ("isc license", "isc"), ("bsd license", "bsd"),
    ("spdx license identifier mit", "mit"), ("spdx license identifier apache 2 0", "apache"), ("spdx license identifier gpl", "gpl"), ("spdx license identifier bsd", "bsd"), ("gnu gpl", "gpl"), ("gnu lesser general public license", "lgpl"),
)
WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
# Wording of common public licence texts and notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
)

#: The score of a text that names a licence without its wording.
MENTIONED = 0.5

#: A-Z to lower case, every other ASCII byte that is no letter or digit to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over integer tokens."""

    def __init__(self, texts: list[list[int]]):
        self.next, self.link, self.len, self.ends = [{}], [-1], [0], [[]]
        for t, tokens in enumerate(texts):
            state = 0
            for i, c in enumerate(tokens):
                state = self._extend(state, c)
                self.ends[state].append((t, i))
        self.longer: list[list[int]] = [[] for _ in self.len]
        for s in range(1, len(self.len)):
            self.longer[self.link[s]].append(s)

    def places(self, state: int) -> Iterator[tuple[int, int]]:
        """(text, last place) of each occurrence of a state's runs: they end its own runs and those that have them as suffixes."""
        todo = [state]
        while todo:
            s = todo.pop()
            yield from self.ends[s]
            todo += self.longer[s]

    def _new(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves), self.link.append(link), self.len.append(length), self.ends.append([])
        return len(self.len) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the run `p then c`, parted from longer ones if need be."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        new = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c], p = new, self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._new(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c], p = new, self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new


class Scanner:
    """Templates and phrases in one automaton."""

    def __init__(self, base, short, templates, min_match: int, max_gap: int, min_cover: float):
        self.labels = [x[1] for x in base] + [x[1] for x in short] + [x[0] for x in templates]
        texts = [words_of(x[0]) for x in base] + [words_of(x[0]) for x in short] + [words_of(x[1]) for x in templates]
        self.n_base, self.n_phrases = len(base), len(base) + len(short)
        self.vocab: dict[bytes, int] = {}
        ids = [[self.vocab.setdefault(w, len(self.vocab)) for w in t] for t in texts]
        self.sizes = [len(t) for t in ids]
        self.sam = Automaton(ids)
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        # phrases that end where a state stands; whether its own length reaches them is tested on the way
        self.phrases: list[list[int]] = [[] for _ in self.sam.len]
        for t in range(self.n_phrases):
            state = 0
            for c in ids[t]:
                state = self.sam.next[state][c]
            self.phrases[state].append(t)
        for s in sorted(range(1, len(self.phrases)), key=self.sam.len.__getitem__):
            if (up := self.sam.link[s]) > 0:
                self.phrases[s] = list({*self.phrases[s], *self.phrases[up]})

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """(phrase, start) of every place of a phrase, and (label, first, last, covered share) of every chain."""
        nxt, link, length, phrases, sizes = self.sam.next, self.sam.link, self.sam.len, self.phrases, self.sizes
        found, runs = [], defaultdict(list)
        state = size = 0
        at = -2
        for i, c in [(i, c) for i, c in enumerate(map(self.vocab.get, words)) if c is not None]:
            if i != at + 1 or c not in nxt[state]:
                if size >= self.min_match:
                    self._report(runs, state, size, at)
                if i != at + 1:
                    state = size = 0
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
                for t in phrases[state]:
                    if sizes[t] <= size:
                        found.append((t, i - sizes[t] + 1))
            at = i
        if size >= self.min_match:
            self._report(runs, state, size, at)
        return found, self._chains(runs)

    def _report(self, runs: dict, state: int, size: int, at: int) -> None:
        for t, end in self.sam.places(state):
            if t >= self.n_phrases:
                runs[t].append((at - size + 1, at, end - size + 1, end))

    def _chains(self, runs: dict) -> list[tuple[str, int, int, float]]:
        out = []
        for t, matches in runs.items():
            matches.sort()
            best: list[tuple[int, int, int]] = []  # covered tokens, first word, last word
            for k, (a, b, x, y) in enumerate(matches):
                cover, first = y - x + 1, a
                for j in range(k - 1, -1, -1):
                    if matches[j][0] < a - self.max_gap - self.sizes[t]:
                        break
                    if matches[j][1] < a <= matches[j][1] + self.max_gap and matches[j][3] < x and best[j][0] + y - x + 1 > cover:
                        cover, first = best[j][0] + y - x + 1, best[j][1]
                best.append((cover, first, b))
            ends: dict[int, tuple[int, int, int]] = {}
            for chain in best:  # one finding for each place where chains begin
                if chain[0] > ends.get(chain[1], (0,))[0]:
                    ends[chain[1]] = chain
            out += [(self.labels[t], a, b, n / self.sizes[t]) for n, a, b in ends.values() if n >= self.min_cover * self.sizes[t]]
        return sorted(out)


@lru_cache(maxsize=4)
def _scanner(*args) -> Scanner:
    return Scanner(*args)


FOUND = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,cover:double>>"


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", base=BASE_PHRASES, short=SHORT_NOTICES, templates=TEMPLATES, min_match: int = 4, max_gap: int = 30, min_cover: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans.

    Words are runs of letters and digits after lower-casing A-Z; all places of the base phrases
    count in n_base, and first_word and last_word are their smallest and largest start (null if
    none). labels adds those of short notices and of templates covered by min_cover at least;
    score is the largest covered share of a template among the chains, and MENTIONED where only a
    phrase stands or the chains cover less (0 where nothing is). spans lists chains as word intervals. Null text is empty; texts are read whole; repeated
    rows give repeated rows; other columns are ignored; an empty table gives an empty one.
    """
    args = (base, short, templates, min_match, max_gap, min_cover)
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([given.schema[0], *T.StructType.fromDDL(FOUND).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*args)
        for part in slices(batches):
            rows = []
            for t in texts_of(part):
                words = words_of(t)
                phrases, chains = scanner.scan(words)
                places = [at for p, at in phrases if p < scanner.n_base]
                named = {scanner.labels[p] for p, _ in phrases if p < scanner.n_base}
                every = named | {scanner.labels[p] for p, _ in phrases} | {c[0] for c in chains}
                rows.append((
                    len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(named)), ",".join(sorted(every)),
                    max([MENTIONED if phrases else 0.0, *(float(c[3]) for c in chains)]), [dict(zip(("label", "first", "last", "cover"), c)) for c in chains],
                ))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], schema.names)

    return given.mapInArrow(run, schema)
