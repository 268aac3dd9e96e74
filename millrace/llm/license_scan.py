"""License statements in documents: MinHash bands over text windows, then exact containment.

Templates and documents are sequences of word shingles. A template longer than
PIECE shingles is cut into pieces of that many. Documents are cut into windows
of twice PIECE shingles that overlap by half, so every run of up to PIECE + 1
shingles lies whole in one of them. Each window keeps the minima of BANDS hash
functions; with one row in a band, a window that holds m of a piece's shingles
agrees with the piece in some band with probability 1 - (1 - s) ** BANDS, where
s is their Jaccard similarity, m / 16 at least for a full window: for the two
shingles of the shortest template 1 - (14 / 16) ** 64 > 0.9998, for three
0.999998, for five 1 - 3e-11. What the bands retrieve is then checked on the document's shingles
themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.textnum import window_hashes, word_batches

_U = np.uint64
#: Words of a shingle, shingles of a piece, bands (of one row each), share of a template's shingles that makes a match.
SHINGLE, PIECE, BANDS, THRESHOLD = 3, 8, 64, 0.8
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _stated(name: str, called: str) -> list[tuple[str, str]]:
    return [(name, f"{verb} under the {called}") for verb in ("Licensed", "Released", "Distributed")]


def _gnu(name: str, called: str, version: str, kind: str, colon: str) -> list[tuple[str, str]]:
    free = f"This {kind} is free software{colon} you can redistribute it and/or modify it under the terms of the {called} as published by the Free Software Foundation"
    rest = f"or (at your option) any later version. This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {called} for more details."
    return [*_stated(name, f"{called}, version {version}"), (name, f"{free}, either version {version} of the License"), (name, f"{free}, either version {version} of the License, {rest}")]


_CC = (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-SA", "Attribution-ShareAlike"))
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
_NAMES = "the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"

# Whole public license texts, and the notices that files carry.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."

#: Customary statements and passages of public licenses, as (name, text). "BSD" opens all BSD licenses.
# Identifiers of licenses in the lines that name them so.
SPDX = (
    "0BSD AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-1.0 EPL-2.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense"
).split()

TEMPLATES = (
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
    *_gnu("AGPL-3.0", "GNU Affero General Public License", "3", "program", ":"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community"),
    *_stated("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", f"{_BINARY}. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    ("BSD-3-Clause", f"{_BINARY}. 3. Neither {_NAMES}"),
    ("BSD-3-Clause", f"{_BINARY}. Neither {_NAMES}"),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    *((f"CC-{code}-4.0", f"licensed under a Creative Commons {called} 4.0 International License") for code, called in _CC),
    *((f"CC-{code}-4.0", f"Licensed under CC {code} 4.0") for code, _ in _CC),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    *_gnu("GPL-2.0", "GNU General Public License", "2", "program", ";"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    *_gnu("GPL-3.0", "GNU General Public License", "3", "program", ":"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"),
    *_gnu("LGPL-2.1", "GNU Lesser General Public License", "2.1", "library", ";"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    *_gnu("LGPL-3.0", "GNU Lesser General Public License", "3", "library", ":"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    *_stated("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MIT", _MIT),
    ("BSD-2-Clause", f"{_BSD_OPENING}1. {_BSD_SOURCE}2. {_BINARY}. {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD_OPENING}1. {_BSD_SOURCE}2. {_BINARY}. 3. Neither {_NAMES}. {_BSD_AS_IS}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"),
    ("0BSD", f"{_ISC_GRANT}. {_ISC_AS_IS}"),
    ("Apache-2.0", _APACHE),
    ("MPL-2.0", _MPL),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)

#: Names, versions and joints that tell a license from its relatives: a template that holds one of them asks for all its shingles.
TELLING = (
    *(f"License-Identifier: {name}" for name in SPDX),
    *(f"{verb} under the" for verb in ("licensed", "released", "distributed")),
    *(f"GNU {kind}General Public License" for kind in ("", "Lesser ", "Affero ")),
    *(f"License version {v}" for v in ("2", "2.1", "3")),
    *(f"version {v} of the License" for v in ("2", "2.1", "3")),
    "Apache License Version 2.0",
    "apache.org/licenses/LICENSE-2.0",
    "Mozilla Public License v. 2.0",
    *(f"Eclipse Public License {v}" for v in ("v1.0", "2.0", "v. 2.0")),
    *(f"Commons {called} 4.0 International" for _, called in _CC),
    *(f"CC {code} 4.0" for code, _ in _CC),
    "the distribution. THIS SOFTWARE IS",
    "the distribution. 3. Neither the name",
    "the distribution. Neither the name",
    "All advertising materials mentioning",
    "is hereby granted, provided that",
    "is hereby granted. THE SOFTWARE IS",
)


def plain(text: str | None) -> str:
    """A-Z as a-z, and all other ASCII characters but digits as spaces."""
    return "" if text is None else text.encode("utf-8", "surrogatepass").translate(_LETTERS).decode("utf-8", "surrogatepass")


def shingle_batches(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: words of each text, the shingle hashes of all in order, and the offsets of each text's."""
    for _, words, offsets in word_batches([plain(t) for t in texts]):
        windows = window_hashes(words, SHINGLE)
        counts = np.diff(offsets)
        sizes = np.maximum(counts - SHINGLE + 1, 0)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        take = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], sizes)
        yield counts, windows[take], ends


def shingles(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(words, shingle hashes in order) of each text."""
    for counts, h, ends in shingle_batches(texts):
        for i, n in enumerate(counts.tolist()):
            yield n, h[ends[i] : ends[i + 1]]


_rng = np.random.default_rng(20240)
_FACTORS = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) * _U(2) + _U(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def minima(h: np.ndarray, k: int, starts: np.ndarray) -> np.ndarray:
    """Minimum of hash function k over each run of h."""
    return np.minimum.reduceat((h ^ _SHIFTS[k]) * _FACTORS[k], starts)


class Index:
    """Templates by the band values of their pieces."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        found = [(name, s) for (name, _), (_, s) in zip(templates, shingles([t for _, t in templates])) if len(s)]
        self.names = [name for name, _ in found]
        self.sequences = [s for _, s in found]
        self.sets = [np.unique(s) for s in self.sequences]
        tells = [t for _, t in shingles(TELLING)]
        self.telling: list[set[int]] = []
        for s, own in zip(self.sequences, self.sets):
            held = [t for t in tells if any(np.array_equal(s[at : at + len(t)], t) for at in range(len(s) - len(t) + 1))]
            self.telling.append(set(np.searchsorted(own, np.concatenate(held)).tolist()) if held else set())
        pieces = [(i, s[at : at + PIECE]) for i, s in enumerate(self.sequences) for at in range(0, max(1, len(s) - PIECE // 2), PIECE)]
        self.bands: list[tuple[np.ndarray, np.ndarray]] = []
        owners = np.array([i for i, _ in pieces], np.int64)
        for k in range(BANDS):
            values = np.array([int(minima(p, k, np.zeros(1, np.int64))[0]) for _, p in pieces], _U)
            order = np.argsort(values, kind="stable")
            self.bands.append((values[order], owners[order]))

    def candidates(self, h: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
        """Text -> templates that share a band with some window of its shingles ``h[ends[text]:ends[text + 1]]``."""
        if not len(h) or not self.names:
            return {}
        sizes = np.diff(ends)
        halves = -(-sizes // PIECE)
        first = np.concatenate(([0], np.cumsum(halves)))
        text = np.repeat(np.arange(len(sizes)), halves)
        starts = ends[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * PIECE
        paired = np.append(text[1:] == text[:-1], False)
        found: set[tuple[int, int]] = set()
        for k, (values, owners) in enumerate(self.bands):
            low = minima(h, k, starts)
            low[:-1] = np.where(paired[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
            left = np.searchsorted(values, low)
            left[left == len(values)] = 0
            for at in np.flatnonzero(values[left] == low).tolist():
                a = int(left[at])
                b = int(np.searchsorted(values, values[a], "right"))
                found.update((int(text[at]), o) for o in owners[a:b].tolist())
        out: dict[int, list[int]] = {}
        for i, o in sorted(found):
            out.setdefault(i, []).append(o)
        return out

    def verified(self, h: np.ndarray, i: int) -> tuple[float, int, int, int] | None:
        """(best containment, its first word, its end, number of separate places) of template i, if THRESHOLD is met with all telling shingles."""
        own = self.sets[i]
        at = np.searchsorted(own, h)
        at[at == len(own)] = 0
        places = np.flatnonzero(own[at] == h)
        need = int(np.ceil(THRESHOLD * len(own)))
        reach = len(self.sequences[i]) + max(1, len(self.sequences[i]) // 8)
        best, count, last_end, lo = None, 0, -1, 0
        held: dict[int, int] = {}
        kinds, telling = at[places].tolist(), self.telling[i]
        if not telling.issubset(kinds):
            return None
        places = places.tolist()
        for hi, p in enumerate(places):
            held[kinds[hi]] = held.get(kinds[hi], 0) + 1
            while places[lo] <= p - reach:
                held[kinds[lo]] -= 1
                if not held[kinds[lo]]:
                    del held[kinds[lo]]
                lo += 1
            if len(held) >= need and telling <= held.keys():
                if places[lo] > last_end:
                    count, last_end = count + 1, p
                last_end = max(last_end, p)
                if best is None or len(held) > best[0]:
                    best = (len(held), places[lo], p + SHINGLE)
        return None if best is None else (best[0] / len(own), best[1], best[2], count)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, matches)``, a row for each row.

    ``matches`` is an array of (license, template, containment, first_word,
    end_word, places), sorted by license and template: a template matches where
    a run of shingles an eighth longer than it (one at least) holds THRESHOLD of
    its distinct shingles, all those of the TELLING phrases in it among them, so
    that a name or version of a relative is no match; ``places`` counts runs apart from each other. Null,
    empty and short texts match nothing. ``templates`` is a list in code and is
    sent to the tasks as such. Other columns are ignored.
    """
    templates = list(templates)
    kind = "array<struct<license:string,template:int,containment:double,first_word:long,end_word:long,places:int>>"
    arrow = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("containment", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("places", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            words, matches = [], []
            for counts, h, ends in shingle_batches(batch.column(1).to_pylist()):
                found = index.candidates(h, ends)
                for i, n in enumerate(counts.tolist()):
                    own = []
                    for o in found.get(i, ()):
                        if (hit := index.verified(h[ends[i] : ends[i + 1]], o)) is not None:
                            own.append({"license": index.names[o], "template": o, "containment": hit[0], "first_word": hit[1], "end_word": hit[2], "places": hit[3]})
                    words.append(n)
                    matches.append(sorted(own, key=lambda x: (x["license"], x["template"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(matches, arrow)], ["doc_id", "n_words", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_words long, matches {kind}")


def licenses(scanned: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_licenses, licenses, containment, n_places)`` of a scanned table; without matches '', 0.0 and 0.

    "BSD", the sentence that opens all BSD licenses, is named only where no clause tells which one it is.
    """
    every = F.array_sort(F.array_distinct("matches.license"))
    names = F.when(F.exists(every, lambda n: n.startswith("BSD-")), F.array_remove(every, "BSD")).otherwise(every)
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(names).cast("long").alias("n_licenses"),
        F.concat_ws(",", names).alias("licenses"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("containment"),
        F.aggregate("matches.places", F.lit(0), lambda s, x: s + x).cast("long").alias("n_places"),
    )
