"""License scans by patience alignment of a text's words with license templates.

Words that are unique to a stretch of both text and template are anchors; the longest increasing
subsequence of them is taken, and the gaps between anchors are aligned again the same way. Where a gap has
no anchor, equal words at its ends are taken. Coverage is the aligned share of a template's words; a license
is found where coverage is at least ``least`` and the aligned words are dense enough in the text.

Templates are a parameter; the default ones are the notices below and the whole public texts in ``license_texts``.
A text is aligned only with templates of which it has enough words, which leaves coverage as it is. A long template
is aligned with stretches of the text by where it would begin, each wide enough for every occurrence that begins there.

Defined results: null and empty texts have no license; templates that tie are both found, and the first by
name is the best; repeated rows each get their row.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.llm.text import blobs, id_text, read_table, rows, slices

# Texts of public licenses and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-2.1-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0": "Licensed under CC0 1.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "reserved": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Templates of more words than this are long; their naming words stand among the first so many.
LONG, TITLE = 300, 30


def whole_texts() -> dict[str, str]:
    """The public licenses' whole texts, by file name."""
    folder = Path(__file__).with_name("license_texts")
    return {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted(folder.glob("*.txt"))}


#: Keeps ASCII letters, digits and all bytes above ASCII, in lower case.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words that tell licenses of one family apart: those of a template must align, and none but those may stand there.
VERSION = re.compile(rb"[0-9]+")
GNU = {b"lesser", b"affero", b"library"}
CC = {b"nc", b"nd", b"sa"}
WORD = re.compile(rb"[^ ]+")
FOUND = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("found", FOUND)])
DDL = "doc_id long, found array<struct<license:string,coverage:double,start:long,end:long>>"


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (in order of the first) whose second numbers rise, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect.bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile], at[pile] = b, i
        back.append(at[pile - 1] if pile else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def aligned(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned positions of two word lists, rising in both; a worklist of gaps instead of calls."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = rising([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if w in where and in_a[w] == 1])
        if anchors:
            out += anchors
            corners = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            gaps += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(corners, corners[1:])]
    return sorted(out)


def densest(pairs: list[tuple[int, int]], need: int, room: int) -> list[tuple[int, int]] | None:
    """The aligned words of the window of ``room`` text words that has most, if it has ``need``."""
    best, low = (0, 0), 0
    for high in range(len(pairs)):
        while pairs[high][0] - pairs[low][0] >= room:
            low += 1
        best = max(best, (high - low + 1, -low))
    n, low = best[0], -best[1]
    return pairs[low : low + n] if n >= need else None


def named(words: list[bytes], pairs: list[tuple[int, int]], template: list[bytes]) -> bool:
    """Whether the aligned words hold every naming word of the template, and the stretch no other one."""
    held, at = {template[j] for _, j in pairs}, {i for i, _ in pairs}
    title = template[:TITLE] if len(template) > LONG else template
    if any((VERSION.fullmatch(w) or w in GNU and b"gnu" in template or w in CC and b"cc" in template) and w not in held for w in title):
        return False
    last = pairs[-1][0] + 1
    inner = [i for i in range(pairs[0][0], last) if i not in at]
    return not any(words[i] in GNU and words[i - 1] == b"gnu" or b"cc" in template and words[i] in CC for i in inner)


def windows(places: list[tuple[int, int]], n: int, slack: float) -> Iterator[tuple[int, int]]:
    """Stretches of the text in which a template of n words may lie, given places (text word, template word)."""
    if n <= LONG:
        for i, j in places:
            yield i - j, i - j + n  # word for word, also among its own copies
            yield i - int(j * slack) - 1, i + int((n - j) * slack) + 1
        return
    step, wide = n // 10, int(n * (slack - 1)) + 1
    for start in dict.fromkeys((i - j) // step * step for i, j in places):  # one begin for a tenth of the template
        yield start - step, start + n + 2 * step
        yield start - wide, start + step + n + wide


def searched(words: list[bytes], template: list[bytes], counted: Counter, least: float, slack: float) -> tuple[int, list[tuple[int, int]]]:
    """The words that an occurrence of the template needs, and the stretches in which one may lie: around every place of
    the template's rarest words, so a common word elsewhere in the text does not hide it."""
    need = int(np.ceil(least * len(template)))
    counts = Counter(w for w in words if w in counted)
    if sum(counted[w] for w in counts) < need:
        return need, []
    # An occurrence has at least `distinct` different words, so one of these rarest ones is among them.
    distinct = need - (len(template) - len(counted))
    rarest = set(sorted(counts, key=lambda w: (counts[w], w))[: max(1, len(counts) - distinct + 1)])
    where: dict[bytes, list[int]] = {}
    for j, w in enumerate(template):
        if w in rarest:
            where.setdefault(w, []).append(j)
    places = [(i, j) for i, w in enumerate(words) for j in where.get(w, ())]
    return need, list(dict.fromkeys((max(0, low), min(len(words), high)) for low, high in windows(places, len(template), slack) if high > 0))


def occurrence(words: list[bytes], template: list[bytes], low: int, high: int, need: int, slack: float) -> list[tuple[int, int]] | None:
    """The aligned pairs of the template within one stretch of the text, in places of the whole text."""
    if high - low < need:
        return None
    pairs = densest(aligned(words[low:high], template), need, int(len(template) * slack) + 1)
    return [(low + i, j) for i, j in pairs] if pairs and named(words[low:high], pairs, template) else None


def best_in(words: list[bytes], template: list[bytes], counted: Counter, least: float, slack: float) -> list[tuple[int, int]] | None:
    """The occurrence of a template that has most of its words: its aligned pairs."""
    need, stretches = searched(words, template, counted, least, slack)
    best = None
    for low, high in stretches:
        pairs = occurrence(words, template, low, high, need, slack)
        if pairs and (best is None or len(pairs) > len(best)):
            best = pairs
            if len(pairs) == len(template):
                break
    return best


def all_in(words: list[bytes], template: list[bytes], counted: Counter, least: float, slack: float) -> list[list[tuple[int, int]]]:
    """Occurrences of a template that do not overlap, the best ones first. All stretches are aligned once; one that a
    better occurrence reaches into is aligned again in what is left of it, so the time grows with the text."""
    need, stretches = searched(words, template, counted, least, slack)
    heap: list[tuple] = []

    def put(low: int, high: int) -> None:
        if pairs := occurrence(words, template, low, high, need, slack):
            heapq.heappush(heap, (-len(pairs), pairs[-1][0] - pairs[0][0], pairs[0][0], low, high, pairs))

    for low, high in stretches:
        put(low, high)
    starts: list[int] = []  # of the occurrences taken, in order, with their ends
    ends: list[int] = []
    out = []
    while heap:
        *_, low, high, pairs = heapq.heappop(heap)
        a, b = pairs[0][0], pairs[-1][0] + 1
        k = bisect.bisect_right(ends, a)
        if k == len(starts) or starts[k] >= b:
            starts.insert(k, a)
            ends.insert(k, b)
            out.append(pairs)
            continue
        k = bisect.bisect_right(ends, low)
        while low < high:  # the free parts of the stretch
            until = min(high, starts[k]) if k < len(starts) else high
            put(low, until)
            low, k = (ends[k] if k < len(starts) else high), k + 1
    return out


def not_inside(found: list[dict]) -> list[dict]:
    """Without those that lie inside one of more words: a longer notice holds the words of a shorter one. Occurrences of
    one license do not overlap, so few are open at any place."""
    out, open_ = [], []
    for _, here in groupby(sorted(found, key=lambda x: x["start"]), key=lambda x: x["start"]):
        here = list(here)
        open_ = [y for y in open_ if y["end"] >= here[0]["start"]] + here
        out += [x for x in here if not any(x["end"] <= y["end"] and y["n"] > x["n"] for y in open_)]
    return out


def find_in(text: bytes, templates: list[tuple[str, list[bytes], Counter, set[bytes]]], least: float, slack: float, every: bool = False) -> list[dict]:
    """Licenses of one text. every: all occurrences of a license that do not overlap, else its best one."""
    words = text.translate(FOLD).split()
    have, found, spans = set(words), [], None
    for name, template, counted, own in templates:
        if sum(counted[w] for w in own & have) < int(np.ceil(least * len(template))):
            continue
        if every:
            places = all_in(words, template, counted, least, slack)
        else:
            places = [pairs] if (pairs := best_in(words, template, counted, least, slack)) else []
        for pairs in places:
            if spans is None:
                spans = [m.span() for m in WORD.finditer(text.translate(FOLD))]
                points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
            first, last = spans[pairs[0][0]], spans[pairs[-1][0]]
            found.append({"license": name, "n": len(pairs), "coverage": round(len(pairs) / len(template), 6), "start": int(points[first[0] - 1]) if first[0] else 0, "end": int(points[last[1] - 1])})
    return [{k: x[k] for k in ("license", "coverage", "start", "end")} for x in sorted(not_inside(found), key=lambda x: (-x["coverage"], x["license"], x["start"]))]


def prepared(templates: dict[str, str]) -> list[tuple[str, list[bytes], Counter, set[bytes]]]:
    split = {name: text.encode().translate(FOLD).split() for name, text in templates.items()}
    return [(name, words, Counter(words), set(words)) for name, words in split.items() if words]


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.9, slack: float = 1.5, every: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, found (license, coverage, code-point span of the best occurrence), best first.

    templates: by name, by default the notices and the whole texts; least: share of a template's words; slack: how many text words, by the template's, they may lie in;
    every: all occurrences of each license that do not overlap, not only its best."""
    sent = docs.sparkSession.sparkContext.broadcast(dict(templates) if templates is not None else TEMPLATES | whole_texts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = prepared(sent.value)
        for batch in slices(batches, "text"):
            yield rows(SCHEMA, batch.column("doc_id"), [find_in(text, ready, least, slack, every) for text in blobs(batch, "text")])

    return id_text(docs, id_col, text_col).mapInArrow(run, DDL)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(read_table(spark, sf_dir, "documents"), every=True)
    best = F.get("found", F.lit(0))
    return found.select("doc_id", best["license"].alias("license"), best["coverage"].alias("coverage"), best["start"].alias("start"), best["end"].alias("end"), F.array_join(F.array_distinct(F.transform("found", lambda x: x["license"])), ",").alias("licenses"), F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",").alias("spans"))
