"""Licence notices in texts, found through a positional index of the templates' rarest words.

How rare a licence word is, is counted over all texts. A template matches a stretch of at most 1.25 times its length in
which at least ``SIMILAR`` of its words stand in its order, and one of its label's key phrases. At most a fifth of a
template's words may be missing, so that of its ``indexed`` rarest words, that fifth and ``AGREE`` of all, the share
``AGREE`` stands in any match. A text's words are looked up in that index; where enough of a template's words lie close
together, and no more often than the template has them, its order is compared over the whole stretch by the longest
common subsequence. No number of words, places or templates is limited.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import batches, whole, word_hashes
from .shared import arrow, columns

#: Base phrases and their labels; fixed values of the query's contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public notices that labels share, as words.
DISCLAIMED = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
REDISTRIBUTED = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
ENDORSED = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
FREE = "is free software you can redistribute it and or modify it under the terms of the"
HOPED = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the"
COPY = "you should have received a copy of the"
CREATIVE = "this work is licensed under a creative commons"
#: Notices by label, and phrases one of which must stand in a match.
TEMPLATES = {
    "agpl": (["gnu affero general public license"], [
        f"this program {FREE} gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program {HOPED} gnu affero general public license for more details {COPY} gnu affero general public license along with this program",
        f"this program {FREE} gnu affero general public license as published by the free software foundation",
        "licensed under the gnu affero general public license version 3",
    ]),
    "all-rights-reserved": (["all rights reserved"], ["all rights reserved"]),
    "apache": (["apache license"], [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "licensed under the apache license version 2 0",
    ]),
    "boost": (["boost software license"], [
        "distributed under the boost software license version 1 0",
        "boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
    ]),
    "bsd": (["redistributions of source code", "bsd license"], [
        f"{REDISTRIBUTED} 1 {SOURCE} 2 {BINARY} {DISCLAIMED}",
        f"{REDISTRIBUTED} 1 {SOURCE} 2 {BINARY} 3 {ENDORSED} {DISCLAIMED}",
        f"{REDISTRIBUTED} {SOURCE}",
        "licensed under the bsd license",
    ]),
    "cc-by": (["cc by", "creative commons attribution"], ["licensed under cc by 4 0", f"{CREATIVE} attribution 4 0 international license"]),
    "cc-by-nc": (["cc by nc", "attribution noncommercial", "attribution non commercial"], ["licensed under cc by nc 4 0", f"{CREATIVE} attribution noncommercial 4 0 international license", f"{CREATIVE} attribution non commercial 4 0 international license"]),
    "cc-by-nd": (["cc by nd", "attribution noderivatives", "attribution noderivs"], ["licensed under cc by nd 4 0", f"{CREATIVE} attribution noderivatives 4 0 international license"]),
    "cc-by-sa": (["cc by sa", "attribution sharealike", "attribution share alike"], ["licensed under cc by sa 4 0", f"{CREATIVE} attribution sharealike 4 0 international license", f"{CREATIVE} attribution share alike 4 0 international license"]),
    "cc0": (["cc0"], ["licensed under cc0 1 0 universal", "cc0 1 0 universal public domain dedication"]),
    "gpl": (["gnu general public license"], [
        f"this program {FREE} gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program {HOPED} gnu general public license for more details {COPY} gnu general public license along with this program",
        f"this program {FREE} gnu general public license as published by the free software foundation",
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 2",
    ]),
    "isc": (["purpose with or without fee"], [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ]),
    "lgpl": (["lesser general public license"], [
        f"this library {FREE} gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library {HOPED} gnu lesser general public license for more details {COPY} gnu lesser general public license along with this library",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        "licensed under the gnu lesser general public license version 3",
    ]),
    "mit": (["mit license", "permission is hereby granted free of charge"], [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "released under the mit license",
        "licensed under the mit license",
    ]),
    "mpl": (["mozilla public license"], [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
    ]),
    "unlicense": (["released into the public domain"], [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        "this is free and unencumbered software released into the public domain",
    ]),
    "zlib": (["this software is provided as is without any express or implied warranty"], [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
    ]),
}
#: The share of a template's words that must stand in order, that of its indexed words, and the longest stretch.
SIMILAR, AGREE, STRETCH = 0.8, 0.3, 1.25


class Template:
    """``need`` of the ``n`` words must stand, in order, within ``span`` words; ``least`` of its indexed words."""

    def __init__(self, label: str, text: str, keys: list[str], idf: dict[str, float]):
        words = text.split()
        self.label, self.n, self.h = label, len(words), word_hashes(text)
        self.keys = [word_hashes(k) for k in keys]
        self.need, self.span, self.least = ceil(SIMILAR * self.n - 1e-9), max(self.n, int(STRETCH * self.n)), max(1, ceil(AGREE * self.n - 1e-9))
        rare = sorted(range(self.n), key=lambda q: (-idf[words[q]], words[q], q))[: self.n - self.need + self.least]
        self.indexed, self.often = np.unique(self.h[rare], return_counts=True)
        self.places: dict[int, int] = {}
        for q, w in enumerate(self.h.tolist()):
            self.places[w] = self.places.get(w, 0) | 1 << q
        self.back: dict[int, int] = {}
        for q, w in enumerate(self.h[::-1].tolist()):
            self.back[w] = self.back.get(w, 0) | 1 << q

    def order(self, words: list[int], places: dict[int, int], until: int) -> tuple[int, int]:
        """How many of the template's words stand in order in ``words``, and after how many words it was that many; ends
        as soon as it is ``until``. A zero bit of ``v`` is a step of the longest common subsequence."""
        full, same, at = (1 << self.n) - 1, 0, 0
        v = full
        for i, w in enumerate(words):
            if m := places.get(w):
                u = v & m
                if u:
                    v = ((v + u) | (v - u)) & full
                    if (now := self.n - v.bit_count()) > same:
                        same, at = now, i + 1
                        if same >= until:
                            break
        return same, at

    def stretches(self, h: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, float]]:
        """``(first word, last word, share of words in order)`` of matches in ``h[lo:hi]``, that do not overlap."""
        step, done = max(1, self.span // 2), lo
        words = h[lo:hi].tolist()
        while done < hi:
            end = min(hi, done + self.span + step)
            same, at = self.order(words[done - lo : end - lo], self.places, self.need)
            if same < self.need:  # no window that begins within the step has enough
                done += step
                continue
            stop = done + at
            _, back = self.order(words[done - lo : stop - lo][::-1], self.back, self.need)
            start = stop - back  # the last beginning of a window that ends here
            if stop - start > self.span:
                done = start + 1
                continue
            # the notice may begin before and end after the least that is enough
            left, right = max(done, stop - self.span), min(hi, start + self.span)
            most, at = self.order(words[left - lo : right - lo], self.places, self.n)
            stop = left + at
            _, back = self.order(words[left - lo : stop - lo][::-1], self.back, most)
            yield stop - back, stop - 1, most / self.n
            done = stop


class Index:
    """``seen`` has the number of texts with each licence word, ``of`` that of all texts."""

    def __init__(self, seen: dict[str, int] | None = None, of: int = 0, templates: dict = TEMPLATES):
        seen = seen or {}
        idf = {w: log((1 + of) / (1 + seen.get(w, 0))) for w in vocabulary(templates)}
        self.base = [(word_hashes(p), label) for p, label in BASE.items()]
        self.templates = [Template(label, text, keys, idf) for label, (keys, notices) in sorted(templates.items()) for text in notices]
        self.words = np.unique(np.concatenate([t.indexed for t in self.templates]))
        self.often = np.zeros((len(self.templates), len(self.words)), np.int64)
        for i, t in enumerate(self.templates):
            self.often[i, np.searchsorted(self.words, t.indexed)] = t.often
        self.least = np.array([t.least for t in self.templates])
        self.first = np.unique(np.array([b[0][0] for b in self.base], np.uint64))

    def places(self, h: np.ndarray, phrase: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the places ``at`` the phrase begins at."""
        at = at[at + len(phrase) <= len(h)]
        for k, w in enumerate(phrase):
            at = at[h[at + k] == w]
        return at

    def matches(self, h: np.ndarray, at: np.ndarray) -> list[tuple[str, int, int, float]]:
        """``(label, first word, last word, share of words in order)``; ``at``: where indexed words stand."""
        word = np.searchsorted(self.words, h[at])
        have = np.bincount(word, minlength=len(self.words))
        out = []
        for i in np.nonzero(np.minimum(have, self.often).sum(1) >= self.least)[0]:
            t = self.templates[i]
            own = at[self.often[i][word] > 0]
            # runs of hits of which enough lie within a stretch
            close = np.nonzero(own[t.least - 1 :] - own[: len(own) - t.least + 1] < t.span)[0]
            if not len(close):
                continue
            lo, hi = np.maximum(0, own[close + t.least - 1] - t.span), np.minimum(len(h), own[close] + t.span)
            cut = np.nonzero(lo[1:] > np.maximum.accumulate(hi)[:-1])[0] + 1
            for a, b in zip(lo[np.concatenate([[0], cut])], np.maximum.reduceat(hi, np.concatenate([[0], cut])), strict=True):
                for first, last, share in t.stretches(h, int(a), int(b)):
                    part = h[first : last + 1]
                    if any(len(self.places(part, k, np.nonzero(part == k[0])[0])) for k in t.keys):
                        out.append((t.label, first, last, share))
        return sorted(out)

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[np.ndarray], list[tuple[str, int, int, float]]]]:
        """For each text its number of words, the places of each base phrase, and matches."""
        none = [np.zeros(0, np.int64)] * len(self.base)
        out: list = [(0, none, [])] * len(texts)
        for which, h in whole(texts):
            ends = np.nonzero(np.diff(which, append=-1))[0]
            lows = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
            indexed, begins = np.isin(h, self.words), np.isin(h, self.first)
            hit = np.logical_or.reduceat(indexed | begins, lows) if len(lows) else lows
            for lo, hi, found in zip(lows, ends + 1, hit, strict=True):
                base, more = none, []
                if found:
                    own, at = h[lo:hi], np.nonzero(begins[lo:hi])[0]
                    base, more = [self.places(own, phrase, at) for phrase, _ in self.base], self.matches(own, np.nonzero(indexed[lo:hi])[0])
                out[which[lo]] = (int(hi - lo), base, more)
        return out


def vocabulary(templates: dict = TEMPLATES) -> list[str]:
    return sorted({w for _, notices in templates.values() for t in notices for w in t.split()})


def rarity(docs: DataFrame, templates: dict = TEMPLATES) -> tuple[dict[str, int], int]:
    """For each licence word the number of ``docs`` that have it, and the number of docs; as many rows as licence words."""
    words = vocabulary(templates)
    known = np.array([int(word_hashes(w)[0]) for w in words], np.uint64)
    order = np.argsort(known)
    ranked = known[order]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(words), np.int64), 0
        for b in found:
            rows += b.num_rows
            held: dict[int, set] = {}
            for which, _, h in batches(b.column(0).to_pylist()):
                place = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
                own = ranked[place] == h
                pairs = np.unique(which[own] * len(ranked) + place[own])
                if len(which) and which[0] == which[-1]:  # a long text may come in several blocks
                    new = set((pairs % len(ranked)).tolist()) - held.setdefault(int(which[0]), set())
                    held[int(which[0])] |= new
                    seen[list(new)] += 1
                else:
                    seen += np.bincount(pairs % len(ranked), minlength=len(ranked))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(ranked))], pa.int32()), pa.array([rows, *seen], pa.int64())], ["word", "n"])

    arrow(docs.sparkSession)
    told = columns(docs, "text").select(F.col("text").cast("string")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {x.word: x.n for x in told.collect()}
    return {words[order[i]]: counts.get(i, 0) for i in range(len(ranked))}, counts.get(-1, 0)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches)``, a row for each row.

    Null texts count as empty: no words, no labels, score 0. ``matches`` has label:first word:last word:share for each
    notice found. The score is the largest share of a notice's words in order, 0.5 for a base phrase outside any notice,
    else 0. Texts of any length are read whole. Repeated rows each have their result, a null doc_id stays null, an empty
    table gives an empty result. Columns other than doc_id and text are not read.
    """
    index = Index(*rarity(docs))
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(index)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            rows = []
            for n, base, more in told.value.scan(b.column(1).to_pylist()):
                at, labels = np.concatenate(base), sorted({label for (_, label), x in zip(told.value.base, base, strict=True) if len(x)})
                both = sorted({*labels, *(m[0] for m in more)})
                score = max([0.0, *(m[3] for m in more), *([0.5] if labels else [])])
                ends = (int(at.min()), int(at.max())) if len(at) else (None, None)
                rows.append((n, len(at), *ends, ",".join(labels), ",".join(both), score, ",".join(f"{m[0]}:{m[1]}:{m[2]}:{m[3]:.3f}" for m in more)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string")
