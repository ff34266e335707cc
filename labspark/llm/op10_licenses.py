"""License scans: winnowed template fingerprints pick candidates, banded alignment verifies.

Templates are word sequences. The hashes of their three-word grams are winnowed (in each
window of four the smallest stays), so that any run of six words shared with a text holds a
kept gram; templates of fewer words keep all their grams. The kept grams form an inverted
index from hash to template and place, of a size fixed by the template list, which is
broadcast. Every gram of a whole text is looked up; hits on neighbouring diagonals make one
candidate place, and a banded alignment of template and text there gives the matched words,
their coverage of the template, and the span in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.llm._text import batches, shingles, words

# License notices, as their authors publish them.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


@dataclass(frozen=True)
class LicenseParams:
    """gram words a gram, window grams a winnowing window; a place counts from coverage on.

    band bounds the words left out or added before a place, a fifth of a shorter template's.
    """

    gram: int = 3
    window: int = 4
    band: int = 6
    coverage: float = 0.8


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash in each window, the last of equal ones; all where there are fewer."""
    if len(hashes) <= window:
        return np.arange(len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    return np.unique(len(hashes) - 1 - (views.argmin(axis=1) + np.arange(len(views))))


def align(template: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(matched words, start, end) of the best fitting alignment of a template within a longer stretch of text.

    The stretch is the template's length and a slack; offset d of text over template ranges
    over that slack, which is the band. A match adds 2; a changed, left-out or added word
    costs 1. The words of the text before and after are free. Of equal scores the one with
    more matches wins, then the earlier end.
    """
    n, slack = len(template), len(text) - len(template)
    unit = 1 << 20
    d = np.arange(slack + 1)
    best, origin = np.zeros(slack + 1, np.int64), d.copy()
    for i in range(n):
        same = text[i : i + slack + 1] == template[i]
        new, start = best + np.where(same, 2 * unit + 1, -unit), origin.copy()
        skip = best[1:] - unit  # the template's word is left out
        better = skip > new[:-1]
        new[:-1] = np.where(better, skip, new[:-1])
        start[:-1] = np.where(better, origin[1:], start[:-1])
        level = new + d * unit  # words of the text are added
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, d, 0))
        first = np.where(level == top, d, source)
        best, origin = top - d * unit, start[first]
    end = int(best.argmax())
    return int(best[end] & (unit - 1)), int(origin[end]), end + n


class LicenseIndex:
    """Templates as word hashes, and the inverted index of their winnowed grams."""

    def __init__(self, templates: dict[str, str], params: LicenseParams) -> None:
        self.params, self.names, self.words = params, [], []
        postings: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for name, own in zip(templates, words(pa.array(list(templates.values()), pa.string()), punctuation=False), strict=True):
            if not len(own.hashes):
                continue
            self.names.append(name)
            self.words.append(own.hashes)
            width = min(params.gram, len(own.hashes))
            grams = shingles(own.hashes, width)
            short = len(own.hashes) < params.gram + params.window - 1
            for place in np.arange(len(grams)) if short else winnow(grams, params.window):
                postings.setdefault(width, {}).setdefault(int(grams[place]), []).append((len(self.names) - 1, int(place)))
        self.postings = postings
        self.keys = {width: np.sort(np.fromiter(p, np.uint64, len(p))) for width, p in postings.items()}

    def scan(self, hashes: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, end) of each place found, by place; places of one template don't overlap.

        Of overlapping places of different templates the closer stays.
        """
        starts: dict[int, list[int]] = {}
        for width, keys in self.keys.items():
            if len(hashes) < width:
                continue
            grams = shingles(hashes, width)
            hit = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, grams), len(keys) - 1)] == grams)
            for place in hit.tolist():
                for template, inner in self.postings[width][int(grams[place])]:
                    starts.setdefault(template, []).append(place - inner)
        found = []
        for template, places in starts.items():
            own, spans = self.words[template], []
            band = min(self.params.band, max(1, len(own) // 5))
            for low, high in _runs(sorted(set(places)), band):
                # The stretch reaches the band's width beyond the place, also past the text's ends.
                a, b = low - band, high + len(own) + band
                stretch = np.zeros(b - a, np.uint64)
                inside = slice(max(0, -a), max(0, -a) + min(b, len(hashes)) - max(0, a))
                stretch[inside] = hashes[max(0, a) : min(b, len(hashes))]
                matched, first, end = align(own, stretch)
                if matched >= self.params.coverage * len(own):
                    spans.append((matched / len(own), max(a + first, 0), min(a + end, len(hashes))))
            taken: list[tuple[float, int, int]] = []
            for span in sorted(spans, key=lambda s: s[1:]):
                if taken and span[1] < taken[-1][2]:
                    if span[0] > taken[-1][0]:
                        taken[-1] = span
                else:
                    taken.append(span)
            found += [(self.names[template], *t) for t in taken]
        return _closest(sorted(found, key=lambda f: (f[2], f[0])), {n: len(w) for n, w in zip(self.names, self.words, strict=True)})


def _closest(found: list[tuple[str, float, int, int]], sizes: dict[str, int]) -> list[tuple[str, float, int, int]]:
    """found, by first word, without places that share words with a closer one.

    How close a place is: its matched words over the longer of template and place, so that
    added words count against it. Equally close places both stay.
    """
    close = [c * sizes[name] / max(sizes[name], b - a) for name, c, a, b in found]
    loses = [False] * len(found)
    for i, (_, _, _, end) in enumerate(found):
        j = i + 1
        while j < len(found) and found[j][2] < end:
            if close[i] != close[j]:
                loses[i if close[i] < close[j] else j] = True
            j += 1
    return [f for f, lost in zip(found, loses, strict=True) if not lost]


def _runs(places: list[int], band: int) -> Iterator[tuple[int, int]]:
    """Runs of starts no further than band from the run's first, so that a stretch stays bounded."""
    low = high = places[0]
    for p in places[1:]:
        if p - low > band:
            yield low, high
            low = p
        high = p
    yield low, high


HITS = "array<struct<license: string, coverage: double, first_word: int, n_words: int, first_byte: long, end_byte: long>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, params: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id and licenses (template, coverage, span in words and UTF-8 bytes) of each row of docs.

    Places are in the order of the text. Words are runs of letters, digits and non-ASCII
    characters, A-Z as a-z. Null and wordless texts have none; repeated rows get a row each;
    templates without words are never found.
    """
    index = LicenseIndex(TEMPLATES if templates is None else templates, params)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            out = []
            for own in words(batch.column("text"), punctuation=False):
                out.append([
                    {"license": name, "coverage": c, "first_word": a, "n_words": b - a, "first_byte": int(own.starts[a]), "end_byte": int(own.ends[b - 1])}
                    for name, c, a, b in shared.value.scan(own.hashes)
                ])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, kind)], names=["doc_id", "licenses"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("licenses", T.DataType.fromDDL(HITS))])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
