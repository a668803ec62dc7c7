"""Licence scans: blocks and windows of normalised text compared to templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_limits, as_text, only, table
from .license_texts import TEXTS

#: Least Dice coefficient of a match.
THRESHOLD = 0.8
# Short notices of public licences, by identifier.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "BSD": ["Licensed under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
TEMPLATES = {name: [*NOTICES.get(name, []), *TEXTS.get(name, [])] for name in [*NOTICES, *(n for n in TEXTS if n not in NOTICES)]}
_WORD = re.compile(r"[^\W_]+")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")


def normalise(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; spellings made equal, copyright and comment marks left out."""
    swap = {"licence": "license", "licenced": "licensed", "sublicence": "sublicense"}
    return [swap.get(w, w) for w in _WORD.findall(plain(text))]


def plain(text: str) -> str:
    return text.lower().replace("(c)", "   ")


def bigrams(words: list[str]) -> Counter:
    """Counts of neighbouring words; a single word is paired with nothing."""
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter({(w, ""): 1 for w in words})


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * sum(min(n, b[g]) for g, n in a.items() if g in b) / total if total else 0.0


class Matcher:
    """Templates by bigram and by size.

    2 min(a, b)/(a + b) bounds the coefficient of blocks of a and b bigrams, so only templates within
    size * t/(2 - t) and size * (2 - t)/t, and only ones that share a bigram, can reach the threshold t.
    """

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = [(name, bigrams(normalise(t))) for name, texts in templates.items() for t in texts]
        self.sizes = [b.total() for _, b in self.templates]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, (_, b) in enumerate(self.templates):
            for g in b:
                self.holders.setdefault(g, []).append(i)
        self.factor = threshold / (2 - threshold)
        # a little wider than the bounds, so that rounding leaves out no block on them
        self.least, self.most = min(self.sizes) * self.factor - 1e-9, max(self.sizes) / self.factor + 1e-9

    def match(self, words: list[str]) -> tuple[str, float] | None:
        """The best template of a block, or None; of equally good ones the first named."""
        size = max(1, len(words) - 1)
        if not words or not self.least <= size <= self.most:
            return None
        pairs = list(zip(words, words[1:])) if len(words) > 1 else [(words[0], "")]
        shared = Counter(i for g in pairs if g in self.holders for i in self.holders[g])
        best, own = None, None
        for i in sorted(shared):
            if 2 * shared[i] < self.threshold * (size + self.sizes[i]) - 1e-9:  # the counts bound what is shared
                continue
            if not self.factor * size - 1e-9 <= self.sizes[i] <= size / self.factor + 1e-9:
                continue
            own = own or bigrams(words)
            score = dice(own, self.templates[i][1])
            if score >= self.threshold and (best is None or score > best[1]):
                best = (self.templates[i][0], score)
        return best

    def windows(self, words: list[str]) -> list[tuple[int, int]]:
        """Word ranges [start, end) that reach the threshold, wherever they stand; of overlapping ones the best.

        A best range begins and ends with a bigram of its template, so for each such bigram the ranges from
        it to later ones are tried, where as many as the threshold takes stand within the size bound. Ranges
        of one licence don't overlap; one of another licence is left out if a better one shares half of the
        larger's words (texts of two versions are alike), but not for a short notice within a long one.
        Templates of one word have no bigram and are found as whole blocks only.
        """
        places: dict[int, list[int]] = {}
        for at, g in enumerate(zip(words, words[1:])):
            if g in self.holders:
                for i in self.holders[g]:
                    places.setdefault(i, []).append(at)
        found = []
        for i, where in places.items():
            name, own = self.templates[i]
            n, least, span = self.sizes[i], math.ceil(self.factor * self.sizes[i] - 1e-9), int(self.sizes[i] / self.factor + 1e-9)
            for a in range(len(where) - least + 1):
                start = where[a]
                if where[a + least - 1] - start >= span:
                    continue
                left, shared, best = dict(own), 0, (0.0, 0)
                for b in range(a, len(where)):
                    size = where[b] - start + 1
                    if size > span:
                        break
                    g = words[where[b]], words[where[b] + 1]
                    if left[g]:
                        left[g] -= 1
                        shared += 1
                        best = max(best, (2 * shared / (size + n), size))
                if best[0] >= self.threshold:
                    found.append((-best[0], -best[1], i, start, start + best[1] + 1, name))
        taken: dict[int, list[tuple[int, int, str]]] = {}
        for *_, start, end, name in sorted(found):
            there = {x for at in range(start, end) for x in taken.get(at, ())}
            if not any(x[2] == name or 2 * (min(end, x[1]) - max(start, x[0])) >= max(end - start, x[1] - x[0]) for x in there):
                for at in range(start, end):
                    taken.setdefault(at, []).append((start, end, name))
        return sorted({x[:2] for there in taken.values() for x in there})


@lru_cache(1)
def default_matcher() -> Matcher:
    return Matcher()


def blocks_of(text: str, matcher: Matcher | None = None) -> Iterator[tuple[str, int, str]]:
    """(kind, first line, text): the lines, the paragraphs of several lines, the whole text of several paragraphs,
    and the windows, which are notices that share their line or paragraph with other words or go over several.

    A window that overlaps a line, paragraph or text with the same licence is that notice again and left out.
    """
    yield from whole_blocks(text)
    matcher = matcher or default_matcher()
    words = normalise(text)
    ranges = matcher.windows(words)
    if not ranges:
        return
    ends = list(accumulate((len(normalise(line)) for line in text.split("\n")), initial=0))
    taken: dict[str, list[tuple[int, int]]] = {}
    for _, line, block in whole_blocks(text):
        hit = matcher.match(normalise(block))
        if hit:
            taken.setdefault(hit[0], []).append((ends[line], ends[line + block.count("\n") + 1]))
    # blocks of a licence, with nested ones merged, don't overlap: the last that begins before a window's end decides
    merged = {name: merge(spans) for name, spans in taken.items()}
    for start, end in ranges:
        hit = matcher.match(words[start:end])
        spans = merged.get(hit[0], []) if hit else []
        at = bisect_left(spans, (end,)) - 1
        if hit and (at < 0 or spans[at][1] <= start):
            yield "window", bisect_right(ends, start) - 1, " ".join(words[start:end])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def whole_blocks(text: str) -> Iterator[tuple[str, int, str]]:
    """The blocks that are whole lines, paragraphs and texts."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        yield "line", i, line
    paragraphs, at = _PARAGRAPH.split(text), 0
    for p in paragraphs:
        n = p.count("\n")
        if n:
            yield "paragraph", at, p
        at += n + 2
    if len(paragraphs) > 1:
        yield "text", 0, text


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and licence: doc_id, license, matches (blocks), dice (the best), line (its first line).

    Blocks are lines, paragraphs of several lines, the whole text and, for notices amid other words, windows. Null and
    empty texts match nothing, an empty table gives no rows, and rows that repeat are reported each. Time and
    memory for one text grow with its words, also where they all stand in one line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_text(batch.column("text")).to_pylist()):
                found: dict[str, list] = {}
                for _, line, block in blocks_of(text, matcher) if text else ():
                    hit = matcher.match(normalise(block))
                    if hit:
                        best = found.setdefault(hit[0], [0, 0.0, 0])
                        best[0] += 1
                        if hit[1] > best[1]:
                            best[1:] = [hit[1], line]
                rows += [(doc_id, name, *f) for name, f in sorted(found.items())]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "license", "matches", "dice", "line"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, matches long, dice double, line long")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every whole text of ``documents``."""
    arrow_limits(spark)
    return scan(only(table(spark, sf_dir, "documents"), doc_id="long", text="string"))
