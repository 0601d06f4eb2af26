"""Licence scan: texts compared with licence templates by the Dice coefficient of their word bigrams.

A text is looked at as a whole, by paragraphs, lines and sentences, and by windows of words: for each template
the best windows are found from where its bigrams occur, so notices are also seen in comment blocks, across
lines and amid other text. Marks such as ``#`` or ``*`` at the beginning of lines part words only. Two sets of bigrams of sizes a and
b have a coefficient of at most 2 * min(a, b) / (a + b), so a part is compared only with the templates
whose size is within that bound, and only if it holds a bigram of any template at all. Both are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.buckets import text_groups
from pagecensus.llm.common import arrow_map, prefix_hashes, span_hashes, utf8, window_hashes, word_spans

LEAST_DICE = 0.8

# Notices and short licence texts by their SPDX names; several wordings of one licence are templates each.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

# Full texts, as Debian ships them; their names say the version only, "or later" is said in notices.
_TEXTS = Path(__file__).parent / "licence_texts"
_MORE_TEXTS: tuple[tuple[str, str], ...] = (
    (
        "MIT",
        TEMPLATES[2][1] + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        TEMPLATES[9][1] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
        "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """The full licence texts as templates."""
    files = sorted(_TEXTS.glob("*.txt"))
    return (*((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files), *_MORE_TEXTS)


# Normal form: lower case ASCII letters, digits and letters beyond ASCII; other signs part words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() or b in (9, 10, 11, 12, 13) else 32 for b in range(256)
)
_SENTENCE = re.compile(rb"(?<=[.!?;])[ \t]+")
_PARAGRAPH = re.compile(rb"\n[ \t\r]*\n")


def _hashes(text: bytes) -> np.ndarray:
    folded = text.translate(_FOLD)
    starts, ends = word_spans(folded)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    return span_hashes(prefix_hashes(np.frombuffer(folded, dtype=np.uint8)), starts, ends)


def bigrams(text: bytes) -> np.ndarray:
    """The distinct word bigrams of a text in normal form, as sorted hashes; of one word, itself."""
    words = _hashes(text)
    return np.unique(window_hashes(words, 2 if len(words) > 1 else 1))


def dice(a: np.ndarray, b: np.ndarray) -> float:
    total = len(a) + len(b)
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / total if total else 0.0


def parts(text: bytes) -> Iterator[tuple[str, int, bytes]]:
    """The whole text, its paragraphs, lines and sentences with their byte positions, each part once."""
    seen = set()
    for kind, pattern in (("text", None), ("paragraph", _PARAGRAPH), ("line", re.compile(rb"\n")), ("sentence", None)):
        if kind == "sentence":
            cuts = []
            for line in re.finditer(rb"[^\n]+", text):
                at = line.start()
                for m in _SENTENCE.finditer(text, line.start(), line.end()):
                    cuts.append((at, m.start()))
                    at = m.end()
                cuts.append((at, line.end()))
        elif pattern is None:
            cuts = [(0, len(text))]
        else:
            ends = [*((m.start(), m.end()) for m in pattern.finditer(text)), (len(text), len(text))]
            cuts = list(zip([0, *(e for _, e in ends[:-1])], [s for s, _ in ends], strict=True))
        for start, end in cuts:
            if end > start and (start, end) not in seen:
                seen.add((start, end))
                yield kind, start, text[start:end]


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least = least
        self.templates = sorted(
            ((name, bigrams(utf8(text))) for name, text in templates), key=lambda t: len(t[1])
        )
        self.sizes = np.array([len(t) for _, t in self.templates])
        self.any = np.unique(np.concatenate([t for _, t in self.templates]))
        self.holds = np.stack([np.isin(self.any, t) for _, t in self.templates], axis=1)
        # 2 * s / (a + b) reaches the least coefficient with a >= s only if s is this much of b.
        self.needed = np.ceil(self.sizes * least / (2 - least) - 1e-9)

    def candidates(self, texts: list[bytes]) -> np.ndarray:
        """Which templates each text holds enough bigrams of for some part of it to match them."""
        out = np.zeros((len(texts), len(self.templates)), dtype=bool)
        for begin, some in text_groups(texts):
            joined = b"\n".join(some)
            starts, _ = word_spans(joined.translate(_FOLD))
            doc = np.searchsorted(np.cumsum([len(t) + 1 for t in some]), starts, side="right")
            words = _hashes(joined)
            held = []
            for hashes in (window_hashes(words, 2), window_hashes(words, 1)):
                at = np.minimum(np.searchsorted(self.any, hashes), len(self.any) - 1)
                on = self.any[at] == hashes
                held.append(doc[: len(hashes)][on] * len(self.any) + at[on])
            holder, bigram = np.divmod(np.unique(np.concatenate(held)), len(self.any))
            for t, needed in enumerate(self.needed.tolist()):
                shared = np.bincount(holder[self.holds[bigram, t]], minlength=len(some))
                out[begin : begin + len(some), t] = shared >= needed
        return out

    def windows(self, text: bytes, candidates: list[int]) -> list[tuple[str, str, int, int, float]]:
        """The windows of words that match a template best, those of one template apart from each other."""
        starts, ends = word_spans(text.translate(_FOLD))
        grams = window_hashes(_hashes(text), 2)
        order = np.argsort(grams, kind="stable")
        before = np.full(len(grams), -1, dtype=np.int64)  # where the same bigram stood last
        same = grams[order[1:]] == grams[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        found = []
        for name, template in (self.templates[t] for t in candidates):
            hit = np.isin(grams, template)
            most = int(len(template) * (2 - self.least) / self.least + 1e-9)
            best = []
            # A bigram of the template more never lowers the coefficient: windows begin with a run of them.
            for i in np.flatnonzero(hit & ~np.append(False, hit[:-1])).tolist():
                stop = i + 2 * most
                while True:
                    new = before[i:stop] < i
                    own = np.cumsum(new)
                    if stop >= len(grams) or own[-1] > most:
                        break
                    stop += stop - i
                value = 2 * np.cumsum(new & hit[i:stop]) / (own + len(template))
                last = int(value.argmax())
                if value[last] >= self.least:
                    best.append((-float(value[last]), i, i + last))
            taken: list[tuple[int, int]] = []
            for value, i, last in sorted(best):
                if all(last < first or i > stop for first, stop in taken):
                    taken.append((i, last))
                    found.append((name, "window", int(starts[i]), int(ends[last + 1] - starts[i]), -value))
        return found

    def scan(self, text: bytes, candidates: list[int]) -> list[tuple[str, str, int, int, float]]:
        """``(licence, kind of part, start, length, coefficient)`` of all parts that match a template.

        A window is left out if half of it lies in a match of the same licence, or in a better or equal one.
        """
        found = []
        for kind, start, part in parts(text):
            own = bigrams(part)
            if not len(own) or not np.isin(own, self.any, assume_unique=True).any():
                continue
            low = np.searchsorted(self.sizes, len(own) * self.least / (2 - self.least) - 1e-9)
            high = np.searchsorted(self.sizes, len(own) * (2 - self.least) / self.least + 1e-9, side="right")
            for name, template in self.templates[low:high]:
                value = dice(own, template)
                if value >= self.least:
                    found.append((name, kind, start, len(part), value))
        for window in sorted(self.windows(text, candidates), key=lambda w: (-w[4], -w[3], w[2])):
            name, _, start, length, value = window
            if not any(
                2 * (min(start + length, s + n) - max(start, s)) >= length and (other == name or v >= value)
                for other, _, s, n, v in found
            ):
                found.append(window)
        return found


MATCHES = "doc_id long, licence string, part string, start long, length long, dice double"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]


def _scanned(templates: tuple[tuple[str, str], ...], least: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            texts = [utf8(t) for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_pylist()
            candidates = scanner.candidates(texts)
            rows = [
                (ids[i], *match)
                for i in np.flatnonzero(candidates.any(axis=1)).tolist()
                for match in scanner.scan(texts[i], np.flatnonzero(candidates[i]).tolist())
            ]
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in MATCHES.split(", ")])

    return apply


def scan(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] | None = None,
    least: float = LEAST_DICE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, licence, part, start, length, dice``: parts of texts that are like a template.

    Without ``templates`` these are the notices of ``TEMPLATES`` and the full texts.
    ``start`` and ``length`` are bytes of UTF-8. A part that is like several templates gives a row for
    each. Null and empty texts match nothing; null ids and repeated rows are scanned as they come; an
    empty table gives no rows; other columns are ignored.
    """
    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")
    return arrow_map(rows, _scanned(TEMPLATES + full_texts() if templates is None else tuple(templates), least), MATCHES)


def licences(matches: DataFrame) -> DataFrame:
    """``doc_id, licence, dice, n_matches``: each document's licences with their best coefficient."""
    return matches.groupBy("doc_id", "licence").agg(
        F.max("dice").alias("dice"), F.countDistinct("start", "length").alias("n_matches")
    )
