"""License notices in texts by patience alignment.

Words that stand exactly once in both a window of the text and a template are anchors; the longest run of anchors in
the order of both is kept, and the gaps between them are aligned in the same way, down to words that simply follow or
precede an anchor.  Coverage is the share of the template's words that are aligned.

Windows are found first: a window starts where words of a template that few other templates have stand close together.
Every place of the text is looked at, so a notice may occur several times; the best window of each template counts.

The templates are sent to every executor: they are a fixed, short list, or the caller's, up to ``MAX_TEMPLATE_WORDS``.

Cases: a null or empty text has no license; ties go to the longer template, then to its name; repeated rows give equal
rows; an empty table gives none; other columns are left out; a very long text takes time with its length alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evflow.llm.text import slices, split_words, text_view

MAX_TEMPLATE_WORDS = 200_000

# Notices by name.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_WORD = re.compile(r"\w+(?:[.\-']\w+)*")


class Template(NamedTuple):
    """A notice's name, its words, and which of them tell it from running text."""

    name: str
    words: list[str]
    marks: frozenset[str]


def template_words(text: str) -> list[str]:
    """Lower-case words without the signs around them."""
    return _WORD.findall(text.lower())


def make_templates(texts: dict[str, str]) -> list[Template]:
    """Templates with the words of each that are in the fewest templates, half of its distinct words at least."""
    words = {name: template_words(t) for name, t in sorted(texts.items())}
    if sum(map(len, words.values())) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
    often = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for name, ws in words.items():
        ranked = sorted(set(ws), key=lambda w: (len(w) < 3, often[w], -len(w), w))
        out.append(Template(name, ws, frozenset(ranked[: (len(ranked) + 1) // 2])))
    return [t for t in out if t.words]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first place, that also rises in the second."""
    ends: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(ends, b)
        back[k] = last[at - 1] if at else -1
        if at == len(ends):
            ends.append(b)
            last.append(k)
        else:
            ends[at], last[at] = b, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal words in ``a`` and ``b``, rising in both, by anchors and their gaps."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = rising([(k, where[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where])
        out += anchors
        for (x, y), (u, v) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if anchors and x + 1 < u and y + 1 < v:
                todo.append((x + 1, u, y + 1, v))
    return sorted(out)


def windows(words: list[str], template: Template, least: float) -> Iterator[tuple[int, int]]:
    """Stretches of the text with enough of the template's marks to hold ``least`` of it."""
    n = len(template.words)
    places = [k for k, w in enumerate(words) if w in template.marks]
    need = max(1, int(len(template.marks) - (1 - least) * n))
    group: list[int] = []
    for k in [*places, None]:
        if group and (k is None or k - group[-1] > n):
            if len({words[g] for g in group}) >= need:
                yield max(0, group[0] - n), min(len(words), group[-1] + n + 1)
            group = []
        if k is not None:
            group.append(k)


def coverage(words: list[str], template: Template, least: float) -> tuple[float, int, int, int]:
    """Best coverage of the template in the text, its first and last word there, and how many windows reach ``least``.

    A window that holds the notice more than once is searched again on either side of what was aligned.  One of over
    three times the notice's words is gone through in stretches, each from a word before its first mark on, that overlap
    by the notice's length; so the time grows with the text's length alone.
    """
    best, found = (0.0, 0, 0), 0
    n = len(template.words)
    todo = list(windows(words, template, least))
    while todo:
        start, stop = todo.pop()
        if stop - start < least * n:
            continue
        at, end = start, stop
        if stop - start > 3 * n:
            first = next((k for k in range(start, stop) if words[k] in template.marks), None)
            if first is None:
                continue
            at, end = max(start, first - n), min(stop, first + n + n // 2 + 2)
        pairs = align(words[at:end], template.words)
        share = len(pairs) / n
        if share >= least:
            found += 1
            todo += [(at, at + pairs[0][0]), (at + pairs[-1][0] + 1, stop)]
        elif (at, end) != (start, stop):
            todo.append((first + n // 2 + 1, stop))
        elif stop - start > 2 * n:
            first = next(k for k in range(start, stop) if words[k] in template.marks)
            todo += [(max(start, first - n), min(stop, first + n + 1)), (first + 1, stop)] if first + n + 1 < stop else [(first + 1, stop)]
        if pairs and share > best[0]:
            best = (share, at + pairs[0][0], at + pairs[-1][0])
    return (*best, found)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """The license of each text: the template with most words aligned at a coverage of ``least`` or more, else null.

    Returns doc_id, license, coverage, first_word, last_word (places in the text), n_notices (windows of any template),
    licenses (names of all templates found).
    """
    texts = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = make_templates(texts)
        marks = {w for t in known for w in t.marks}
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"))
                marked = np.array([not marks.isdisjoint(template_words(w)) for w in words.vocab], bool)
                hits = np.concatenate([[0], np.cumsum(marked[words.ids] if len(words.ids) else [], dtype=np.int64)])
                busy = np.diff(hits[words.offsets])
                rows = []
                for k, (doc, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)):
                    row = (doc, None, 0.0, None, None, 0, [])
                    if busy[k]:
                        own = template_words(text)
                        there = set(own)
                        found = []
                        for t in known:
                            if len(t.marks & there) >= max(1, int(len(t.marks) - (1 - least) * len(t.words))):
                                share, first, last, n = coverage(own, t, least)
                                if n:
                                    found.append((share * len(t.words), len(t.words), t.name, share, first, last, n))
                        if found:
                            _, _, name, share, first, last, _ = max(found)
                            row = (doc, name, share, first, last, sum(f[6] for f in found), sorted(f[2] for f in found))
                    rows.append(row)
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "license", "coverage", "first_word", "last_word", "n_notices", "licenses"])

    return docs.mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long, n_notices long, licenses array<string>")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document."""
    return scan(text_view(spark.read.parquet(f"{sf_dir}/documents.parquet")))
