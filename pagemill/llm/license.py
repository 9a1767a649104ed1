"""License scans by conditional compression.

Runs of words that a text shares with a template, on one diagonal, place the stretches that may be its notice, across
line breaks and wherever in the text. A stretch is compressed alone and with the template as a zstandard raw
dictionary; what saves nothing is left out. It is confirmed by the exact differences of wording between the stretch
and the template. Of hits that overlap the one with most words of its template stays, and all others are kept, so a
text may hold any number of notices. Rows are independent, so nothing is shuffled and memory is bounded by one text.
"""

from __future__ import annotations

import functools
import pkgutil
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Usual license notices; whole texts are in the folder licenses, SPDX tags in SPDX.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0."],
}
TEMPLATES |= {
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "ISC": ["Released under the ISC License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_GNU = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
SPDX = {f"{x}{end}": x for x in _GNU for end in ("", "-only", "-or-later")} | {x: x for x in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")}
for _tag, _name in SPDX.items():
    if (_notice := f"SPDX-License-Identifier: {_tag}") not in TEMPLATES[_name]:
        TEMPLATES[_name].append(_notice)
for _name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0"):
    _whole = pkgutil.get_data("pagemill.llm", f"licenses/{_name}.txt").decode()
    TEMPLATES[_name].append(_whole)
    if _name.startswith("BSD"):  # clauses are also listed by dots or without marks
        TEMPLATES[_name].append(re.sub(r"(?m)^\d\. ", "", _whole))
TRIGGER = r"(?i)licen[cs]e|copyright|spdx|creative commons|permission is hereby|redistribut|free software|public domain|\bCC0|\bCC[ -]BY"
MOST_CHANGED = 0.15  # share of a notice's words that may differ
GRAM = 3
_WORD = re.compile(r"\w+(?:[.\-/]\w+)*")
_NAMES = re.compile(r".*\d.*|mit|apache|gnu|general|lesser|library|public|a?l?gpl|bsd|mozilla|mpl|isc|unlicense|by|sa|nc|nd|cc|affero|clause|attribution\w*|sharealike|noncommercial|noderivatives", re.I)


@functools.cache
def _compressors():
    alone = zstandard.ZstdCompressor(level=3)
    with_dict = [(name, notice, zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(notice.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))) for name, notices in TEMPLATES.items() for notice in notices]
    return alone, with_dict


@functools.cache
def _grams() -> tuple[list[int], dict[tuple, list[tuple[int, int]]]]:
    """Words of each template; the places (template, position) of each run of three words, or of two or one in shorter ones."""
    sizes, at = [], defaultdict(list)
    for k, (_, notice, _) in enumerate(_compressors()[1]):
        w = [x.lower() for x in _WORD.findall(notice)]
        sizes.append(len(w))
        g = min(GRAM, len(w))
        for i in range(len(w) - g + 1):
            at[tuple(w[i : i + g])].append((k, i))
    return sizes, dict(at)


def stretches(words: list[str]) -> Iterator[tuple[int, int, int]]:
    """(template, first, last) of all stretches of words that may be a template with no more than MOST_CHANGED of its
    words changed: so many of its runs of words must be there, at nearly one distance."""
    sizes, grams = _grams()
    votes = defaultdict(list)
    for g in range(1, GRAM + 1):
        for i in range(len(words) - g + 1):
            for k, at in grams.get(tuple(words[i : i + g]), ()):
                votes[k].append(i - at)
    for k, offsets in votes.items():
        n, slack = sizes[k], int(MOST_CHANGED * sizes[k])
        g = min(GRAM, n)
        least = max(1, n - g + 1 - g * slack)
        offsets.sort()
        while len(offsets) >= least:
            ends = [bisect_right(offsets, x + slack) for x in offsets]
            most, i = max((e - i, -i) for i, e in enumerate(ends))
            if most < least:
                break
            lo, hi = offsets[-i], offsets[ends[-i] - 1]
            yield k, max(0, lo - slack), min(len(words), hi + n + slack)
            # what begins within this notice isn't another one
            offsets = [x for x in offsets if not lo - n // 2 <= x <= hi + n // 2]


def wording(notice: str, block: str) -> tuple[int, int, int, list[str]]:
    """(first, last, changed words, what was said) of the stretch of block nearest to the notice."""
    a, spans = [w.lower() for w in _WORD.findall(notice)], list(_WORD.finditer(block))
    b = [m[0].lower() for m in spans]
    same = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return 0, 0, len(a), a
    lo, hi = max(0, same[0].b - same[0].a), min(len(b), same[-1].b + len(a) - same[-1].a)
    ops = [o for o in SequenceMatcher(None, a, b[lo:hi], autojunk=False).get_opcodes() if o[0] != "equal"]
    changed = sum(max(i2 - i1, j2 - j1) for _, i1, i2, j1, j2 in ops)
    words = [w for _, i1, i2, j1, j2 in ops for w in [*a[i1:i2], *b[lo + j1 : lo + j2]]]
    return spans[lo].start(), spans[hi - 1].end(), changed, words


def scan_text(text: str) -> list[tuple[str, str, int, int, int, int]]:
    """(license, notice, bytes saved, first, last, changed words) of all notices in a text, in order."""
    alone, templates = _compressors()
    spans = list(_WORD.finditer(text))
    hits = []
    for k, lo, hi in stretches([m[0].lower() for m in spans]):
        name, notice, with_dict = templates[k]
        at = spans[lo].start()
        block = text[at : spans[hi - 1].end()]
        data = block.lower().encode("utf-8", "replace")
        saved = len(alone.compress(data)) - len(with_dict.compress(data))
        first, last, changed, words = wording(notice, block)
        n = len(_WORD.findall(notice))
        if saved > 0 and changed <= MOST_CHANGED * n and not any(_NAMES.fullmatch(x) for w in words for x in re.split(r"[-/]", w)):
            hits.append((2 * changed - n, changed, -saved, k, at + first, at + last))
    found = []
    for _, changed, saved, k, first, last in sorted(hits):
        if all(last <= x[3] or first >= x[4] for x in found):
            found.append((*templates[k][:2], -saved, first, last, changed))
    return sorted(found, key=lambda x: x[3:])


def scan_block(block: str) -> tuple[str, str, int, int, int, int] | None:
    """The notice in a block that saves most bytes, or None."""
    return max(scan_text(block), key=lambda x: x[2], default=None)


_HITS = "doc_id long, start long, length long, license string, notice string, bytes_saved long, changed_words int, exact boolean"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row a license notice found: doc_id, start and length (code points) of its wording in the text,
    license, notice, bytes_saved, changed_words, exact. Null and empty texts and texts without notices give no rows;
    repeated rows give theirs each."""

    def scan(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for name, notice, saved, first, last, changed in scan_text(text):
                    rows.append((doc, first, last - first, name, notice, saved, changed, changed == 0))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 8, types)], names=[x.split()[0] for x in _HITS.split(", ")])

    near = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").rlike(TRIGGER))
    return near.mapInArrow(scan, _HITS)
