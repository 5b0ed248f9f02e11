"""License scans by conditional compression.

Candidate blocks, cut around words that license texts use, are compressed once with a neutral dictionary and once with
each template as a raw zstandard dictionary. A template that shortens a block much is a candidate; the winner is confirmed by the exact
differences in wording between the template and the best-fitting span of the block.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vibrata.llm.common import binaries, carried

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
)
_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
# Notices as they are written into works, by SPDX identifier. "{}" stands for any few words.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-only": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.0-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-or-later": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-only": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0-only": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSD-1-Clause": _BSD,
    "BSD-2-Clause": f"{_BSD} {_BINARY}",
    "BSD-3-Clause": (
        f"{_BSD} {_BINARY} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
RATIO = 0.2  # bytes that a template must save in a block's compressed size, as a share of its own compressed size
LEVEL = -1  # negative levels leave literals as they are, so that sizes only tell of matches
#: A raw dictionary that no text shares anything with: blocks compressed with it pay what any dictionary costs.
NEUTRAL = bytes(range(1, 9)) + bytes(range(14, 32)) + bytes(range(128, 160))
DIFFERENCE = 0.1  # largest share of a template's words that may differ
RUN = 3  # words; with so few differences, any template of so many words shares a longer run than this with its notice
SHORT = 24  # words of the templates that are ranked in short windows

#: Words that tell kin licenses apart: versions must agree, and the names of families be neither missing nor put in.
VERSION, FAMILY = re.compile(rb"v?\d{1,2}(\.\d+)*"), {b"lesser", b"affero"}
#: A template that another goes on from, and a word of what follows: close behind the span, the notice is another.
GOES_ON = {"BSD-1-Clause": b"redistributions", "BSD-2-Clause": b"neither"}
SPDX = re.compile(rb"SPDX-License-Identifier:[ \t]*([\w.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[\w.+-]+)*)")

_WORD = re.compile(rb"\w[\w./+-]*\w|\w")
COMMON = ("license", "licence", "permission", "redistribut", "public domain", "free software", "copyright")  # anchors that need no template


def words(text: bytes) -> list[tuple[bytes, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def anchors(templates: dict[str, str]) -> list[str]:
    """Parts of words of which every text with a notice holds one, in lower case.

    Besides those of COMMON, each template's longest words, as many as it takes for more words to hold an anchor than may
    differ: whichever words of a notice are changed, one anchor is left.
    """
    found = list(COMMON)
    for text in templates.values():
        own = [w.decode() for w, _, _ in words(text.encode())]
        while sum(any(a in w for a in found) for w in own) <= int(DIFFERENCE * len(own)):
            left = [w for w in own if w.isalpha() and not any(a in w for a in found)]
            if not left:  # a template of few words, all of which are anchors
                break
            found.append(max(left, key=lambda w: (len(w), w)))
    return found


def anchor_pattern(templates: dict[str, str]) -> str:
    return "(?i)" + "|".join(re.escape(a) if a.isalpha() else a for a in anchors(templates))


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.words = {k: [w for w, _, _ in words(t.encode())] for k, t in templates.items()}
        self.anchor = re.compile(anchor_pattern(templates).encode())
        #: Bytes of a block before its first anchor and after its last, more than any notice has; blocks that meet are one.
        self.reach = max((len(t.encode()) for t in templates.values()), default=0) * 5 // 4 + 64
        self.runs: dict[str, dict[tuple[bytes, ...], list[int]]] = {k: {} for k in templates}
        for k, want in self.words.items():
            for i in range(len(want) - RUN + 1):
                self.runs[k].setdefault(tuple(want[i : i + RUN]), []).append(i)
        longest = max((len(w) for w in self.words.values()), default=SHORT)
        self.sizes = [(size, names) for size, names in ((SHORT, [k for k, w in self.words.items() if len(w) <= SHORT]), (longest, [k for k, w in self.words.items() if len(w) > SHORT])) if names]
        self.neutral = self._compressor(NEUTRAL)
        frame = len(self.neutral.compress(b""))
        self.cost = {k: len(self.neutral.compress(self._joined(t.encode()))) - frame for k, t in templates.items()}
        self.with_template = {k: self._compressor(self._joined(t.encode())) for k, t in templates.items()}

    def blocks(self, text: bytes) -> list[tuple[int, int]]:
        """Spans around anchors; a notice lies in one whole block."""
        found: list[list[int]] = []
        for m in self.anchor.finditer(text):
            lo, hi = max(m.start() - self.reach, 0), min(m.end() + self.reach, len(text))
            if found and lo <= found[-1][1]:
                found[-1][1] = hi
            else:
                found.append([lo, hi])
        return [(a, b) for a, b in found]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, dict_data=dictionary)

    @staticmethod
    def _joined(text: bytes) -> bytes:
        return b" ".join(w for w, _, _ in words(text))

    def reductions(self, block: bytes, names: list[str]) -> dict[str, float]:
        """Bytes of a block's compressed size that each template saves, as a share of the template's compressed size."""
        data = self._joined(block)
        alone = len(self.neutral.compress(data))
        return {k: (alone - len(self.with_template[k].compress(data))) / self.cost[k] for k in names}

    def places(self, name: str, block: list[tuple[bytes, int, int]]) -> list[tuple[int, int]]:
        """Parts of a block that the template may lie in: around runs of RUN words that both share, wherever in the template."""
        want, slack = self.words[name], int(DIFFERENCE * len(self.words[name]))
        starts = sorted({at - i for at in range(len(block)) for i in self.runs[name].get(tuple(w for w, _, _ in block[at : at + RUN]), ())} if len(want) >= RUN else {at for at, (w, _, _) in enumerate(block) if w == want[0]})
        groups: list[list[int]] = []
        for at in starts:
            if groups and at - groups[-1][-1] <= slack:
                groups[-1].append(at)
            else:
                groups.append([at])
        return [(max(g[0] - slack, 0), min(g[-1] + len(want) + slack, len(block))) for g in groups]

    def confirmed(self, name: str, block: list[tuple[bytes, int, int]], lo: int, hi: int) -> tuple[int, int, int, list[str]] | None:
        """First and last word of the template's best-fitting span in block[lo:hi], and the differences in wording.

        The span has the fewest words replaced, left out or put in (edit distance with free ends).
        """
        want, have = self.words[name], [w for w, _, _ in block[lo:hi]]
        rows = [[0] * (len(have) + 1)]
        for i, w in enumerate(want):
            above, row = rows[-1], [i + 1]
            for j, h in enumerate(have):
                row.append(above[j] if w == h else 1 + min(above[j], above[j + 1], row[j]))
            rows.append(row)
        cost = min(rows[-1])
        if cost > DIFFERENCE * len(want):
            return None
        i, j, same = len(want), rows[-1].index(cost), []
        while i and j:
            if want[i - 1] == have[j - 1] and rows[i][j] == rows[i - 1][j - 1]:
                i, j = i - 1, j - 1
                same.append((i, j))
            elif rows[i][j] == rows[i - 1][j - 1] + 1:
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j] + 1:
                i -= 1
            else:
                j -= 1
        same.reverse()
        agree, met = {i for i, _ in same}, {j for _, j in same}
        family = lambda ws, k: ws[k] in FAMILY or ws[k] == b"library" and k > 0 and ws[k - 1] == b"gnu"
        if any(i not in agree and (VERSION.fullmatch(w) or family(want, i)) for i, w in enumerate(want)):
            return None
        if any(j not in met and family(have, j) for j in range(same[0][1], same[-1][1])):
            return None
        end = lo + same[-1][1] + 1
        if GOES_ON.get(name) in [w for w, _, _ in block[end : end + 6]]:
            return None
        changes, i, j = [], 0, same[0][1]
        for to_i, to_j in [*same, (len(want), same[-1][1] + 1)]:
            if i < to_i or j < to_j:
                changes.append(f"{b' '.join(want[i:to_i]).decode(errors='replace')} -> {b' '.join(have[j:to_j]).decode(errors='replace')}")
            i, j = to_i + 1, to_j + 1
        return lo + same[0][1], lo + same[-1][1] + 1, cost, changes

    def scan(self, text: bytes) -> list[tuple[str, int, int, float, int, int, list[str]]]:
        """Notices: template, start, end (bytes), reduction, its words, words that differ, differences.

        Of templates that fit at overlapping places, the one with most words that agree over those that differ wins, so
        that a notice is not named by a shorter one in it; then the greater reduction, then the name. An SPDX tag is a
        notice by itself: its expression is the license.
        """
        tags = [(m[1].decode(errors="replace"), m.start(), m.end(1), 1.0, len(words(m[0])), 0, []) for m in SPDX.finditer(text)]
        out = []
        for lo, hi in self.blocks(text):
            block = text[lo:hi]
            spans = words(block)
            # Windows are twice as long as the longest template ranked in them and overlap by half, so each holds any such
            # notice whole; short templates have short windows, in which a block of many notices doesn't hide them.
            chosen: dict[tuple[int, int, str], tuple] = {}
            for step, names in self.sizes:
                for s in range(0, max(len(spans) - step, 1), step):
                    part = spans[s : s + 2 * step]
                    if not part or not self.anchor.search(block[part[0][1] : part[-1][2]]):
                        continue
                    gains = self.reductions(block[part[0][1] : part[-1][2]], names)
                    for gain, name in sorted((-g, k) for k, g in gains.items() if g >= RATIO):
                        for first, last in self.places(name, part):
                            hit = self.confirmed(name, spans, s + first, s + last)
                            if hit:
                                key = (hit[0], hit[1], name)
                                if key not in chosen or -gain > chosen[key][3]:
                                    chosen[key] = (name, lo + spans[hit[0]][1], lo + spans[hit[1] - 1][2], -gain, len(self.words[name]), hit[2], hit[3])
            taken: list[tuple] = []
            for c in sorted(chosen.values(), key=lambda c: (2 * c[5] - c[4], -c[3], c[0], c[1])):
                if all(c[2] <= t[1] or c[1] >= t[2] for t in taken):
                    taken.append(c)
            out += sorted(taken, key=lambda c: c[1])
        return sorted([*out, *tags], key=lambda c: c[1])


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice found: id, license, start and end in the text's UTF-8 bytes, reduction, n_words, n_changed, changes.

    A template fits when it saves a window RATIO of its own compressed size and at most DIFFERENCE of its words differ (case
    and punctuation do not count). Null, empty and clean texts give no row; repeated rows give their rows each; an empty
    table gives an empty result; other columns are ignored. Only texts with an anchor word reach Python; long texts are
    cut into blocks around anchors, which are small unless anchors fill the text.
    """
    names = ["license", "start", "end", "reduction", "n_words", "n_changed", "changes"]

    def run(batches):
        scanner = Scanner(templates)
        for b in batches:
            where, rows = [], []
            for i, text in enumerate(binaries(b, "__text")):
                for row in scanner.scan(text):
                    where.append(i)
                    rows.append(row)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([carried(b, ["__id"])[0].take(pa.array(where, pa.int64())), *columns], [id_col, *names])

    kind = documents.schema[id_col].dataType.simpleString()
    source = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where(F.col("__text").rlike(anchor_pattern(templates)))
    return source.mapInArrow(run, f"`{id_col}` {kind}, license string, start bigint, end bigint, reduction double, n_words int, n_changed int, changes array<string>")


def license_scan(documents: DataFrame) -> DataFrame:
    """The production query."""
    return scan(documents)
