"""License scan by conditional compression.

A candidate block starts from a line that speaks of licensing, its comment marks taken off, and grows over the
neighbouring lines (and single blank lines between paragraphs) that a template which saves on the first line saves on as
well: so a notice that is wrapped or commented, or a whole text of several paragraphs, is one block, and prose beside it is not.
The block is compressed once alone and once with each template as a raw zstandard dictionary. Licenses are ranked by
the part of the block's own size they save. The exact word differences between the block and the best matching stretch of the
template confirm, for every license that saves enough: most words must be equal, none that tells licenses apart (a version
number, Affero, NC) may differ, and no other license may fit as well. Of licenses with as many words equal
the one that leaves out the fewest of its own inside the stretch fits best (the text of one may be the
text of another with a clause less). A license has its notice and, in ``license_texts``, its whole text as templates.
"""

from __future__ import annotations

import difflib
import re
from pathlib import Path

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Short notices and opening paragraphs of public licenses, as published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0 "
                  "(the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
                  "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
                  "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                  "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                  "SPDX-License-Identifier: Apache-2.0",
    "MIT": "Released under the MIT License. Licensed under the MIT License. Permission is hereby granted, free of charge, "
           "to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to "
           "deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
           "merge, publish, distribute, sublicense, and/or sell copies of the Software. SPDX-License-Identifier: MIT",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or "
                    "without modification, are permitted provided that the following conditions are met: Neither the "
                    "name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission. "
                    "SPDX-License-Identifier: BSD-3-Clause",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software: you "
               "can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
               "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
               "SPDX-License-Identifier: GPL-3.0-or-later",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2. This program is free software; you "
               "can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
               "the Free Software Foundation; either version 2 of the License. SPDX-License-Identifier: GPL-2.0-only",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3. This library is free "
                "software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
               "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International "
                 "License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike "
                    "4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons "
                    "Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 "
               "1.0. No rights reserved.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3. This program is free "
                "software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version. SPDX-License-Identifier: AGPL-3.0-or-later",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1. SPDX-License-Identifier: Apache-1.1",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License. Redistribution and use in source and binary forms, with or "
                    "without modification, are permitted provided that the following conditions are met: "
                    "SPDX-License-Identifier: BSD-2-Clause",
    "GPL-1.0": "This work is licensed under the GNU General Public License, version 1. SPDX-License-Identifier: GPL-1.0-only",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1. This library is free "
                "software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                "License as published by the Free Software Foundation; either version 2.1 of the License.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0. This work is licensed under a Creative Commons "
                    "Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0. This work is licensed under a Creative Commons "
                       "Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0. This work is licensed under a Creative Commons "
                       "Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
               "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/ Eclipse Public License, version 2.0. "
               "SPDX-License-Identifier: EPL-2.0",
    "All rights reserved": "Copyright. All rights reserved. No part of this publication may be reproduced without "
                           "permission.",
}
CANDIDATE = r"(?i)licen[sc]|copyright|\(c\) ?[0-9]|©|rights reserved|permission is|redistribut|public domain|warrant|spdx|creative commons"
PIECE = 480                      # a longer line is cut into pieces that overlap by half
BLOCK = 2000                     # a longer block of several lines is cut into runs of lines that overlap by half
LEAST_SAVED = 0.3
LEAST_SAME = 0.8
LEAST_GROWN = 0.5                # a neighbouring line joins a block if a template saves so much of what it adds
GAP = 2                          # blank lines that a block may cross at a time

# How comments start and end in common languages.
_STARTS = re.compile(r"""(?:/\*+!?|\*+/?|//+[/!]?|#+!?|;+|--+|%+|<!--+|"{3}|'{3}|(?:REM|dnl)\b)\s*""")
_ENDS = re.compile(r"""\s*(?:\*+/|--+>|"{3}|'{3})\Z""")

_WORD = re.compile(r"\w+(?:[.\-]\w+)*")
# words that tell licenses apart, also as a part of "BY-NC" or "BSD-3-Clause"
_NAMES = set("affero lesser nc nd sa noncommercial noderivatives noderivs sharealike clause mit bsd isc apache mozilla mpl "
             "fdl gfdl artistic cc0 eclipse epl boost zlib unlicense bsl wtfpl ofl".split())
_GPL = re.compile(r"[al]?gplv?\d*")
_VERSION = re.compile(r"v?\d\d?\.\d+")
_NUMBER = re.compile(r"v?\d\d?")
_BEFORE = set("version v license licence gpl lgpl agpl mpl apache by sa nc nd attribution".split())


TAG = "SPDX-License-Identifier"


def notices() -> list[tuple[str, str]]:
    """Name and notice of the licenses, with all their tags."""
    def tags(name):
        names = [name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name] if " " not in name else []
        return "".join(f" {TAG}: {n}" for n in names)
    return [(k, t + tags(k)) for k, t in sorted(TEMPLATES.items())]


def whole_texts() -> list[tuple[str, str]]:
    """Name and text of the licenses that are there as a whole, on one line."""
    return [(p.name.removesuffix(".txt"), " ".join(p.read_text(encoding="utf-8").split()))
            for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def telling(words: list[str], i: int) -> bool:
    """Whether the word at ``i`` tells licenses apart: of a license's name, or a version."""
    w = words[i]
    return (any(p in _NAMES or _GPL.fullmatch(p) for p in re.split(r"[-.]", w)) or bool(_VERSION.fullmatch(w))
            or bool(_NUMBER.fullmatch(w)) and i > 0 and words[i - 1] in _BEFORE
            or w == "library" and words[i + 1:i + 2] == ["general"] or i > 0 and words[i - 1] == TAG.lower())


def pieces(line: str, size: int = PIECE) -> list[tuple[int, str]]:
    """A line whole if it is short, else in pieces that overlap by half."""
    if len(line) <= size:
        return [(0, line)]
    return [(i, line[i:i + size]) for i in range(0, len(line) - size // 2, size // 2)]


def compared(block: str, template: str) -> tuple[list[str], float, int, bool, int, bool]:
    """Of a block and a template: the differences, the share and number of equal words, whether a word that tells licenses apart
    differs, how many words of the template are left out inside the stretch, whether an equal word tells licenses apart."""
    a = [w.lower() for w in _WORD.findall(block)]
    b = [w.lower() for w in _WORD.findall(template)]
    if not a:
        return [], 0.0, 0, False, 0, False
    slack = max(8, len(a) // 4)
    if len(b) > len(a) + 2 * slack:     # only the stretch around the longest match, not words from all over a long text
        m = difflib.SequenceMatcher(None, b, a, autojunk=False).find_longest_match()
        b = b[max(0, m.a - m.b - slack):m.a - m.b + len(a) + slack]
    same = [m for m in difflib.SequenceMatcher(None, b, a, autojunk=False).get_matching_blocks() if m.size]
    equal = sum(m.size for m in same)
    if not same:
        return [], 0.0, 0, False, 0, False
    diffs, apart, left_out = [], False, 0
    for one, two in zip(same, same[1:]):
        diffs += ["-" + w for w in a[one.b + one.size:two.b]] + ["+" + w for w in b[one.a + one.size:two.a]]
        gap = range(one.a + one.size, two.a)
        left_out += len(gap)
        apart |= len(gap) <= 3 and any(telling(b, i) for i in gap)      # more are left out, not exchanged
    diffs = ["-" + w for w in a[:same[0].b]] + diffs + ["-" + w for w in a[same[-1].b + same[-1].size:]]
    kept = {i for m in same for i in range(m.b, m.b + m.size)}
    told = [i for i in range(len(a)) if telling(a, i)]
    return diffs, equal / len(a), equal, apart or any(i not in kept for i in told), left_out, any(i in kept for i in told)


def differences(block: str, template: str) -> tuple[list[str], float]:
    """Word differences of a block to the template (``-`` only in the block, ``+`` only in the
    template, inside the stretch it matches) and the share of the block's words that are equal."""
    return compared(block, template)[:2]


class _Scale:
    """Sizes of blocks alone and with each template as raw dictionary."""

    def __init__(self, entries: list[tuple[str, bool, str]]):
        self.entries = entries
        self.alone, self.given = self._packer(), [self._packer(t) for _, _, t in entries]
        self.known: dict[str, tuple[int, dict]] = {}

    @staticmethod
    def _packer(extra: str | None = None):
        d = None
        if extra is not None:
            d = zstandard.ZstdCompressionDict(extra.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=19)
        return zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False, write_dict_id=False).compress

    def saved(self, block: str) -> dict[str, tuple[float, bool, str]]:
        """By license: the part of its own size that a block saves with the better of its templates, and that template."""
        return self._sizes(block)[1]

    def _sizes(self, block: str) -> tuple[int, dict]:
        got = self.known.get(block)
        if got is None:
            raw = block.lower().encode()
            size, best = len(self.alone(raw)), {}
            for (k, whole, t), pack in zip(self.entries, self.given):
                s = (size - len(pack(raw))) / size
                if k not in best or s > best[k][0]:
                    best[k] = s, whole, t
            if len(self.known) > 20_000:
                self.known.clear()
            got = self.known[block] = size, best
        return got

    def grown(self, line: str, joined: str, names: list[str]) -> float:
        """Of what a neighbour adds to the size of ``line`` the part that one of ``names`` saves."""
        size, best = self._sizes(line)
        more, both = self._sizes(joined)
        if more <= size:
            return 1.0
        return max(both[k][0] * more - best[k][0] * size for k in names) / (more - size)


def _judged(block: str, best: dict, least_saved: float, least_same: float) -> tuple:
    """(license, saved, runner_up, same_words, diffs, confirmed) from what each license saves."""
    rank = sorted(best, key=lambda k: -best[k][0])              # first by name on ties
    name, found, fits = rank[0], None, []
    some = {k: compared(block, best[k][2]) for k in rank if best[k][0] >= least_saved}
    if some:
        # few words confirm only if they say which license it is and all stand in the template
        fits = [k for k, (_, same, equal, apart, _, tells) in some.items()
                if same >= least_same and not apart and (equal >= 3 or same == 1 and tells)]
        if fits:
            closest = min((-some[k][2], some[k][4]) for k in fits)
            fits = [k for k in fits if (-some[k][2], some[k][4]) == closest]
            # a notice counts before the same words somewhere in a whole text
            fits = [k for k in fits if not best[k][1]] or fits
            name = fits[0]
        found = some[name]
    runner = max((s for k, (s, *_) in best.items() if k != name), default=0.0)
    if found is None:
        return name, best[name][0], runner, 0.0, [], False
    confirmed = len(fits) == 1
    # the words that tell licenses apart say that it is none of those known
    named = name if confirmed or not all(c[3] for c in some.values()) else None
    return named, best[name][0], runner, found[1], found[0], confirmed


def unmarked(line: str) -> str:
    """A line without outer blanks and comment marks."""
    line = line.strip()
    start = _STARTS.match(line)
    if start:
        line = line[start.end():]
    end = _ENDS.search(line, max(0, len(line) - 16))
    return line[:end.start()].rstrip() if end else line


def _regions(lines: list[str], candidate, scale: _Scale, least_saved: float, least_grown: float) -> list[tuple[int, int]]:
    """(first, last) lines of the blocks: lines are without marks. Blocks that meet are one."""
    found: list[tuple[int, int]] = []
    for i, line in enumerate(lines):
        if len(line) > PIECE or not candidate.search(line) or (found and i <= found[-1][1]):
            continue
        best = scale.saved(line)
        names = [k for k, v in best.items() if v[0] >= least_saved]
        if not names:
            continue
        ends = []
        for way in (-1, 1):
            end, at, blank = i, i + way, 0
            while 0 <= at < len(lines) and blank <= GAP and len(lines[at]) <= PIECE:
                if lines[at]:
                    pair = (lines[end], lines[at])[::way]
                    if scale.grown(lines[end], " ".join(pair), names) < least_grown:
                        break
                    end, blank = at, 0
                else:
                    blank += 1
                at += way
            ends.append(end)
        if found and ends[0] <= found[-1][1]:
            found[-1] = found[-1][0], max(ends[1], found[-1][1])
        else:
            found.append((ends[0], ends[1]))
    return found


def _runs(lines: list[str], first: int, last: int):
    """(first line, block) of a region: whole if it is short, else runs of lines that overlap by half."""
    at = first
    while at <= last:
        end, size = at, 0
        while end <= last and (end == at or size + len(lines[end]) + 1 <= BLOCK):
            size += len(lines[end]) + 1
            end += 1
        yield at, " ".join(x for x in lines[at:end] if x)
        if end > last:
            return
        half, step = 0, at
        while step < end and half < size / 2:
            half += len(lines[step]) + 1
            step += 1
        at = max(at + 1, step)


def blocks(text: str, candidate, scale: _Scale, least_saved: float, least_grown: float) -> list[tuple[int, int, str]]:
    """(line, start, block) of the candidate blocks of a text, in order; ``start`` is not 0 in long lines only."""
    lines = [unmarked(x) for x in text.split("\n")]
    out = [(at, 0, b) for first, last in _regions(lines, candidate, scale, least_saved, least_grown) for at, b in _runs(lines, first, last)]
    out += [(i, start, piece) for i, x in enumerate(lines) if len(x) > PIECE and candidate.search(x) for start, piece in pieces(x)]
    return sorted(out, key=lambda b: b[:2])


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                 candidate: str = CANDIDATE, least_saved: float = LEAST_SAVED,
                 least_same: float = LEAST_SAME, least_grown: float = LEAST_GROWN) -> DataFrame:
    """Confirmed and unconfirmed license notices, one row per candidate block whose best template
    saves at least ``least_saved`` of its compressed size:
    ``doc_id, line, start, license, saved, runner_up, same_words, diffs, confirmed, block``.

    ``line`` (the first of the block) and ``start`` (code point in the line without its comment mark) are from 0; ties between
    templates go to the first by name; ``diffs`` are the exact word differences; a notice is confirmed when at least
    ``least_same`` of its words stand in the template in order, three or more (or fewer, if all do and they name the license), no
    word that tells licenses apart differs, and no other license has as many of its words so and leaves out as few of its
    own (notices count before whole texts). All licenses that save ``least_saved`` are compared. ``license`` is null if words that
    tell licenses apart differ from all of them. A neighbouring line joins a block if ``least_grown`` of what it adds is saved.
    ``templates`` replace the notices and whole texts. Null and empty texts give no rows; repeated rows and null ids are
    scanned like any other.
    """
    entries = [(k, False, t) for k, t in (templates.items() if templates else notices())]
    entries = sorted(entries + ([] if templates else [(k, True, t) for k, t in whole_texts()]))

    def fn(frames):
        scale, wanted, known = _Scale(entries), re.compile(candidate), {}
        for pdf in frames:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                for line, start, block in blocks(text, wanted, scale, least_saved, least_grown):
                    best = scale.saved(block)
                    if max(v[0] for v in best.values()) < least_saved:
                        continue
                    got = known.get(block)
                    if got is None:
                        if len(known) > 20_000:
                            known.clear()
                        got = known[block] = _judged(block, best, least_saved, least_same)
                    rows.append((doc_id, line, start, *got, block))
            yield pd.DataFrame(rows, columns=["doc_id", "line", "start", "license", "saved", "runner_up", "same_words",
                                              "diffs", "confirmed", "block"])
    docs = common.spread(common.texts(df, id_col, text_col)).where(F.col("text").rlike(candidate))
    return docs.mapInPandas(fn, "doc_id long, line int, start int, license string, saved double, runner_up double, "
                            "same_words double, diffs array<string>, confirmed boolean, block string")
