"""Licence scan by sentence rules.

A text is cut into sentences, once with every line break as an end and once with line
breaks as spaces (blank lines still end one), since a licence may stand on a line of its own or run over many. Each
sentence is normalised; those that are known licence sentences become identifiers with
their place. Some known sentences have slots for a holder, a project or a work. The identifiers of a text, in order, are matched against ordered rules: a
rule holds if its identifiers follow each other with at most ``gap`` known sentences
between two of them. Longer rules come first, and a sentence serves one rule only, so the
text of a licence is not reported again by the shorter notices it contains.

Null and empty texts, and texts without a known sentence, give a row with empty lists.
Repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from navpulse.llm.common import byte_slices, map_batches, texts

# Known licence sentences by identifier, as published in the licences themselves.
SENTENCES = {
    "mit-name": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-project": "This project is licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache-name": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-nd": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "reserved": "All rights reserved",
    "lgpl21-free": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21-version": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-details": "See the GNU Lesser General Public License for more details",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-details": "See the GNU Affero General Public License for more details",
    "epl1-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "epl2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "lgpl21-licensed": "Licensed under the GNU Lesser General Public License, version 2.1",
    "lgpl3-licensed": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl3-licensed": "Licensed under the GNU Affero General Public License, version 3",
    "epl2-licensed": "Licensed under the Eclipse Public License 2.0",
    "zlib-licensed": "Licensed under the zlib License",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib-notice": "This notice may not be removed or altered from any source distribution",
}
# Words of known sentences that differ from text to text, {} standing for 1 to 12 words.
SLOTS = {
    "bsd-endorse": (
        "Neither the name of {} nor the names of {} may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of {} nor the names of {} may be used to endorse or promote products derived from this software without specific written permission",
        "Neither the names of {} nor the names of {} may be used to endorse or promote products derived from this software without specific prior written permission",
        "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission",
        "The names of {} may not be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "epl1-header": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution {}",),
    "epl2-header": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which {}",),
    "mit-project": ("{} is licensed under the MIT License",),
    "mit-name": ("{} is released under the MIT License",),
    "apache-name": ("{} is licensed under the Apache License, Version 2.0", "{} is released under the Apache License, Version 2.0"),
    "gpl3-name": ("{} is licensed under the GNU General Public License, version 3",),
    "lgpl21-licensed": ("{} is licensed under the GNU Lesser General Public License, version 2.1",),
    "lgpl3-licensed": ("{} is licensed under the GNU Lesser General Public License, version 3",),
    "agpl3-licensed": ("{} is licensed under the GNU Affero General Public License, version 3",),
    "epl2-licensed": ("{} is licensed under the Eclipse Public License 2.0",),
    "zlib-licensed": ("{} is licensed under the zlib License",),
    "gpl-free": ("{} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl2-free": ("{} is free software",),
    "gpl-hope": ("{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",),
    "lgpl3-free": ("{} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "agpl3-free": ("{} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "cc0": ("To the extent possible under law, {} has waived all copyright and related or neighboring rights to {}",),
}
# Rules, each a licence and the sentences that make it up, in their order.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy", "apache-limits")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl2-terms", "gpl2-version", "gpl-hope", "gpl-implied", "gpl-details")),
    ("LGPL-2.1-or-later", ("gpl2-free", "lgpl21-free", "lgpl21-version", "gpl-hope", "gpl-implied", "lgpl-details")),
    ("LGPL-2.1-or-later", ("gpl2-free", "lgpl21-free", "lgpl21-version")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope", "gpl-implied", "lgpl-details")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "gpl-implied", "agpl-details")),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-header",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-project",)),
    ("MIT", ("mit-title",)),
    ("Apache-2.0", ("apache-name",)),
    ("Apache-2.0", ("apache-header",)),
    ("GPL-3.0-only", ("gpl3-name",)),
    ("GPL-3.0-only", ("gpl3-licensed",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("LGPL-2.1-only", ("lgpl21-licensed",)),
    ("LGPL-3.0-only", ("lgpl3-licensed",)),
    ("AGPL-3.0-only", ("agpl3-licensed",)),
    ("EPL-1.0", ("epl1-header",)),
    ("EPL-2.0", ("epl2-header",)),
    ("EPL-2.0", ("epl2-licensed",)),
    ("Zlib", ("zlib-licensed",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
)
#: Every known sentence holds one of these.
HINT = re.compile(
    r"licen[sc]|permi|warrant|redistribut|copyright|free\s+software|public\s+domain|rights\s+reserved|merchantab|version\s+2"
    r"|misrepresent|source\s+distribution", re.I
)
LINE = re.compile(r"[^\n\r.!?;]+(?:[.!?;]+(?!\s|$)[^\n\r.!?;]*)*")
RUNNING = re.compile(r"[^.!?;]+(?:[.!?;]+(?!\s|$)[^.!?;]*)*")
#: As RUNNING, but a company's short form within a sentence does not end it.
SHORT = re.compile(r"\b(?:Inc|Ltd|Corp|Co)\.\s+[a-z]")
NAMING = re.compile(
    r"[^.!?;]+(?:(?:[.!?;]+(?!\s|$)|(?:(?<=\bInc)|(?<=\bLtd)|(?<=\bCorp)|(?<=\bCo))\.(?=\s+[a-z]))[^.!?;]*)*"
)
BLANK = re.compile(r"\n[ \t\r]*\n")
SPDX = re.compile(r"\bspdx license identifier ([a-z0-9][a-z0-9 +-]*)$")


def normalised(sentence: str) -> str:
    """Lower case words and numbers with single spaces; scheme, marks and list numbers dropped."""
    low = sentence.lower().replace("licence", "license")
    low = re.sub(r"https?://", "", low)
    low = re.sub(r"^[\s*#/\-\d().•]*(?=[a-z])", "", low)
    return " ".join(re.findall(r"[^\W_]+", low))


KNOWN = {normalised(s): name for name, s in SENTENCES.items()}
#: A name is no denial or condition.
SLOT = r"(?:(?!(?:not?|nor|none|nothing|neither|never|unless|if|whether)\b)\w+)"
SLOT = rf"{SLOT}(?: {SLOT}){{0,11}}"
SLOTTED = [
    (re.compile(" ".join(SLOT if part == "{}" else normalised(part) for part in re.split(r"(\{\})", form) if part.strip())), name)
    for name, forms in SLOTS.items() for form in forms
]


def identified(words: str) -> str | None:
    """Identifier of a normalised sentence."""
    name = KNOWN.get(words)
    if name is None:
        name = next((name for form, name in SLOTTED if form.fullmatch(words)), None)
    if name is None and (own := SPDX.search(words)):
        name = "spdx:" + own[1].replace(" ", "-")
    return name


def known_sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences, in order; of overlapping ones the longest."""
    if not HINT.search(text) and "spdx" not in text.lower():
        return []
    found, open_ended = set(), set()
    breaks = [m.span() for m in BLANK.finditer(text)]
    paragraphs = list(zip([0, *[b for _, b in breaks]], [*[a for a, _ in breaks], len(text)]))
    kinds = (RUNNING, NAMING) if SHORT.search(text) else (RUNNING,)
    running = chain.from_iterable(kind.finditer(text, a, b) for kind in kinds for a, b in paragraphs)
    for cut in (LINE.finditer(text), running):
        for m in cut:
            part = m[0]
            if not HINT.search(part) and "spdx" not in part.lower():
                continue
            words = normalised(part)
            name = identified(words)
            if name is not None:
                start = m.start() + len(part) - len(part.lstrip())
                found.add((start, m.start() + len(part.rstrip()), name))
                if words not in KNOWN:
                    open_ended.add((start, m.start() + len(part.rstrip()), name))
    # A slot at the beginning takes no words of the line before.
    last = {}
    for start, stop, name in found:
        last[stop, name] = max(start, last.get((stop, name), 0))
    found -= {s for s in open_ended if s[0] < last[s[1], s[2]]}
    chosen: list[tuple[int, int, str]] = []  # in order, none overlaps another
    for start, end, name in sorted(found, key=lambda s: (s[0] - s[1], s)):
        at = bisect_left(chosen, (start, end, name))
        if (at == 0 or chosen[at - 1][1] <= start) and (at == len(chosen) or chosen[at][0] >= end):
            chosen.insert(at, (start, end, name))
    return chosen


def matched(sentences: list[tuple[int, int, str]], gap: int) -> list[tuple[str, int, int, int]]:
    """(licence, start, end, sentences) of the rules that hold, by place.

    Each rule goes once over the sentences that no longer rule has taken; they are a linked
    list, so taking one costs nothing for the others.
    """
    names, end, out = [name for *_, name in sentences], len(sentences), []
    after, before = [*range(1, end + 1), 0], [*range(-1, end)]  # place -1, the last of the list, is before the first
    known = set(names)
    for licence, rule in sorted(RULES, key=lambda r: -len(r[1])):
        if not known.issuperset(rule):
            continue
        at = after[-1]
        while at != end:
            taken = follow(names, after, at, rule, gap)
            if taken is None:
                at = after[at]
                continue
            left = before[at]
            for i in taken:
                after[before[i]], before[after[i]] = after[i], before[i]
            out.append((licence, sentences[taken[0]][0], sentences[taken[-1]][1], len(taken)))
            at = after[left]
    at = after[-1]
    while at != end:
        start, stop, name = sentences[at]
        if name.startswith("spdx:"):
            out.append((name, start, stop, 1))
        at = after[at]
    return sorted(out, key=lambda r: (r[1], r[2], r[0]))


def follow(names: list[str], after: list[int], at: int, rule: tuple[str, ...], gap: int) -> list[int] | None:
    """Places of the rule's sentences from ``at`` on, or None."""
    if names[at] != rule[0]:
        return None
    taken, end = [at], len(names)
    for want in rule[1:]:
        place = after[taken[-1]]
        for _ in range(gap):
            if place == end or names[place] == want:
                break
            place = after[place]
        if place == end or names[place] != want:
            return None
        taken.append(place)
    return taken


def licenses(docs: DataFrame, gap: int = 2, slice_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, the licences found (name, start, end, sentences) and the identifiers of all known sentences."""
    rule = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.int64())])

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, rules, names = batch.column("text"), [], []
        for a, b in byte_slices(column, slice_bytes):
            for text in column.slice(a, b - a).to_pylist():
                sentences = known_sentences(text)
                names.append([s[2] for s in sentences])
                rules.append(
                    [{"license": x, "start": s, "end": e, "sentences": n} for x, s, e, n in matched(sentences, gap)]
                )
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rules, pa.list_(rule)), pa.array(names, pa.list_(pa.string()))],
            ["doc_id", "licenses", "sentences"],
        )

    shape = "array<struct<license:string,start:bigint,end:bigint,sentences:bigint>>"
    return map_batches(texts(docs), scan, f"doc_id long, licenses {shape}, sentences array<string>")
