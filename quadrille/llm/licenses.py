"""License scans by sentences and rules.

A text is cut into sentences, which are normalised (lower case, letters and digits alone, single
blanks) and looked up among known licence sentences; one with stops inside is known by all its parts in order.  The identifiers found, in order,
are matched against ordered rules, each a sequence of identifiers: at every place
the first rule that fits wins, and its sentences are used up.  Between two sentences of a
rule at most ``gap`` other sentences may stand.  A sentence may be wrapped over lines,
and may follow lines that end without a stop.

Null and empty texts hold no licence.  Rows are independent and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "mit-name": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-ref": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "This software is released under the MIT License", "SPDX-License-Identifier: MIT"],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "apache-ref": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "This project is licensed under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache-notice": ['Licensed under the Apache License, Version 2.0 (the "License")', "you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-basis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU GPL v3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl2-ref": ["Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl3-notice": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    ],
    "gpl2-notice": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program"],
    "bsd-head": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-ref": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-ref": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0-ref": ["Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "reserved": ["All rights reserved"],
    "lgpl3-ref": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "lgpl21-ref": ["Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl3-ref": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "lgpl3-notice": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    ],
    "lgpl21-notice": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ],
    "agpl3-notice": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "gpl-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl-copying": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "gpl3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "gpl2-preamble": ["The licenses for most software are designed to take away your freedom to share and change it"],
    "apache-title": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004"],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache-definition": ['"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document'],
    "apache-patent": ["Grant of Patent License", "Grant of Copyright License"],
    "bsd-advertise": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd2-ref": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "mpl-ref": ["Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "epl-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "epl-ref": ["Licensed under the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib-origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software"],
    "zlib-ref": ["Licensed under the zlib License", "SPDX-License-Identifier: Zlib"],
    "bsl-head": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsl-ref": ["Distributed under the Boost Software License, Version 1.0", "Licensed under the Boost Software License 1.0", "SPDX-License-Identifier: BSL-1.0"],
    "isc-ref": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "unlicense-ref": ["SPDX-License-Identifier: Unlicense"],
    "cc0-notice": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "cc-by-spdx": ["SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-spdx": ["SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc-spdx": ["SPDX-License-Identifier: CC-BY-NC-4.0"],
}
# Rules in order, as (licence, kind, identifiers of its sentences).
RULES = [
    ("GPL-3.0", "text", ["gpl-title", "gpl-copying", "gpl3-preamble"]),
    ("GPL-3.0", "text", ["gpl-copying", "gpl3-preamble"]),
    ("GPL-2.0", "text", ["gpl2-title", "gpl-copying", "gpl2-preamble"]),
    ("GPL-2.0", "text", ["gpl-copying", "gpl2-preamble"]),
    ("Apache-2.0", "text", ["apache-title", "apache-terms", "apache-definition"]),
    ("Apache-2.0", "text", ["apache-terms", "apache-definition"]),
    ("AGPL-3.0-or-later", "notice", ["agpl3-notice"]),
    ("LGPL-3.0-or-later", "notice", ["lgpl3-notice"]),
    ("LGPL-2.1-or-later", "notice", ["lgpl21-notice"]),
    ("MPL-2.0", "notice", ["mpl-notice", "mpl-copy"]),
    ("MPL-2.0", "notice", ["mpl-notice"]),
    ("EPL-2.0", "notice", ["epl-notice"]),
    ("Zlib", "text", ["zlib-warranty", "zlib-grant", "zlib-origin"]),
    ("Zlib", "text", ["zlib-grant", "zlib-origin"]),
    ("BSL-1.0", "text", ["bsl-head"]),
    ("BSD-4-Clause", "text", ["bsd-head", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse"]),
    ("BSD-4-Clause", "text", ["bsd-head", "bsd-source", "bsd-binary", "bsd-advertise"]),
    ("MIT", "text", ["mit-name", "mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", "text", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", "text", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", "notice", ["apache-notice", "apache-notice", "apache-copy", "apache-basis"]),
    ("Apache-2.0", "notice", ["apache-notice", "apache-copy", "apache-basis"]),
    ("Apache-2.0", "notice", ["apache-ref", "apache-copy", "apache-basis"]),
    ("GPL-3.0-or-later", "notice", ["gpl3-notice", "gpl-warranty", "gpl-received"]),
    ("GPL-3.0-or-later", "notice", ["gpl3-notice"]),
    ("GPL-2.0-or-later", "notice", ["gpl2-notice", "gpl-warranty", "gpl-received"]),
    ("GPL-2.0-or-later", "notice", ["gpl2-notice"]),
    ("BSD-3-Clause", "text", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "text", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("ISC", "text", ["isc-grant"]),
    ("Unlicense", "text", ["unlicense"]),
    ("MIT", "reference", ["mit-ref"]),
    ("Apache-2.0", "reference", ["apache-notice"]),
    ("Apache-2.0", "reference", ["apache-ref"]),
    ("GPL-3.0", "reference", ["gpl3-ref"]),
    ("GPL-2.0", "reference", ["gpl2-ref"]),
    ("BSD-3-Clause", "reference", ["bsd-ref"]),
    ("CC-BY-NC-4.0", "reference", ["cc-by-nc-ref"]),
    ("CC-BY-SA-4.0", "reference", ["cc-by-sa-ref"]),
    ("CC-BY-4.0", "reference", ["cc-by-ref"]),
    ("CC0-1.0", "reference", ["cc0-ref"]),
    ("CC0-1.0", "notice", ["cc0-notice"]),
    ("CC-BY-4.0", "reference", ["cc-by-spdx"]),
    ("CC-BY-SA-4.0", "reference", ["cc-by-sa-spdx"]),
    ("CC-BY-NC-4.0", "reference", ["cc-by-nc-spdx"]),
    ("LGPL-3.0", "reference", ["lgpl3-ref"]),
    ("LGPL-2.1", "reference", ["lgpl21-ref"]),
    ("AGPL-3.0", "reference", ["agpl3-ref"]),
    ("MPL-2.0", "reference", ["mpl-ref"]),
    ("EPL-2.0", "reference", ["epl-ref"]),
    ("Zlib", "reference", ["zlib-ref"]),
    ("BSL-1.0", "reference", ["bsl-ref"]),
    ("BSD-2-Clause", "reference", ["bsd2-ref"]),
    ("ISC", "reference", ["isc-ref"]),
    ("Unlicense", "reference", ["unlicense-ref"]),
    ("GPL-3.0", "reference", ["gpl-title"]),
    ("GPL-2.0", "reference", ["gpl2-title"]),
    ("Apache-2.0", "reference", ["apache-title"]),
    ("MIT", "reference", ["mit-name"]),
    ("LicenseRef-all-rights-reserved", "reference", ["reserved"]),
]
# Every known sentence holds one of these; texts without them are not looked into.
ANCHORS = ["licen", "rights reserved", "permi", "warrant", "redistribut", "free software", "copyright", "public domain", "terms and conditions", "of the mpl", "misrepresented", "advertising materials"]

# The colon of an SPDX tag is no stop: the identifier after it is what counts.
STOP = re.compile(r"(?<!SPDX-License-Identifier)[.;:]+[^\w\s]*(?=\s|$)|\n[^\S\n]*\n", re.IGNORECASE)
OTHER = re.compile(r"[\W_]+")


def normal(sentence: str) -> str:
    return OTHER.sub(" ", sentence.lower()).strip()


def sentence_pieces(text: str) -> Iterator[str]:
    """What the splitter makes of a known sentence or a text: stops inside known sentences cut them as well."""
    at = 0
    for m in STOP.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


class Rules:
    """Known sentences and ordered rules, ready to match."""

    def __init__(self, sentences: dict[str, list[str]], rules: list[tuple[str, str, list[str]]], gap: int):
        self.ids: dict[str, str] = {}
        #: by first part: ``(all parts, identifier)`` of sentences that have stops inside
        self.parted: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        claimed: dict[tuple[str, ...], str] = {}
        for name, forms in sentences.items():
            for form in forms:
                parts = tuple(x for x in map(normal, sentence_pieces(form)) if x)
                if claimed.setdefault(parts, name) != name:
                    raise ValueError(f"{name} and {claimed[parts]} both claim the sentence {form!r}")
                if len(parts) == 1:
                    self.ids[parts[0]] = name
                elif (parts, name) not in self.parted.setdefault(parts[0], []):
                    self.parted[parts[0]].append((parts, name))
        self.longest = max(len(s) for parts in claimed for s in parts)
        self.rules, self.gap = rules, gap
        self.by_first: dict[str, list[int]] = {}
        for k, (_, _, seq) in enumerate(rules):
            self.by_first.setdefault(seq[0], []).append(k)

    def recognised(self, text: str) -> list[tuple[str, int]]:
        """``(identifier, number of its sentence)`` of the known sentences of a text, in order."""
        low, out = text.lower(), []
        if not any(a in low for a in ANCHORS):
            return out
        pieces = [[x for x in (normal(line) for line in sentence.split("\n")) if x] for sentence in sentence_pieces(text)]
        number = at = 0
        while number < len(pieces):
            lines = pieces[number]
            if at >= len(lines):
                number, at = number + 1, 0
                continue
            joined, end = "", at
            name, upto, last = None, at + 1, number
            while end < len(lines) and len(joined) <= self.longest:
                joined = f"{joined} {lines[end]}".strip()
                end += 1
                if joined in self.ids:
                    name, upto = self.ids[joined], end
            if end == len(lines):
                for parts, known in self.parted.get(joined, ()):
                    stop = self._rest(pieces, number + 1, parts[1:])
                    if stop and (stop > (last, upto) or not name):
                        name, (last, upto) = known, stop
            if name:
                out.append((name, last))
            number, at = last, upto
        return out

    def _rest(self, pieces: list[list[str]], number: int, parts: tuple[str, ...]) -> tuple[int, int] | None:
        """Where the parts after the first end, as piece and line, if they follow from piece ``number`` on; all but the last fill their pieces."""
        for k, part in enumerate(parts):
            while number < len(pieces) and not pieces[number]:
                number += 1
            if number == len(pieces):
                return None
            joined, end = "", 0
            while end < len(pieces[number]) and len(joined) < len(part):
                joined = f"{joined} {pieces[number][end]}".strip()
                end += 1
            if joined != part or (k < len(parts) - 1 and end < len(pieces[number])):
                return None
            number += 1
        return number - 1, end

    def matched(self, found: list[tuple[str, int]]) -> list[int]:
        """The rules that fit, in order of their first sentences."""
        used, out = [False] * len(found), []
        for at, (name, _) in enumerate(found):
            if used[at]:
                continue
            for k in self.by_first.get(name, ()):
                places, number, nxt = [at], found[at][1], at + 1
                for want in self.rules[k][2][1:]:
                    # known sentences count as other sentences too, so a place is left after ``gap`` of them
                    last = min(len(found), nxt + self.gap + 1)
                    while nxt < last and (used[nxt] or found[nxt][0] != want) and found[nxt][1] - number <= self.gap + 1:
                        nxt += 1
                    if nxt >= last or found[nxt][0] != want or found[nxt][1] - number > self.gap + 1:
                        break
                    places.append(nxt)
                    number, nxt = found[nxt][1], nxt + 1
                else:
                    for p in places:
                        used[p] = True
                    out.append(k)
                    break
        return out


@lru_cache(maxsize=4)
def rules(gap: int) -> Rules:
    return Rules(SENTENCES, RULES, gap)


def scanned(docs: DataFrame, gap: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_sentences, sentences, licenses, kinds)`` of every row.

    ``sentences`` are the identifiers found, in order; ``licenses`` and ``kinds`` belong to the
    rules that fit, in order, with repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rules(gap)
        listed = pa.list_(pa.string())
        for b in batches:
            found = [known.recognised(x) if x else [] for x in b.column(1).to_pylist()]
            fits = [known.matched(x) if x else [] for x in found]
            yield pa.record_batch(
                [b.column(0), pa.array(map(len, found), pa.int64()), pa.array([[n for n, _ in x] for x in found], listed), pa.array([[known.rules[k][0] for k in x] for x in fits], listed), pa.array([[known.rules[k][1] for k in x] for x in fits], listed)],
                ["id", "n_sentences", "sentences", "licenses", "kinds"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_sentences long, sentences array<string>, licenses array<string>, kinds array<string>")
    return out.withColumnRenamed("id", id_col)
