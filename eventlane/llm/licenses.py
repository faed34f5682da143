"""Licence scans by sentence rules.

Sentences are normalised and looked up among the sentences of known licences;
the identifiers found are matched, in order, against the rules of the licences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlane.llm.common import Shared, text_or_empty

# Sentences of public licence texts and notices. ``knowledge`` cuts
# and normalises them as it does a document; what is cut into several sentences
# stands here as published.
SENTENCES = {
    "mit.title": ("mit license", "the mit license", "the mit license mit"),
    "mit.grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit.condition": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit.warranty": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit.liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "isc.grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "bsd.grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd.source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd.binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd.endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "apache2.notice": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0"),
    "apache2.use": ("you may not use this file except in compliance with the license",),
    "apache2.copy": ("you may obtain a copy of the license at",),
    "apache2.basis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "mit.notice": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    "bsd.notice": ("released under the bsd license", "licensed under the bsd license"),
    "isc.warranty": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "gpl.free": ("this program is free software", "this library is free software"),
    "gpl.warranty": ("this program is distributed in the hope that it will be useful but without any warranty", "this library is distributed in the hope that it will be useful but without any warranty"),
    "gpl.implied": ("without even the implied warranty of merchantability or fitness for a particular purpose",),
    "unlicense.grant": ("this is free and unencumbered software released into the public domain",),
    "mpl2.notice": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "mpl2.copy": tuple(f"if a copy of the mpl was not distributed with this file you can obtain one at {http} mozilla org mpl 2 0" for http in ("http", "https")),
    "epl1.notice": ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",),
    "epl2.notice": tuple(f"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at {http} www eclipse org legal epl 2 0" for http in ("http", "https")),
    "zlib.warranty": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
    "zlib.grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "zlib.origin": ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",),
    "zlib.altered": ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software",),
    "zlib.notice": ("this notice may not be removed or altered from any source distribution",),
    "boost.notice": ("distributed under the boost software license version 1 0",),
    "boost.copy": tuple(f"see accompanying file license 1 0 txt or copy at {http} www boost org license 1 0 txt" for http in ("http", "https")),
    "boost.grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
}
# The sentence identifiers of each licence in their order; a "?"
# marks one that may be missing. Longer rules win over shorter ones.
RULES = {
    "MIT": (("mit.title?", "mit.grant", "mit.condition", "mit.warranty?", "mit.liability?"), ("mit.notice",)),
    "ISC": (("isc.grant", "mit.warranty?", "isc.warranty?"),),
    "BSD-2-Clause": (("bsd.grant", "bsd.source", "bsd.binary"),),
    "BSD-3-Clause": (("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"),),
    "BSD": (("bsd.notice",),),
    "Apache-2.0": (("apache2.notice", "apache2.use?", "apache2.copy?", "apache2.basis?"),),
    "Unlicense": (("unlicense.grant",),),
    "MPL-2.0": (("mpl2.notice", "mpl2.copy?"),),
    "EPL-1.0": (("epl1.notice",),),
    "EPL-2.0": (("epl2.notice",),),
    "Zlib": (("zlib.warranty?", "zlib.grant", "zlib.origin?", "zlib.altered?", "zlib.notice?"),),
    "BSL-1.0": (("boost.notice", "boost.copy?"), ("boost.grant",)),
}
# Names and versions from which notices are built.
_GNU = {"gnu general public license": ("GPL", ("2", "3")), "gnu lesser general public license": ("LGPL", ("2.1", "3")), "gnu affero general public license": ("AGPL", ("3",))}
# Names and versions in the grants of file headers.
_GRANTS = (
    ("GNU General Public License", "GPL", ("2", "3")), ("GNU Library General Public License", "LGPL", ("2",)),
    ("GNU Lesser General Public License", "LGPL", ("2.1", "3")), ("GNU Affero General Public License", "AGPL", ("3",)),
)
_CC = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
_CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
_LEADS = ("", "this work is ", "this file is ", "this project is ", "this program is ", "this article is ")
_VERBS = ("licensed under ", "licensed under the ", "released under ", "released under the ", "distributed under the ")

_EDGE = re.compile(r"[.!?;:]+(?=\s)|\n\s*\n|\n\s*(?=[-*•\d])")
_WORD = re.compile(r"[a-z0-9]+")
_NEITHER, _NOR = "neither the name of ", " nor the names of its contributors"
# Words that most known sentences have; ``Knowledge.triggers`` adds what its rules need besides.
TRIGGERS = ("licen", "permission", "redistribut", "software", "warrant", "spdx", "released", "distributed")


def normal(sentence: str) -> str:
    """Lower-case letters and digits with single spaces; the holder's name in a BSD clause is neutral."""
    text = " ".join(_WORD.findall(sentence.lower()))
    at = text.find(_NEITHER)
    while at >= 0 and (end := text.find(_NOR, at + len(_NEITHER) + 1)) >= 0:
        clause = f"{_NEITHER}the copyright holder{_NOR}"
        text = text[:at] + clause + text[end + len(_NOR) :]
        at = text.find(_NEITHER, at + len(clause))
    return text


@dataclass(frozen=True)
class Knowledge:
    """Normalised sentence to identifier, and the ordered rules."""

    sentences: dict[str, str]
    rules: tuple[tuple[str, tuple[str, ...]], ...]

    @cached_property
    def triggers(self) -> tuple[str, ...]:
        """Words such that a text with none of them holds no rule."""
        texts: dict[str, list[str]] = {}
        for sentence, name in self.sentences.items():
            texts.setdefault(name, []).append(sentence)
        found = list(TRIGGERS)
        for _, rule in self.rules:
            # Any needed sentence will do; if all may be missing, each counts.
            need = [item for item in rule if not item.endswith("?")]
            lacking = [[s for s in texts.get(item.rstrip("?"), ()) if not any(t in s for t in found)] for item in need or rule]
            if need and all(lacking):
                lacking = lacking[:1]
            elif need:
                continue
            # The holder's name is not in the text itself.
            found += {max(s.replace("copyright holder", "").split(), key=len) for part in lacking for s in part}
        return tuple(found)


def knowledge() -> Knowledge:
    """The fixed sentences and rules, and the notices built from names and versions."""
    known: dict[str, str] = {}

    def named(name: str, text: str) -> tuple[str, ...]:
        """The identifiers of the sentences into which a text is cut."""
        parts = [part for start, end in sentences(text) if (part := normal(text[start:end]))]
        return tuple(known.setdefault(part, name if len(parts) == 1 else f"{name}.{i}") for i, part in enumerate(parts, 1))

    cut = {}
    for name, texts in SENTENCES.items():
        ways = {named(name, text) for text in texts}
        if len(ways) != 1:
            raise ValueError(f"the texts of {name} are cut in different ways")
        cut[name] = ways.pop()

    def expanded(rule: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(part + "?" * item.endswith("?") for item in rule for part in cut[item.rstrip("?")])

    rules = [(licence, expanded(rule)) for licence, own in RULES.items() for rule in own]
    for name, short, versions in _GRANTS:
        for v in versions:
            licence = f"{short}-{v if '.' in v else v + '.0'}"
            # The headers of version 2 have a semicolon where those of version 3 have a comma; both occur with each.
            grant = f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
            later, only = f"either version {v} of the License, or (at your option) any later version.", f"version {v} of the License."
            for kind, end in (("or-later", later), ("only", only)):
                for mark in ";,":
                    own = named(f"{short}{v}.{kind}", f"{grant}{mark} {end}")
                    details = named(f"{short}.details", f"See the {name} for more details.")
                    rules.append((f"{licence}-{kind}", (*expanded(("gpl.free?",)), *own, *expanded(("gpl.warranty?", "gpl.implied?")), *(d + "?" for d in details))))

    def notice(licence: str, names: list[str]) -> None:
        rules.append((licence, (f"notice.{licence}",)))
        for name in names:
            for lead in _LEADS:
                for verb in _VERBS:
                    known.setdefault(normal(lead + verb + name), f"notice.{licence}")

    for name, (short, versions) in _GNU.items():
        for v in versions:
            licence = f"{short}-{v if '.' in v else v + '.0'}"
            notice(licence, [f"{name}, version {v}", f"{name} version {v}", f"{name} v{v}", f"{short} v{v}", f"{short} version {v}"])
    for kind in _CC:
        for v in _CC_VERSIONS:
            notice(f"CC-{kind}-{v}", [f"CC {kind} {v}", f"creative commons {kind} {v}"])
    notice("CC0-1.0", ["CC0 1.0", "CC0"])
    for licence in sorted({licence for licence, _ in rules}):
        known.setdefault(normal(f"SPDX-License-Identifier {licence}"), f"spdx.{licence}")
        rules.append((licence, (f"spdx.{licence}",)))
    return Knowledge(known, tuple(sorted(rules, key=lambda r: (-len(r[1]), r[0], r[1]))))


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence, without white space around it."""
    start = 0
    for match in [*_EDGE.finditer(text), None]:
        end = match.end() if match else len(text)
        if part := text[start:end].strip():
            first = text.index(part, start)
            yield first, first + len(part)
        start = end


def known_sentences(text: str, own: Knowledge) -> list[tuple[int, int, str]]:
    """Places and identifiers of the known sentences of a whole text, in order.

    A sentence may run over lines; one that is not known is looked up line by line.
    """
    lower = text.lower()
    if not any(t in lower for t in own.triggers):
        return []
    if "spdx-license-identifier" in lower:
        # The tag's colon is no sentence end.
        text = re.sub(r"(?i)(spdx-license-identifier):", r"\1 ", text)
    found = []
    for start, end in sentences(text):
        name = own.sentences.get(normal(text[start:end]))
        if name is not None:
            found.append((start, end, name))
            continue
        for line in text[start:end].splitlines(keepends=True) if "\n" in text[start:end] else ():
            name = own.sentences.get(normal(line))
            if name is not None:
                lead = len(line) - len(line.lstrip())
                found.append((start + lead, start + len(line.rstrip()), name))
            start += len(line)
    return found


def _fit(names: list[str], at: int, rule: tuple[str, ...]) -> int:
    """How many identifiers from ``at`` on follow the rule in its order; zero if it does not hold."""
    k = at
    for item in rule:
        if k < len(names) and names[k] == item.rstrip("?"):
            k += 1
        elif not item.endswith("?"):
            return 0
    return k - at


def recognised(text: str, own: Knowledge) -> list[tuple[str, int, int, int]]:
    """``(licence, start, end, sentences)`` of each licence, left to right; at each place the rule that takes most."""
    found = known_sentences(text, own)
    names, out, at = [f[2] for f in found], [], 0
    while at < len(names):
        most, licence = max(((_fit(names, at, rule), name) for name, rule in own.rules), key=lambda x: x[0], default=(0, ""))
        if most:
            out.append((licence, found[at][0], found[at + most - 1][1], most))
        at += max(1, most)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", own: Knowledge | None = None) -> DataFrame:
    """``id_col, license, start, end, n_sentences``: a row for each licence found in a document.

    ``start`` and ``end`` count characters of the text. Null and empty texts
    and texts without a known sentence give no row; repeated rows each give
    theirs; extra columns are ignored; an empty table gives none.
    """
    shared = Shared(docs.sparkSession, own or knowledge())

    @F.pandas_udf("array<struct<license:string,start:bigint,end:bigint,n_sentences:bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("license", "start", "end", "n_sentences"), r, strict=True)) for r in recognised(t, shared.value)] for t in texts], dtype=object)

    rows = docs.select(F.col(id_col).alias("id"), F.explode(run(text_or_empty(text))).alias("found"))
    return rows.select(F.col("id").alias(id_col), "found.license", "found.start", "found.end", "found.n_sentences")
