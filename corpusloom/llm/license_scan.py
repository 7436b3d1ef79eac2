"""Licence statements in texts by conditional compression.

Candidate blocks are the words around those that licences use; clauses are what of them
stands between stops around one such word. A block is compressed alone and with each long
template (a licence's wording or opening) as raw zstandard dictionary, a clause with each
short one (how a licence is granted by name). Templates are ranked by the share of the size
that they take off; only those that take off enough, and not much less than the best, are
winners. Winners are confirmed in that order by exact wording: a block must share enough of
the template's words, and those that tell the licence from its kin; a clause must have the
name with version and flavour after words that grant. What of a template's wording a block
lacks or has otherwise is given with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licences' SPDX identifiers and the wording of the short ones, or of the notices of the long ones.
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_CC = "This work is licensed under the Creative Commons {} 4.0 International License."
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.",
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-2.0": "This program is free software; " + _GNU.format("", "2").replace("  ", " "),
    "GPL-3.0": "This program is free software: " + _GNU.format("", "3").replace("  ", " "),
    "LGPL-2.1": "This library is free software; " + _GNU.format("Lesser", "2.1"),
    "LGPL-3.0": "This library is free software: " + _GNU.format("Lesser", "3"),
    "AGPL-3.0": "This program is free software: " + _GNU.format("Affero", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal. The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    "CC-BY-4.0": _CC.format("Attribution"),
    "CC-BY-SA-4.0": _CC.format("Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _CC.format("Attribution-NoDerivatives"),
    "CC-BY-NC-4.0": _CC.format("Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": _CC.format("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _CC.format("Attribution-NonCommercial-NoDerivatives"),
}

# Openings of the whole texts of licences that TEMPLATES has notices of.
PASSAGES = {
    "GPL-2.0": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "GPL-3.0": "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "LGPL-2.1": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This license, the Lesser General Public License, applies to some specially designated software packages",
    "LGPL-3.0": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "AGPL-3.0": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "Apache-2.0": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    "MPL-2.0": "1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution.",
}

_CANDIDATE = re.compile(r"licen[sc]e|copyright|spdx|permission is hereby|permission to use|redistribution|all rights reserved|unencumbered|public domain|\bcc0\b|\bcc[- ]by\b|gpl|creative commons", re.IGNORECASE)
#: One of these is in every text with a candidate word.
_MARKS = ("licen", "copyright", "spdx", "permission", "redistribution", "all rights", "unencumbered", "public domain", "cc0", "cc by", "cc-by", "gpl", "creative commons")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)")
_WORD = re.compile(r"[a-z0-9.]+")
_LEADER = re.compile(r"[ \t\r]*\n[ \t\r]*(?:(?://|/\*|\*/|[*#;%>|]|--)+[ \t\r]*)*")
#: Words after which a name is a statement, in the same sentence.
_GRANT = re.compile(r"(?:\bunder\b|\bterms of\b|\bsubject to\b|\blicen[sc](?:ed?|ing)\b|\breleased\b|\bdedicated\b|\bwaived\b)(?:(?!\.\s)[^;]){0,160}$")


def _named(pattern: str) -> re.Pattern:
    """Spaces of the pattern stand for any white space or hyphen, 'licence' for either spelling."""
    return re.compile(pattern.replace(" ", r"[\s-]+").replace("licence", "licen[sc]e"))


def _gnu(name: str, short: str, version: str) -> re.Pattern:
    # the version may come later, but before another licence is named
    return _named(rf"(?s)(?:{name}general public licence|(?<![a-z]){short}(?:general public licence)?)(?:(?!licence|gpl|\.\s).){{0,120}}?(?:(?<![\d.])|(?<=v)){version}(?![.]?\d)")


_PLAIN = r"(?<!lesser\s)(?<!library\s)(?<!affero\s)"
_BY = r"(?:cc by|creative commons attribution|(?<!creative\x20commons\x20)attribution)"


def _cc(flavour: str) -> re.Pattern:
    return _named(rf"{_BY}{flavour}(?:\s+|-)(?:\([a-z\s-]+\)\s*)?(?:licence,?\s+)?(?:version |v)?4(?:\.0)?(?![.]?\d)")


_NC, _SA, _ND = r"(?:\s|-)+(?:nc|non-?commercial)", r"(?:\s|-)+(?:sa|share-?alike)", r"(?:\s|-)+(?:nd|no-?deriv(?:ative)?s)"
#: How a licence is named.
NAMES = {
    "MIT": _named(r"\bmit(?:/x11)? licence|(?<=under\x20)mit\b|(?<=the\x20)mit\b(?= or | and |/)|(?<=or\x20)mit\b|(?<=and\x20)mit\b|(?<=licence:\x20)mit\b|\bexpat licence"),
    "ISC": _named(r"\bisc licence"),
    "0BSD": _named(r"\b0bsd\b|\bzero clause bsd\b"),
    "BSD-2-Clause": _named(r"\bbsd 2 clause\b|\b(?:2|two) clause bsd\b|\bsimplified bsd\b|\bfreebsd licence"),
    "BSD-3-Clause": _named(r"\bbsd 3 clause\b|\b(?:3|three) clause bsd\b|\b(?:new|modified|revised) bsd\b"),
    "Apache-2.0": _named(r"\bapache(?: software)?(?: public)? licence,?\s*\(?(?:version |v\.?\s*)?2(?:\.0)?(?![.]?\d)|\bapache (?:v|version )?2(?:\.0)?(?![.]?\d)"),
    "GPL-2.0": _gnu(_PLAIN, "gpl", r"2(?:\.0)?"),
    "GPL-3.0": _gnu(_PLAIN, "gpl", r"3(?:\.0)?"),
    "LGPL-2.1": _gnu(r"(?:lesser|library)\s+", "lgpl", r"2\.1"),
    "LGPL-3.0": _gnu(r"lesser\s+", "lgpl", r"3(?:\.0)?"),
    "AGPL-3.0": _gnu(r"affero\s+", "agpl", r"3(?:\.0)?"),
    "MPL-2.0": _named(r"\b(?:mozilla public licence|mpl)(?:\s*\(mpl\))?,?\s*(?:version |v\.?\s*|-)?2(?:\.0)?(?![.]?\d)"),
    "EPL-2.0": _named(r"\b(?:eclipse public licence|epl)(?:\s*\(epl\))?,?\s*(?:version |v\.?\s*|-)?(?:- )?2(?:\.0)?(?![.]?\d)"),
    "Unlicense": _named(r"\bthe unlicense\b|(?<=under\x20)unlicense\b"),
    "BSL-1.0": _named(r"\bboost software licence"),
    "CC0-1.0": _named(r"\bcc0\b"),
    "CC-BY-4.0": _cc(""),
    "CC-BY-SA-4.0": _cc(_SA),
    "CC-BY-ND-4.0": _cc(_ND),
    "CC-BY-NC-4.0": _cc(_NC),
    "CC-BY-NC-SA-4.0": _cc(_NC + _SA),
    "CC-BY-NC-ND-4.0": _cc(_NC + _ND),
}
#: Words that a wording must (first) and must not (second) have to be that of a licence and not of its kin, from the candidate on.
KIN = {
    "MIT": (r"any\s+person\s+obtaining", r"person\s+or\s+organi[sz]ation"),
    "BSL-1.0": (r"person\s+or\s+organi[sz]ation", r"$^"),
    "ISC": (r"provided\s+that\s+the\s+above\s+copyright", r"$^"),
    "0BSD": (r"with\s+or\s+without\s+fee", r"provided\s+that\s+the\s+above\s+copyright"),
    "BSD-2-Clause": (r"must\s+reproduce", r"neither\s+the\s+name|names?\s+of\s+(?:the|its)\s.{0,80}may\s+not\s+be\s+used|advertising\s+materials"),
    "BSD-3-Clause": (r"neither\s+the\s+name|names?\s+of\s+(?:the|its)\s.{0,80}may\s+not\s+be\s+used", r"advertising\s+materials"),
    "Unlicense": (r"unencumbered", r"$^"),
    "GPL-2.0": (r"gnu\s+general\s+public\s+license\s+is\s+intended", r"$^"),
    "GPL-3.0": (r"gnu\s+general\s+public\s+license\s+is\s+a\s+free", r"$^"),
    "LGPL-2.1": (r"license,\s+the\s+lesser\s+general\s+public\s+license", r"$^"),
    "LGPL-3.0": (r"lesser\s+general\s+public\s+license\s+incorporates", r"$^"),
    "AGPL-3.0": (r"affero\s+general\s+public\s+license\s+is\s+a\s+free", r"$^"),
    "Apache-2.0": (r"sections\s+1\s+through\s+9", r"$^"),
    "MPL-2.0": (r"covered\s+software", r"$^"),
}
KIN = {n: (re.compile(a, re.DOTALL), re.compile(b, re.DOTALL)) for n, (a, b) in KIN.items()}

#: How a licence is called beside its identifier.
TITLES = {
    "MIT": "MIT License (Expat)", "ISC": "ISC License", "0BSD": "Zero-Clause BSD (0BSD)", "BSD-2-Clause": "BSD 2-Clause License (Simplified BSD, FreeBSD license)",
    "BSD-3-Clause": "BSD 3-Clause License (New, Modified or Revised BSD)", "Apache-2.0": "Apache License, Version 2.0", "GPL-2.0": "GNU General Public License, version 2 (GPLv2)",
    "GPL-3.0": "GNU General Public License, version 3 (GPLv3)", "LGPL-2.1": "GNU Lesser General Public License, version 2.1 (LGPL-2.1)", "LGPL-3.0": "GNU Lesser General Public License, version 3 (LGPL-3.0)",
    "AGPL-3.0": "GNU Affero General Public License, version 3 (AGPLv3)", "MPL-2.0": "Mozilla Public License 2.0 (MPL)", "EPL-2.0": "Eclipse Public License 2.0 (EPL)",
    "Unlicense": "The Unlicense", "BSL-1.0": "Boost Software License", "CC0-1.0": "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication", "CC-BY-4.0": "Creative Commons Attribution 4.0 (CC BY 4.0)",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 (CC BY-SA 4.0)", "CC-BY-ND-4.0": "Creative Commons Attribution-NoDerivatives 4.0 (CC BY-ND 4.0)",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 (CC BY-NC 4.0)", "CC-BY-NC-SA-4.0": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 (CC BY-NC-SA 4.0)",
    "CC-BY-NC-ND-4.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 (CC BY-NC-ND 4.0)",
}

#: Words before which a grant is none.
_DENIED = re.compile(r"(?:\b(?:not|never|neither|cannot)|n['’]t)\b[^.;]{0,40}$")
#: Characters of a block before and after a candidate word, and of a clause at most.
BEFORE, AFTER, CLAUSE = 220, 320, 110
#: Share of a block's and of a clause's size that a winner takes off, at least, and share of what the best one takes off.
BLOCK_SHARE, CLAUSE_SHARE, OF_BEST = 0.12, 0.35, 0.55
#: Share of words that must match.
LEAST_MATCH = 0.6
#: Bytes that any compressed text has besides its content.
FRAME = 9
#: Words between a grant and a name that is not the granted one.
_OTHER = re.compile(r"\b(?:not|nor|never|rather than|instead of|unlike)\s+(?:(?:under|by|for|of)\s+)?(?:the\s+|an?\s+)?(?:gnu\s+)?$")
_STOP = re.compile(r"[;!?\n]|\.(?=\s|$)|:(?=\s)")
_OR = re.compile(r",?[\s(/]\b(?:or|and)\b(?!/)|/(?=[a-z]{3})|,\s(?=the\s)")
_VERSION_BELOW = re.compile(r"(licen[sc]e)\n+ ?(version \d)")
#: How a licence is granted by name; {} is its title.
_GRANTS = "this work is licensed under the {}. licensed under {}. released under the terms of the {}. this software is distributed under the {}. available under the {} license. subject to the terms of the {}. dedicated to the public domain under {}. "


class Scanner:
    """Templates as dictionaries."""

    def __init__(self, templates: dict[str, str]):
        import zstandard

        def held(text: str):
            content = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=3)
            return zstandard.ZstdCompressor(level=3, dict_data=content)

        self.plain = zstandard.ZstdCompressor(level=3)
        # where a licence's opening is known, that is its wording, and its notice names it
        self.words = {n: _WORD.findall(PASSAGES.get(n, t).lower()) for n, t in templates.items()}
        self.long = {n: held(f"{t}\n{PASSAGES.get(n, '')}") for n, t in templates.items()}
        self.short = {n: held(f"spdx-license-identifier: {n}\n{_GRANTS.replace('{}', TITLES.get(n, n))}{t}") for n, t in templates.items()}

    def blocks(self, flat: str) -> list[tuple[int, int]]:
        """Where the candidate blocks of a text lie: words around candidate words, joined where they meet."""
        out: list[tuple[int, int]] = []
        for m in _CANDIDATE.finditer(flat):
            start, end = max(0, m.start() - BEFORE), min(len(flat), m.end() + AFTER)
            if out and start <= out[-1][1]:
                out[-1] = out[-1][0], end
            else:
                out.append((start, end))
        return out

    def clauses(self, flat: str, start: int, end: int) -> list[tuple[int, int]]:
        """Where the clauses with a candidate word of a block lie; a clause ends at a stop, or where it is too long at a word."""
        out: list[tuple[int, int]] = []
        for m in _CANDIDATE.finditer(flat, start, end):
            before = flat[max(0, m.start() - CLAUSE) : m.start()]
            stops = [s.end() for s in _STOP.finditer(before)]
            low = m.start() - len(before) + (stops[-1] if stops else before.find(" ") + 1 if len(before) == CLAUSE else 0)
            stop = _STOP.search(flat, m.end(), min(len(flat), m.end() + CLAUSE))
            high = stop.start() if stop else min(len(flat), m.end() + CLAUSE)
            if (low, high) not in out:
                out.append((low, high))
        return out

    @staticmethod
    def alternatives(flat: str, low: int, high: int) -> list[tuple[int, int]]:
        """The parts of a clause that may name a licence each."""
        cuts = [low, *(m.start() for m in _OR.finditer(flat, low, high)), high]
        return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if flat[a:b].strip()]

    def ranked(self, part: str, dictionaries: dict, least: float) -> list[tuple[int, str]]:
        """(bytes taken off, licence) of the winners for a block or clause, most first."""
        data = part.strip().encode()
        alone = len(self.plain.compress(data))
        saved = sorted(((alone - len(c.compress(data)), name) for name, c in dictionaries.items()), key=lambda x: (-x[0], x[1]))
        least_saved = max(least * max(alone - FRAME, 1), OF_BEST * saved[0][0] if saved else 0)
        return [(n, name) for n, name in saved if n > 0 and n >= least_saved]

    def wording(self, block: str, name: str) -> tuple[list[str], list[str]] | None:
        """Words of the template that a block lacks, and words that it has within the wording instead; None if it is not this wording."""
        needed, barred = KIN.get(name, (None, None))
        if (name in NAMES and needed is None) or (needed is not None and (not needed.search(block) or barred.search(block))):
            return None
        have, want = _WORD.findall(block), self.words[name]
        ops = SequenceMatcher(None, have, want, autojunk=False).get_opcodes()
        same = [op for op in ops if op[0] == "equal" and op[2] - op[1] > 1]
        # a block may hold a part of the template, and more than the template
        if not same or sum(op[2] - op[1] for op in same) < LEAST_MATCH * min(same[-1][2] - same[0][1], len(want)) or sum(op[2] - op[1] for op in same) < 8:
            return None
        inside = [op for op in ops if same[0][1] <= op[1] and op[2] <= same[-1][2] and op[0] != "equal"]
        return [w for op in inside for w in want[op[3] : op[4]]], [w for op in inside for w in have[op[1] : op[2]]]

    def named(self, flat: str, start: int, end: int, name: str) -> bool:
        """Whether a block names the licence after granting words or as a heading."""
        if name not in NAMES:
            return False
        for m in NAMES[name].finditer(flat, start, end):
            before, after = flat[: m.start()].removesuffix("gnu ").removesuffix("the "), flat[m.end() :]
            if (not before or before.endswith("\n")) and re.match(r"(?:,? \d+ \w+ \d{4}|,? \w+ \d{4})?(?: licen[sc]e)?[ .:]*(?:\n|$)", after):
                return True
            clause = flat[max(0, m.start() - 220) : m.start()]
            granted = _GRANT.search(clause)
            if granted and not _DENIED.search(clause[: granted.start()]) and not _OTHER.search(clause[granted.start() :]):
                return True
        return False

    @staticmethod
    def lines(text: str | None) -> int:
        """Number of lines with a candidate word."""
        low = (text or "").lower()
        if not any(mark in low for mark in _MARKS):
            return 0
        return sum(1 for x in text.split("\n") if _CANDIDATE.search(x))

    def matches(self, text: str | None) -> list[tuple[str, int, list[str], list[str]]]:
        """(licence, bytes saved, words lacking, words instead) of a text, each licence once, by its best block; sorted by name."""
        if not self.lines(text):
            return []
        flat = re.sub(r"[ \t\r]+", " ", _LEADER.sub("\n", "\n" + _SPDX.sub(" ", text))).lstrip("\n").lower()
        found: dict[str, tuple[str, int, list[str], list[str]]] = {}
        flat = _VERSION_BELOW.sub(r"\1 \2", flat)
        for start, end in self.blocks(flat):
            block = flat[start:end]
            # a notice has the name within its wording
            notices = {name for _, name in self.ranked(block, self.long, CLAUSE_SHARE)}
            for saved, name in self.ranked(block, self.long, BLOCK_SHARE):
                differences = self.wording(block, name)
                if differences is None and name in notices and self.named(flat, start, end, name):
                    differences = [], []
                if differences is not None and (name not in found or found[name][1] < saved):
                    found[name] = name, saved, *differences
            for low, high in self.clauses(flat, start, end):
                for at, to in self.alternatives(flat, low, high):
                    for saved, name in self.ranked(("licensed under " if at > low else "") + flat[at:to], self.short, CLAUSE_SHARE):
                        if name not in found and self.named(flat, at, to, name):
                            found[name] = name, saved, [], []
        return [found[n] for n in sorted(found)]

    def tags(self, text: str | None) -> list[str]:
        """Identifiers in SPDX tags, without exceptions, sorted."""
        found = set()
        for stated in _SPDX.finditer(text or ""):
            tokens = stated[1].replace("(", " ").replace(")", " ").split()
            found |= {t for k, t in enumerate(tokens) if t not in ("OR", "AND", "WITH") and (k == 0 or tokens[k - 1] != "WITH")}
        return sorted(found)

    def text(self, text: str | None) -> tuple[int, list[str]]:
        """Number of lines with a candidate word, and the licences found or tagged, sorted."""
        lines = self.lines(text)
        return lines, sorted({m[0] for m in self.matches(text)} | set(self.tags(text))) if lines else []


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per input row: id, n_blocks (lines with a candidate word), licenses (sorted names), spdx (those in tags), and matches.

    matches: for each licence that a block was confirmed for, the bytes that its template
    saves and the words of the template that the block lacks (missing) or has instead
    (added). A null or empty text has none; null ids stay; repeated rows give repeated
    results; licences that save alike are all looked at, so there are no ties; an empty table
    gives no rows; other columns are ignored.
    """
    match = pa.struct([("license", pa.string()), ("saved", pa.int32()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])
    schema = f"{id_col} long, n_blocks long, licenses array<string>, spdx array<string>, matches array<struct<license: string, saved: int, missing: array<string>, added: array<string>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            lines, names, tags, matches = [], [], [], []
            for text in batch.column(1).to_pylist():
                n = scanner.lines(text)
                found, tagged = (scanner.matches(text), scanner.tags(text)) if n else ([], [])
                lines.append(n)
                names.append(sorted({m[0] for m in found} | set(tagged)))
                tags.append(tagged)
                matches.append([dict(zip(("license", "saved", "missing", "added"), m, strict=True)) for m in found])
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(names, strings), pa.array(tags, strings), pa.array(matches, pa.list_(match))], names=[id_col, "n_blocks", "licenses", "spdx", "matches"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
