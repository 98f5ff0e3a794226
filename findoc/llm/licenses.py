"""License scan by sentence rules.

A text's words (runs of ASCII letters and digits in lower case) are looked up in a table of known license sentences, which
may run over wrapped lines, comment marks and inner punctuation. A sentence starts and ends at a border: an end of the
text or of a line, a bracket or quote, or a mark followed by a space. The sequence of identifiers that a text holds is matched
against ordered rules: at each place the longest rule wins. Every sentence of the table holds a word of ANCHORS or
names a license after "under", so other texts are passed over quickly.
"""

from __future__ import annotations

import re
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findoc.llm.common import map_batches

#: How short notices begin, and what may stand between that and the license's name.
LEADS = [
    "", "licensed", "released", "distributed", "available", "published", "provided", "dual licensed", "made available", "this project is licensed", "this work is licensed", "this program is licensed", "this software is licensed",
    "this code is licensed", "this file is licensed", "this library is licensed", "this package is licensed", "this repository is licensed", "this document is licensed", "this text is licensed", "this content is licensed", "this article is licensed",
    "this project is released", "this work is released", "this program is released", "this software is released", "this code is released", "this software is distributed", "the code is licensed", "the project is licensed", "it is licensed", "it is released", "code is licensed",
]
UNDER = ["under", "under the", "under a", "under an", "under the terms of", "under the terms of the", "under the terms and conditions of the", "subject to the terms of the"]

#: Names of licenses, as short notices give them.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT License (MIT)", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache Software License 2.0", "Apache License, Version 2", "Apache 2.0 License", "Apache-2.0 license", "Apache 2.0", "Apache-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License version 3.0", "GNU General Public License v3.0", "GNU General Public License v3", "GNU GPL v3 License", "GNU GPL v3.0 license", "GNU GPL v3", "GNU GPLv3", "GPLv3", "GPL v3", "GPL-3.0", "GPLv3 license", "GPL-3.0 license"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License version 2.0", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPL v2 License", "GNU GPL v2", "GNU GPLv2", "GPLv2", "GPL v2", "GPL-2.0", "GPLv2 license", "GPL-2.0 license"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 3.0", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3", "LGPL v3", "LGPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL v2.1", "LGPL-2.1"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License version 3.0", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL v3", "AGPL-3.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License", "BSD-2-Clause"],
    "ISC": ["ISC License", "ISC"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0", "EPL-2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "Zlib": ["zlib License", "zlib/libpng license"],
    "CC-BY-4.0": ["CC BY 4.0", "CC BY 4.0 license", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 license"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 4.0 license"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC BY-NC 4.0 license", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-NonCommercial 4.0 license"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "CC BY-NC-SA 4.0 license", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC BY-ND 4.0 license", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 license", "Creative Commons Zero v1.0 Universal", "CC0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
}

CLASSES = {
    "permissive": ("MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "0BSD", "ISC", "BSL-1.0", "Zlib", "CC-BY-4.0", "CC0-1.0", "Unlicense", "WTFPL"),
    "copyleft": ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "CC-BY-SA-4.0"),
    "noncommercial": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"),
    "restricted": ("CC-BY-ND-4.0",),
}

#: Sentences of the licenses' texts and of their standard notices. ``*`` stands for 1 to GAP words.
SENTENCES = {
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "no-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "apache-terms": ["\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document"],
    "apache-compliance": ["you may not use this file except in compliance with the License", "you may not use * except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-url": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache-limits": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl2-preamble": ["The licenses for most software are designed to take away your freedom to share and change it"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl3-preamble": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"],
    "agpl3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "gnu-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "gpl3-free": [f"{start} the GNU General Public License as published by the Free Software Foundation, {end}" for start in ("you can redistribute it and/or modify it under the terms of", "you may redistribute it and/or modify it under the terms of") for end in ("either version 3 of the License, or (at your option) any later version", "version 3 of the License", "version 3")],
    "gpl2-free": [f"{start} the GNU General Public License as published by the Free Software Foundation; {end}" for start in ("you can redistribute it and/or modify it under the terms of", "you may redistribute it and/or modify it under the terms of") for end in ("either version 2 of the License, or (at your option) any later version", "version 2 of the License", "version 2")] + ["you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl3-free": [f"you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, {end}" for end in ("either version 3 of the License, or (at your option) any later version", "version 3 of the License")],
    "lgpl21-free": [f"you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; {end}" for end in ("either version 2.1 of the License, or (at your option) any later version", "version 2.1 of the License")],
    "agpl3-free": [f"you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, {end}" for end in ("either version 3 of the License, or (at your option) any later version", "version 3 of the License")],
    "gnu-warranty": ["* is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-see": ["See the GNU General Public License for more details"],
    "lgpl-see": ["See the GNU Lesser General Public License for more details"],
    "agpl-see": ["See the GNU Affero General Public License for more details"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-as-is": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl-obtain": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "epl-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "wtfpl-title": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "cc0-waived": ["To the extent possible under law, * has waived all copyright and related or neighboring rights to *"],
}

#: Ordered sentence identifiers and the license that they state.
RULES = [
    (("mit-grant", "mit-condition", "as-is", "no-liability"), "MIT"),
    (("mit-grant", "mit-condition"), "MIT"),
    (("mit-grant",), "MIT"),
    (("apache-title", "apache-url", "apache-terms"), "Apache-2.0"),
    (("apache-title",), "Apache-2.0"),
    (("apache-compliance", "apache-copy", "apache-url", "apache-as-is", "apache-limits"), "Apache-2.0"),
    (("apache-copy", "apache-url"), "Apache-2.0"),
    (("apache-compliance", "apache-copy", "apache-url"), "Apache-2.0"),
    (("gpl3-title", "gnu-verbatim", "gpl3-preamble"), "GPL-3.0"),
    (("gpl3-title",), "GPL-3.0"),
    (("gpl3-free", "gnu-warranty", "gpl-see"), "GPL-3.0"),
    (("gpl3-free",), "GPL-3.0"),
    (("gpl2-title", "gnu-verbatim", "gpl2-preamble"), "GPL-2.0"),
    (("gpl2-title",), "GPL-2.0"),
    (("gpl2-free", "gnu-warranty", "gpl-see"), "GPL-2.0"),
    (("gpl2-free",), "GPL-2.0"),
    (("lgpl21-title",), "LGPL-2.1"),
    (("lgpl21-free", "gnu-warranty", "lgpl-see"), "LGPL-2.1"),
    (("lgpl21-free",), "LGPL-2.1"),
    (("lgpl3-title", "gnu-verbatim", "lgpl3-preamble"), "LGPL-3.0"),
    (("lgpl3-title",), "LGPL-3.0"),
    (("lgpl3-free", "gnu-warranty", "lgpl-see"), "LGPL-3.0"),
    (("lgpl3-free",), "LGPL-3.0"),
    (("agpl3-title",), "AGPL-3.0"),
    (("agpl3-free", "gnu-warranty", "agpl-see"), "AGPL-3.0"),
    (("agpl3-free",), "AGPL-3.0"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("isc-grant", "isc-as-is"), "ISC"),
    (("isc-grant",), "ISC"),
    (("0bsd-grant", "isc-as-is"), "0BSD"),
    (("mpl-notice", "mpl-obtain"), "MPL-2.0"),
    (("mpl-notice",), "MPL-2.0"),
    (("epl-notice",), "EPL-2.0"),
    (("zlib-as-is", "zlib-grant"), "Zlib"),
    (("zlib-grant",), "Zlib"),
    (("boost-grant",), "BSL-1.0"),
    (("unlicense-free", "unlicense-anyone"), "Unlicense"),
    (("unlicense-free",), "Unlicense"),
    (("wtfpl-title",), "WTFPL"),
    (("cc0-waived",), "CC0-1.0"),
]

ANCHORS = ("licens", "licenc", "permission", "permitted", "copyright", "warrant", "redistribut", "gnu", "unencumbered", "compiled binary", "mozilla")
#: Words that a ``*`` may stand for.
GAP = 12

_WORD = re.compile(r"[A-Za-z0-9]+")
_BORDER = re.compile(r"[\n\"“”‘’()\[\]{}<>*#|]|[.,;:!?—–-]\s|\s[—–'/-]")
_NAMED = re.compile(r"under[\s*/#>]+(?:(?:an?|the|terms|and|conditions|of)[\s*/#>]+)*\"?(?:mit|isc|apache|bsd|[23]|new|modified|simplified|cc|creative|a?gpl|lgpl|mpl|mozilla|epl|eclipse|bsl|boost|zlib|wtfpl)")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n*#>]+)")
_SPELT = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense"}


def normal(sentence: str) -> list[str]:
    """Runs of ASCII letters and digits in lower case; a licence is a license."""
    return [_SPELT.get(w, w) for w in map(str.lower, _WORD.findall(sentence))]


def _notices() -> dict[tuple[str, ...], str]:
    """Short notices: every lead with every name. A name without a lead must say that it is a license."""
    found: dict[tuple[str, ...], str] = {}
    for name, forms in NAMES.items():
        for form, lead, under in product(forms, LEADS, ["", *UNDER]):
            if (lead and under) or (not lead and "license" in normal(form)):
                found.setdefault((*normal(lead), *normal(under), *normal(form)), f"{name}-notice")
        for form in forms:
            if "license" in normal(form):
                for before in ("the", "license", "license the"):
                    found.setdefault((*before.split(), *normal(form)), f"{name}-notice")
    return found


def _first_words() -> dict[tuple[str, ...], list[tuple[tuple[str, ...], str]]]:
    """Known sentences by their first two words, the longest first; those that start with ``*`` by the two words after it."""
    known = _notices()
    for name, forms in SENTENCES.items():
        for form in forms:
            words: list[str] = []
            for k, part in enumerate(form.split("*")):
                words += ["*"] * (k > 0) + normal(part)
            known.setdefault(tuple(words), name)
    by: dict[tuple[str, ...], list] = {}
    for words, name in known.items():
        at = 1 if words[0] == "*" else 0
        by.setdefault(words[at : at + 2], []).append((words, name))
    return {k: sorted(v, key=lambda x: (-len(x[0]), x)) for k, v in by.items()}


_KNOWN = _first_words()
_SPDX_NAMES = {name.lower() + end: name for name in {n for names in CLASSES.values() for n in names} for end in ("", "-only", "-or-later", "+")}
_RULES = sorted([*RULES, *(((f"{name}-{kind}",), name) for kind in ("notice", "spdx") for name in sorted({n for names in CLASSES.values() for n in names}))], key=lambda r: -len(r[0]))
_CLASS = {name: kind for kind, names in CLASSES.items() for name in names}


def _end(words: list[str], at: int, form: tuple[str, ...], borders: list[bool]) -> int:
    """Where ``form`` ends if it stands at ``at`` and its end is a border, else -1."""
    if "*" not in form:
        end = at + len(form)
        return end if end <= len(words) and borders[end] and tuple(words[at:end]) == form else -1
    k = form.index("*")
    if tuple(words[at : at + k]) != form[:k]:
        return -1
    rest = form[k + 1 :]
    for start in range(at + k + 1, min(at + k + GAP, len(words)) + 1):
        if rest:
            if words[start : start + 1] == [rest[0]] and (end := _end(words, start, rest, borders)) >= 0:
                return end
        elif borders[start]:
            return start
    return -1


def sentence_ids(text: str) -> list[tuple[int, str]]:
    """(start, identifier) of the known sentences, by start, the longest at each place; they do not overlap."""
    low = text.lower()
    if not any(a in low for a in ANCHORS) and not ("under" in low and _NAMED.search(low)):
        return []
    marks = list(_WORD.finditer(text))
    words = [_SPELT.get(w, w) for w in (m[0].lower() for m in marks)]
    borders = [True, *(bool(_BORDER.search(text, a.end(), b.start())) for a, b in zip(marks, marks[1:], strict=False)), True]
    spdx = {m.start(): [_SPDX_NAMES[x] for x in re.findall(r"[a-z0-9.+-]+", m[1].lower()) if x in _SPDX_NAMES] for m in _SPDX.finditer(text)}
    found, at = [], 0
    while at < len(words):
        if marks[at].start() in spdx:
            found += [(marks[at].start(), f"{name}-spdx") for name in spdx[marks[at].start()]]
        end = -1
        for form, name in _KNOWN.get(tuple(words[at : at + 2]), ()):
            # what may start anywhere has its first words before it
            if (form[0] == "*" and at and (end := _end(words, at, form[1:], borders)) >= 0) or (form[0] != "*" and borders[at] and (end := _end(words, at, form, borders)) >= 0):
                found.append((marks[at].start(), name))
                break
        at = end if end > at else at + 1
    return found


def match_rules(names: list[str]) -> list[tuple[str, str]]:
    """(license, class) stated by a sequence of identifiers, from left to right, the longest rule first; others are passed over."""
    out, at = [], 0
    while at < len(names):
        for rule, name in _RULES:
            if tuple(names[at : at + len(rule)]) == rule:
                out.append((name, _CLASS[name]))
                at += len(rule)
                break
        else:
            at += 1
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_sentences, sentences (start:identifier, comma-joined), licenses, classes.

    ``licenses`` and ``classes`` are the distinct ones in order of first statement, comma-joined, empty where none is
    stated. Starts count code points. A null text is empty; whole texts are read, however long. Rows repeat as they come;
    no rows give no rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    kind = dict(docs.dtypes)[id_col]
    kind = kind if kind in ("bigint", "int", "string") else "string"

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, sentences, licenses, classes = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = sentence_ids(text or "")
                stated = match_rules([name for _, name in ids])
                n.append(len(ids))
                sentences.append(",".join(f"{at}:{name}" for at, name in ids))
                licenses.append(",".join(dict.fromkeys(name for name, _ in stated)))
                classes.append(",".join(dict.fromkeys(kind for _, kind in stated)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(c, pa.string()) for c in (sentences, licenses, classes))], ["doc_id", "n_sentences", "sentences", "licenses", "classes"])

        return each

    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, f"doc_id {kind}, n_sentences long, sentences string, licenses string, classes string")
