"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Every line of every text is looked at. Lines that have a licence word are blocks (with the lines that follow directly), and so are the
stretches of words around each licence word that are as long as a template, whatever the lines; each
block is a sparse vector over the words and word pairs of the templates and is compared with every template. The templates are header
lines, notices, the titles and openings of the long licences' files (the rest of such a file follows from its opening) and the whole
short licences. Sentences that deny a licence ("not licensed under ...") are left out. A file's licence is its
best block's. A file without one inherits from the licence files of the nearest directory above it: directories are joined with their
ancestors' paths once, files then with their own directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkquill.llm.batches import LOWER, buffers, slices, stored

_TERM = re.compile(r"[a-z0-9][a-z0-9.]*[a-z0-9]|[a-z0-9]")
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_2 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."


# Dates and years in the titles of the GNU licences, and the sentence after them.
_DATES = {("", "2"): "June 1991", ("", "3"): "29 June 2007", ("Lesser", "2.1"): "February 1999", ("Lesser", "3"): "29 June 2007", ("Affero", "3"): "19 November 2007"}
_YEARS = {("", "2"): "1989, 1991", ("", "3"): "2007", ("Lesser", "2.1"): "1991, 1999", ("Lesser", "3"): "2007", ("Affero", "3"): "2007"}
_COPIES = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_MIT_ALL = _MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."
_APACHE = "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution"
_APACHE_1 = ' 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.'
_APACHE_NOTICE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
_APACHE_END = " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = ", provided that the above copyright notice and this permission notice appear in all copies. The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_END = " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."


def _gnu(kind: str, version: str, whats: tuple[str, ...], spdx: str) -> list[str]:
    """One line, the SPDX identifiers and the notices of a licence of the GNU family."""
    name = f"GNU {kind} General Public License".replace("  ", " ")
    lines = [f"This work is licensed under the {name}, version {version}.", f"Licensed under the {name} version {version}", f"{name} Version {version}"]
    ids = [f"SPDX-License-Identifier: {spdx}-only", f"SPDX-License-Identifier: {spdx}-or-later"]
    title = f"{name} Version {version}, {_DATES[kind, version]} Copyright (C) {_YEARS[kind, version]} Free Software Foundation, Inc. "
    return [*lines, *ids, f"{name} Version {version}, {_DATES[kind, version]}", title + _COPIES, *(_GNU.format(what=w, kind=kind, v=version).replace("  ", " ") for w in whats)]


#: Header lines, notices and openings of common licences.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", _MIT, _MIT_ALL],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004", _APACHE, _APACHE + _APACHE_1, _APACHE_NOTICE, _APACHE_NOTICE + _APACHE_END],
    "GPL-3.0": _gnu("", "3", ("program",), "GPL-3.0"),
    "GPL-2.0": _gnu("", "2", ("program",), "GPL-2.0"),
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser", "3", ("library", "program"), "LGPL-3.0")],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", *_gnu("Lesser", "2.1", ("library", "program"), "LGPL-2.1")],
    "AGPL-3.0": _gnu("Affero", "3", ("program",), "AGPL-3.0"),
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International Public License", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", _BSD.strip(": "), _BSD + _BSD_2 + _BSD_3, _BSD + _BSD_2 + _BSD_3 + _BSD_END],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause", _BSD + _BSD_2, _BSD + _BSD_2 + _BSD_END],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", _ISC, _ISC + _ISC_END],
    "Unlicense": [_UNLICENSE, _UNLICENSE + _UNLICENSE_END, "SPDX-License-Identifier: Unlicense"],
}

# Identifier, full name and short names of licences whose header lines follow from them.
NAMES = [
    ("MIT", "MIT License", ["MIT"]), ("MIT-0", "MIT No Attribution License", ["MIT-0"]), ("X11", "X11 License", ["X11"]), ("0BSD", "BSD Zero Clause License", ["0BSD"]),
    ("BSD-2-Clause", "BSD 2-Clause License", ["BSD-2-Clause", "Simplified BSD"]), ("BSD-3-Clause", "BSD 3-Clause License", ["BSD-3-Clause", "New BSD"]), ("BSD-4-Clause", "BSD 4-Clause License", ["BSD-4-Clause", "Original BSD"]),
    ("Apache-1.0", "Apache License, Version 1.0", ["Apache 1.0"]), ("Apache-1.1", "Apache License, Version 1.1", ["Apache 1.1"]), ("Apache-2.0", "Apache License, Version 2.0", ["Apache 2.0", "Apache-2.0"]),
    ("GPL-1.0", "GNU General Public License, version 1", ["GPLv1", "GPL 1.0"]), ("GPL-2.0", "GNU General Public License, version 2", ["GPLv2", "GPL 2.0"]), ("GPL-3.0", "GNU General Public License, version 3", ["GPLv3", "GPL 3.0"]),
    ("LGPL-2.0", "GNU Library General Public License, version 2", ["LGPLv2", "LGPL 2.0"]), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1", ["LGPLv2.1", "LGPL 2.1"]), ("LGPL-3.0", "GNU Lesser General Public License, version 3", ["LGPLv3", "LGPL 3.0"]),
    ("AGPL-3.0", "GNU Affero General Public License, version 3", ["AGPLv3", "AGPL 3.0"]), ("GFDL-1.2", "GNU Free Documentation License, Version 1.2", ["GFDL 1.2"]), ("GFDL-1.3", "GNU Free Documentation License, Version 1.3", ["GFDL 1.3"]),
    ("MPL-1.0", "Mozilla Public License, Version 1.0", ["MPL 1.0"]), ("MPL-1.1", "Mozilla Public License, Version 1.1", ["MPL 1.1"]), ("MPL-2.0", "Mozilla Public License, Version 2.0", ["MPL 2.0"]),
    ("EPL-1.0", "Eclipse Public License, Version 1.0", ["EPL 1.0"]), ("EPL-2.0", "Eclipse Public License, Version 2.0", ["EPL 2.0", "EPL-2.0"]), ("CPL-1.0", "Common Public License, Version 1.0", ["CPL 1.0"]),
    ("CDDL-1.0", "Common Development and Distribution License, Version 1.0", ["CDDL 1.0"]), ("CDDL-1.1", "Common Development and Distribution License, Version 1.1", ["CDDL 1.1"]), ("EUPL-1.1", "European Union Public Licence, Version 1.1", ["EUPL 1.1"]),
    ("EUPL-1.2", "European Union Public Licence, Version 1.2", ["EUPL 1.2"]), ("BSL-1.0", "Boost Software License, Version 1.0", ["BSL-1.0"]), ("Zlib", "zlib License", ["Zlib"]), ("ISC", "ISC License", ["ISC"]), ("Unlicense", "Unlicense", ["The Unlicense"]),
    ("WTFPL", "Do What The Fuck You Want To Public License", ["WTFPL"]), ("Artistic-1.0", "Artistic License 1.0", ["Artistic 1.0"]), ("Artistic-2.0", "Artistic License 2.0", ["Artistic 2.0"]), ("Python-2.0", "Python License, Version 2", ["Python-2.0"]),
    ("PSF-2.0", "Python Software Foundation License, Version 2", ["PSF-2.0", "PSFL"]), ("OFL-1.1", "SIL Open Font License, Version 1.1", ["OFL 1.1"]), ("NCSA", "University of Illinois NCSA Open Source License", ["NCSA"]), ("PostgreSQL", "PostgreSQL License", ["PostgreSQL"]),
    ("Ruby", "Ruby License", ["Ruby"]), ("PHP-3.01", "PHP License, version 3.01", ["PHP 3.01"]), ("OpenSSL", "OpenSSL License", ["OpenSSL"]), ("Vim", "Vim License", ["Vim"]), ("MS-PL", "Microsoft Public License", ["MS-PL"]), ("MS-RL", "Microsoft Reciprocal License", ["MS-RL"]),
    ("LPPL-1.3c", "LaTeX Project Public License, Version 1.3c", ["LPPL 1.3c"]), ("AFL-3.0", "Academic Free License, Version 3.0", ["AFL 3.0"]), ("OSL-3.0", "Open Software License, Version 3.0", ["OSL 3.0"]), ("CECILL-2.1", "CeCILL Free Software License Agreement v2.1", ["CeCILL 2.1"]),
    ("UPL-1.0", "Universal Permissive License, Version 1.0", ["UPL 1.0"]), ("ECL-2.0", "Educational Community License, Version 2.0", ["ECL 2.0"]), ("BlueOak-1.0.0", "Blue Oak Model License 1.0.0", ["BlueOak-1.0.0"]), ("ODbL-1.0", "Open Data Commons Open Database License v1.0", ["ODbL 1.0"]),
    ("SSPL-1.0", "Server Side Public License, Version 1", ["SSPL 1.0"]), ("BUSL-1.1", "Business Source License 1.1", ["BUSL 1.1"]), ("Elastic-2.0", "Elastic License 2.0", ["Elastic 2.0"]), ("CC0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication", ["CC0 1.0", "CC0"]),
]
# The parts of the Creative Commons licences and the versions that they come in.
CC_PARTS = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
CC_VERSIONS = [("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")]
# Paragraphs of the Apache License 2.0 after its definitions' opening, and whole short licences.
_APACHE_BODY = [
    'Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.',
    'Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted.',
    'Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions: (a) You must give any other recipients of the Work or Derivative Works a copy of this License; and (b) You must cause any modified files to carry prominent notices stating that You changed the files;',
    'Submission of Contributions. Unless You explicitly state otherwise, any Contribution intentionally submitted for inclusion in the Work by You to the Licensor shall be under the terms and conditions of this License, without any additional terms or conditions.',
    'Trademarks. This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.',
    'Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its Contributions) on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE.',
    'Limitation of Liability. In no event and under no legal theory, whether in tort (including negligence), contract, or otherwise, unless required by applicable law (such as deliberate and grossly negligent acts) or agreed to in writing, shall any Contributor be liable to You for damages, including any direct, indirect, special, incidental, or consequential damages of any character arising as a result of this License or out of the use or inability to use the Work.',
    'Accepting Warranty or Additional Liability. While redistributing the Work or Derivative Works thereof, You may choose to offer, and charge a fee for, acceptance of support, warranty, indemnity, or other liability obligations and/or rights consistent with this License.',
    '"Contribution" shall mean any work of authorship, including the original version of the Work and any modifications or additions to that Work or Derivative Works thereof, that is intentionally submitted to Licensor for inclusion in the Work by the copyright owner or by an individual or Legal Entity authorized to submit on behalf of the copyright owner.',
]
_WHOLE = {
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Creative Commons CC0", "CC0 1.0 Universal Creative Commons"],
    "BSD-4-Clause": ["All advertising materials mentioning features or use of this software must display the following acknowledgement: Redistribution and use in source and binary forms"],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."],
}


def _cc() -> list[tuple[str, str, list[str]]]:
    """The Creative Commons licences in the form of NAMES."""
    return [(f"CC-{p}-{v}", f"Creative Commons {n} {v} {k} License", [f"CC {p} {v}", f"CC-{p}-{v}"]) for p, n in CC_PARTS for v, k in CC_VERSIONS]


def _all_templates() -> dict[str, list[str]]:
    """TEMPLATES, the paragraphs, and the header lines that follow from names, each once."""
    out = {k: list(v) for k, v in TEMPLATES.items()}
    seen = {tuple(_TERM.findall(t.lower())) for ts in out.values() for t in ts}
    lines = [(i, [f"SPDX-License-Identifier: {i}", f"Licensed under the {name}", f"Released under the {name}", f"License: {name}", *(x for s in short for x in (f"Licensed under {s}", f"License: {s}"))]) for i, name, short in [*NAMES, *_cc()]]
    for i, texts in [("Apache-2.0", _APACHE_BODY), *_WHOLE.items(), *lines]:
        for t in texts:
            key = tuple(_TERM.findall(t.lower()))
            if key not in seen:
                seen.add(key)
                out.setdefault(i, []).append(t)
    return out


#: One of these, lower-cased, is in every line that can belong to a licence block.
ANCHORS = (b"licen", b"permission", b"redistribut", b"gnu ", b"free software", b"public domain", b"unencumbered", b"creative commons")
ALL_TEMPLATES = _all_templates()
LEAST = 0.6
#: Cosines that differ by less are equal.
NOISE = 1e-9


#: Words that say of something that it is not under a licence, and what ends their sentence.
_DENIED = re.compile(r"\b(?:not|never|isn['’]t|aren['’]t|wasn['’]t|no longer)\s+(?:\w+\s+)?(?:licen[sc]ed|released|distributed|available|published|covered)\b", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?](?=\s|$)|\n|$")


def granting(text: str) -> str:
    """The text with spaces for the sentences that deny a licence, from the last end of a sentence or line before the denial on."""
    out, at = [], 0
    for m in _DENIED.finditer(text):
        if m.start() < at:
            continue
        begin = max(at, *(text.rfind(c, at, m.start()) + 1 for c in ".!?\n"))
        end = _SENTENCE_END.search(text, m.end()).start()
        out += [text[at:begin], " " * (end - begin)]
        at = end
    return "".join([*out, text[at:]]) if out else text


#: Licences by their identifiers, lower-cased; in names of the GNU family also by a letter v and without hyphens.
IDENTIFIERS = {i.lower(): i for i in [*ALL_TEMPLATES]}
_TAG = re.compile(r"(?:spdx-license-identifier|\blicen[sc]e)[ \t]*[:=][ \t]*([^\n]{1,300})", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
_GNU_NAME = re.compile(r"([al]?gpl|gfdl)-?v?([0-9](?:\.[0-9])?)")


def identified(name: str) -> str | None:
    """The licence of an identifier as it stands after a licence tag: of any case, with or without -only, -or-later or +."""
    low = re.sub(r"(?:-only|-or-later|\+)$", "", name.lower().rstrip(".,;"))
    low = re.sub(r"(?:-only|-or-later|\+)$", "", low)
    if low in IDENTIFIERS:
        return IDENTIFIERS[low]
    gnu = _GNU_NAME.fullmatch(low)
    return IDENTIFIERS.get(f"{gnu[1]}-{gnu[2] if '.' in gnu[2] else gnu[2] + '.0'}") if gnu else None


def tagged(text: str) -> str | None:
    """The licences that the text's first tag with a known identifier names, as an expression: `MIT OR Apache-2.0`. Names are taken up to the
    first word that is neither an identifier nor OR, AND or WITH and what follows it."""
    for m in _TAG.finditer(text):
        out: list[str] = []
        joint = None
        for word in _NAME.findall(m[1].replace("/", " OR ")):
            if word.upper() in ("OR", "AND", "WITH"):
                joint = word.upper()
            elif joint == "WITH":
                joint = None  # an exception to the licence before it
            elif (known := identified(word)) and (joint or not out):
                out += [joint, known] if out else [known]
                joint = None
            else:
                break
        if out:
            return " ".join(out)
    return None


def terms(text: str) -> Counter:
    """Words and word pairs."""
    w = _TERM.findall(text.lower())
    return Counter(w) + Counter(f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True))


class Matcher:
    """TF-IDF vectors of the templates; document frequencies are those of the templates."""

    def __init__(self, templates: dict[str, list[str]] | None = None):
        rows = [(name, terms(t)) for name, ts in (templates or ALL_TEMPLATES).items() for t in ts]
        df = Counter(t for _, c in rows for t in c)
        self.idf = {t: math.log(1 + len(rows) / n) for t, n in df.items()}
        self.unknown = math.log(1 + len(rows))
        self.names = [name for name, _ in rows]
        self.vectors = [self._unit(c) for _, c in rows]
        self.having: dict[str, list[tuple[int, float]]] = {}
        for k, u in enumerate(self.vectors):
            for t, x in u.items():
                self.having.setdefault(t, []).append((k, x))

    def _unit(self, c: Counter) -> dict[str, float]:
        v = {t: n * self.idf.get(t, self.unknown) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def best(self, text: str) -> tuple[float, str]:
        """(cosine, licence) of the nearest template; the first of equally near ones."""
        scores = [0.0] * len(self.vectors)
        for t, y in self._unit(terms(text)).items():
            for k, x in self.having.get(t, ()):
                scores[k] += x * y
        k = int(np.argmax(scores))
        return scores[k], self.names[k]


_ANCHOR = re.compile("|".join(a.decode() for a in ANCHORS))


def blocks(text: str) -> list[str]:
    """Lines with a licence word, each with up to two lines after it as longer blocks."""
    lines = text.split("\n")
    out = []
    for i, line in enumerate(lines):
        low = line.lower().encode()
        if any(a in low for a in ANCHORS):
            out += [line, *(" ".join(lines[i : i + k]) for k in (2, 3) if i + k <= len(lines))]
    return out


class _Windows:
    """The best window of words around licence words, by running sums: for each template length and each place of a licence word in it
    the cosine with every template, without a text for each window."""

    def __init__(self, own: Matcher):
        self.own = own
        self.known = {t: k for k, t in enumerate(own.idf)}
        self.names = own.names
        self.weight = np.zeros((len(self.known), len(own.vectors)))
        for j, v in enumerate(own.vectors):
            for t, x in v.items():
                self.weight[self.known[t], j] = x * own.idf[t]
        self.lengths = np.unique([len(_TERM.findall(t.lower())) for ts in ALL_TEMPLATES.values() for t in ts])

    def best(self, text: str) -> tuple[float, str]:
        low = text.lower()
        at = [(m.start(), m.end()) for m in _TERM.finditer(low)]
        if not at:
            return 0.0, ""
        words = [low[a:b] for a, b in at]
        starts = np.array([a for a, _ in at])
        anchors = np.unique(np.maximum(np.searchsorted(starts, [m.start() for m in _ANCHOR.finditer(low)], side="right") - 1, 0))
        most, name = 0.0, ""
        longest = int(self.lengths.max())
        # stretches of words that licence words reach, each looked at once
        cut = np.flatnonzero(np.diff(anchors, prepend=-(10**9)) > 2 * longest)
        for g, lo in enumerate(cut.tolist()):
            hi = cut[g + 1] if g + 1 < len(cut) else len(anchors)
            for c in range(lo, hi, 200):  # so many at once that sums stay small
                score, k = self._stretch(words, anchors[c : min(hi, c + 200)], longest)
                if score > most:
                    most, name = score, self.names[k]
        return most, name

    def _stretch(self, words: list[str], anchors: np.ndarray, longest: int) -> tuple[float, int]:
        first, last = max(0, int(anchors[0]) - longest), min(len(words), int(anchors[-1]) + longest)
        w = words[first:last]
        one = np.array([self.known.get(x, -1) for x in w])
        two = np.array([self.known.get(f"{a} {b}", -1) for a, b in zip(w[:-1], w[1:], strict=True)], np.int64)
        rows = np.zeros((2, len(w) + 1, self.weight.shape[1]))
        for part, ids in zip(rows, (one, two), strict=True):
            part[1 : len(ids) + 1][ids >= 0] = self.weight[ids[ids >= 0]]
            np.cumsum(part, axis=0, out=part)
        near = np.zeros(len(w) + 1, np.int64)
        near[anchors - first + 1] = 1
        near = np.cumsum(near)
        best = (0.0, 0)
        for n in self.lengths[self.lengths <= len(w)].tolist()[::-1]:  # of windows that fit equally well the longest counts
            start = np.flatnonzero(near[n:] > near[:-n])
            if not len(start):
                continue
            dot = rows[0][start + n] - rows[0][start] + (rows[1][start + n - 1] - rows[1][start])
            # a vector of n words and n - 1 pairs has at least this norm, so only windows that may reach LEAST are counted out
            upper = dot.max(1) / self._least_norm(one, two, start, n)
            for i in np.argsort(-upper).tolist():
                if upper[i] < max(LEAST, best[0]):
                    break
                score, name = self.own.best(" ".join(w[start[i] : start[i] + n]))
                if score > best[0] + NOISE:
                    best = (score, self.names.index(name))
        return best

    def _least_norm(self, one: np.ndarray, two: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """At most the norms of the windows: as if no term came twice."""
        idf = np.array([*self.own.idf.values(), self.own.unknown])
        total = [np.concatenate([[0.0], np.cumsum(idf[ids] ** 2)]) for ids in (one, two)]
        return np.sqrt(total[0][start + n] - total[0][start] + total[1][start + n - 1] - total[1][start])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Matcher()
    windows = _Windows(own)
    cache: dict[str, tuple[float, str]] = {}
    for part, column in slices(batches, "text"):
        buf, off = buffers(column)
        low = LOWER[buf].tobytes()
        found: list[tuple[float, str] | None] = [None] * len(column)
        some = set()
        for anchor in ANCHORS:
            at = low.find(anchor)
            while at >= 0:
                k = int(np.searchsorted(off, at, side="right")) - 1
                some.add(k)
                at = low.find(anchor, int(off[k + 1]))
        for k in sorted(some):
            best = (0.0, "")
            text = granting(column[k].as_py())
            if exact := tagged(text):  # an identifier's own name decides
                found[k] = (1.0, exact)
                continue
            for block in blocks(text):
                if block not in cache:
                    if len(cache) > 10_000:
                        cache.clear()
                    cache[block] = own.best(block)
                if cache[block][0] > best[0]:
                    best = cache[block]
            # windows decide if they fit better than whole lines
            if best[0] < 1 - NOISE and (inner := windows.best(text))[0] > best[0] + NOISE:
                best = inner
            if best[0] >= LEAST:
                found[k] = best
        yield pa.record_batch([part.column("doc_id"), part.column("path"), pa.array([f and f[1] for f in found], pa.string()), pa.array([f and f[0] for f in found], pa.float64())], names=["doc_id", "path", "license", "score"])


#: Directories up to which their licences are broadcast to the files; beyond it the same join shuffles.
BROADCAST_DIRECTORIES = 100_000


def license_scan(files: DataFrame, license_names: tuple[str, ...] = ("LICENSE", "LICENCE", "COPYING")) -> DataFrame:
    """A row per row of files (doc_id, path, text): doc_id, path, license (its own, null if none), score (cosine of its best block),
    inherited_from (directory of the licence file that decides, null if its own or none does) and effective (its own or inherited).

    license is an expression where a tag names several: `MIT OR Apache-2.0`. A known identifier after a tag (SPDX-License-Identifier or
    License) decides; it scores 1.

    A licence file is one whose name (before a dot, in any case) is in license_names; of several in a directory the highest score
    decides, then the least path. Null texts and texts without licence words have no licence of their own; a null path has no
    directory and inherits nothing; the root directory is the empty path. Repeated rows get equal results; an empty table gives an
    empty table.
    """
    scanned = stored(files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "text").mapInArrow(_scan, "doc_id long, path string, license string, score double"))
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    name = F.upper(F.regexp_replace(F.regexp_extract("path", r"[^/]*$", 0), r"\..*$", ""))
    given = scanned.where("license is not null and path is not null").where(name.isin(*license_names)).groupBy(directory.alias("above")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("g"))
    given = stored(given.select("above", F.col("g.license").alias("inherited")))
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    dirs = scanned.where("path is not null").select(directory.alias("dir")).distinct().select("dir", F.posexplode(above).alias("depth", "above"))
    nearest = stored(dirs.join(given, "above").groupBy("dir").agg(F.max_by(F.struct("above", "inherited"), "depth").alias("near")))
    few = nearest.count() <= BROADCAST_DIRECTORIES
    out = scanned.withColumn("dir", directory).join(F.broadcast(nearest) if few else nearest, "dir", "left")
    own = F.col("license").isNull()
    return out.select("doc_id", "path", "license", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(own, F.col("near.above")).alias("inherited_from"), F.coalesce("license", "near.inherited").alias("effective"))


def document_paths(doc_id: Column, source: Column, lang: Column) -> Column:
    """A file tree for documents: source/lang/shelf/id.txt, a thousand ids a shelf. Ids divisible by 100 are their shelf's licence files,
    by 1,000 their language's and by 10,000 their source's."""
    source, lang = F.coalesce(source, F.lit("none")), F.coalesce(lang, F.lit("none"))
    shelf = F.floor(doc_id / 1000).cast("string")
    id_ = doc_id.cast("string")
    name = F.concat(F.lit("LICENSE."), id_)
    return F.when(doc_id % 10000 == 0, F.concat_ws("/", source, name)).when(doc_id % 1000 == 0, F.concat_ws("/", source, lang, name)).when(doc_id % 100 == 0, F.concat_ws("/", source, lang, shelf, name)).otherwise(F.concat_ws("/", source, lang, shelf, F.concat(id_, F.lit(".txt"))))
