"""License scans by sentence rules, in DataFrame expressions alone.

A text becomes its words of ASCII letters and digits in lower case, so line breaks, comment
marks and punctuation vanish and a wrapped license reads like one on a single line. Known
license sentences, short notices (released under ...) and SPDX tags are found in it, from
left to right and the longest at each place, and mapped to identifiers; each document's
sequence of identifiers is then matched against license rules, which are ordered
identifier sequences. A rule whose sequence is part of a longer matched rule's sequence
is not reported beside it unless it occurs elsewhere too. Everything happens within a row:
no shuffle, no join, so neither hot sources nor copies matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known sentences of licenses, by identifier.
SENTENCES = {
    "apache_title": "Apache License Version 2.0, January 2004",
    "apache_terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache_2": "you may not use this file except in compliance with the License.",
    "apache_3": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache_3s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache_4": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache_5": "See the License for the specific language governing permissions and limitations under the License.",
    "apache11": 'The end-user documentation included with the redistribution, if any, must include the following acknowledgment: "This product includes software developed by the Apache Software Foundation',
    "mit_1": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit0_1": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "mit_2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_3": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit_4": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "json_1": "The Software shall be used for Good, not Evil.",
    "ncsa_1": "to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "isc_1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc_1b": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd0_1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "postgres_1": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "hpnd_1": "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies, and that both that copyright notice and this permission notice appear in supporting documentation",
    "zlib_1": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_2": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib_3": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib_4": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib_5": "This notice may not be removed or altered from any source distribution.",
    "boost_1": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "gpl_2": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl_2b": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl_3": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_4": "See the GNU General Public License for more details.",
    "lgpl_4": "See the GNU Lesser General Public License for more details.",
    "agpl_4": "See the GNU Affero General Public License for more details.",
    "gpl2_title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3_title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl20_title": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl21_title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3_title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3_title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gfdl12_title": "GNU Free Documentation License Version 1.2, November 2002",
    "gfdl13_title": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "bsd_1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_ad": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "mpl_1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl_2": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl_title": "Mozilla Public License Version 2.0 1. Definitions",
    "mpl11_1": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "epl1_title": "Eclipse Public License - v 1.0",
    "epl2_title": "Eclipse Public License - v 2.0",
    "cddl10_title": "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",
    "cddl11_title": "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.1",
    "cc0_title": "CC0 1.0 Universal",
    "cc0_1": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work",
    "unlicense_1": "This is free and unencumbered software released into the public domain.",
    "unlicense_2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl_1": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "beer_1": "As long as you retain this notice you can do whatever you want with this stuff.",
    "artistic2_title": "The Artistic License 2.0",
    "ofl_title": "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
    "eupl12_title": "European Union Public Licence v. 1.2",
    "mspl_title": "Microsoft Public License (Ms-PL)",
    "msrl_title": "Microsoft Reciprocal License (Ms-RL)",
    "osl3_title": 'Open Software License ("OSL") v. 3.0',
    "afl3_title": 'Academic Free License ("AFL") v. 3.0',
    "upl_title": "The Universal Permissive License (UPL), Version 1.0",
    "blueoak_title": "Blue Oak Model License Version 1.0.0",
    "mulan_title": "Mulan Permissive Software License, Version 2",
    "sspl_title": "Server Side Public License VERSION 1, OCTOBER 16, 2018",
    "psf_title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    "php_title": "The PHP License, version 3.01",
    "openssl_1": "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit",
    "vim_1": "Vim is Charityware. You can use and copy it as much as you like",
    "odbl_title": "ODC Open Database License (ODbL)",
    "pddl_title": "ODC Public Domain Dedication and Licence (PDDL)",
    "reserved": "All rights reserved.",
}

#: Names by which a license is called in notices and tags. A name may be
#: followed by the word license. The first is that of its SPDX tag.
NAMES = {
    "0BSD": ["0bsd", "zero clause bsd"],
    "AFL-3.0": ["afl 3 0", "academic free license 3 0"],
    "AGPL-3.0": ["agpl 3 0", "agpl v3", "agplv3", "agpl 3", "gnu agpl v3", "gnu affero general public license version 3", "gnu affero general public license v3 0", "gnu affero general public license v3"],
    "Apache-1.1": ["apache 1 1", "apache software license version 1 1"],
    "Apache-2.0": ["apache 2 0", "apache 2", "apache license 2 0", "apache license version 2 0", "apache license version 2", "apache license v2 0", "apache license v2", "apache v2", "apache software license 2 0"],
    "Artistic-1.0": ["artistic 1 0", "artistic license 1 0"],
    "Artistic-2.0": ["artistic 2 0", "artistic license 2 0", "artistic license version 2 0"],
    "BSD": ["bsd"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "two clause bsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "modified bsd", "new bsd", "revised bsd", "three clause bsd"],
    "BSD-4-Clause": ["bsd 4 clause", "4 clause bsd", "original bsd"],
    "BSL-1.0": ["bsl 1 0", "boost software license version 1 0", "boost software license 1 0", "boost software license"],
    "BUSL-1.1": ["busl 1 1", "business source license 1 1"],
    "BlueOak-1.0.0": ["blueoak 1 0 0", "blue oak model license 1 0 0"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0", "creative commons attribution 3 0 unported"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0", "creative commons attribution 4 0 international"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0 unported", "creative commons attribution sharealike 3 0"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international", "creative commons attribution sharealike 4 0"],
    "CC0-1.0": ["cc0 1 0", "cc0", "cc0 1 0 universal"],
    "CDDL-1.0": ["cddl 1 0", "cddl", "common development and distribution license"],
    "CDDL-1.1": ["cddl 1 1"],
    "CPL-1.0": ["cpl 1 0", "common public license version 1 0"],
    "ECL-2.0": ["ecl 2 0", "educational community license version 2 0"],
    "EPL-1.0": ["epl 1 0", "eclipse public license v1 0", "eclipse public license 1 0"],
    "EPL-2.0": ["epl 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "eclipse public license v 2 0"],
    "EUPL-1.2": ["eupl 1 2", "eupl version 1 2", "eupl v1 2", "eupl"],
    "GFDL-1.2": ["gfdl 1 2", "gnu free documentation license version 1 2"],
    "GFDL-1.3": ["gfdl 1 3", "gnu free documentation license version 1 3"],
    "GPL": ["gpl", "gnu gpl", "gnu general public license"],
    "GPL-2.0": ["gpl 2 0", "gpl v2", "gplv2", "gpl 2", "gpl version 2", "gnu gpl v2", "gnu gpl version 2", "gnu general public license version 2", "gnu general public license v2 0", "gnu general public license v2"],
    "GPL-3.0": ["gpl 3 0", "gpl v3", "gplv3", "gpl 3", "gpl version 3", "gnu gpl v3", "gnu gpl version 3", "gnu general public license version 3", "gnu general public license v3 0", "gnu general public license v3"],
    "ISC": ["isc"],
    "JSON": ["json license"],
    "LGPL": ["lgpl", "gnu lgpl", "gnu lesser general public license"],
    "LGPL-2.0": ["lgpl 2 0", "gnu library general public license version 2"],
    "LGPL-2.1": ["lgpl 2 1", "lgpl v2 1", "lgplv2 1", "gnu lgpl v2 1", "gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"],
    "LGPL-3.0": ["lgpl 3 0", "lgpl v3", "lgplv3", "gnu lgpl v3", "gnu lesser general public license version 3", "gnu lesser general public license v3 0", "gnu lesser general public license v3"],
    "MIT": ["mit", "mit x11", "expat"],
    "MIT-0": ["mit 0", "mit no attribution"],
    "MPL-1.1": ["mpl 1 1", "mozilla public license version 1 1", "mozilla public license 1 1"],
    "MPL-2.0": ["mpl 2 0", "mpl v2 0", "mpl v2", "mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license v2 0", "mozilla public license 2 0"],
    "MS-PL": ["ms pl", "microsoft public license"],
    "MS-RL": ["ms rl", "microsoft reciprocal license"],
    "MulanPSL-2.0": ["mulanpsl 2 0", "mulan psl v2"],
    "NCSA": ["ncsa", "university of illinois ncsa open source license"],
    "ODC-By-1.0": ["odc by 1 0", "open data commons attribution license"],
    "ODbL-1.0": ["odbl 1 0", "odbl", "open database license"],
    "OFL-1.1": ["ofl 1 1", "sil open font license version 1 1", "sil open font license 1 1", "sil open font license"],
    "OSL-3.0": ["osl 3 0", "open software license version 3 0", "open software license 3 0"],
    "OpenSSL": ["openssl"],
    "PDDL-1.0": ["pddl 1 0"],
    "PHP-3.01": ["php 3 01", "php license version 3 01"],
    "PSF-2.0": ["psf 2 0", "python software foundation license version 2", "psf license"],
    "PostgreSQL": ["postgresql"],
    "QPL-1.0": ["qpl 1 0", "q public license version 1 0"],
    "Ruby": ["ruby license"],
    "SSPL-1.0": ["sspl 1 0", "server side public license version 1", "sspl"],
    "UPL-1.0": ["upl 1 0", "universal permissive license version 1 0", "universal permissive license v 1 0"],
    "Unlicense": ["unlicense"],
    "Vim": ["vim license"],
    "W3C": ["w3c", "w3c software notice and license"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public license"],
    "X11": ["x11"],
    "Zlib": ["zlib", "zlib libpng"],
}

#: License -> its sequences of sentence identifiers.
RULES = {
    "Apache-1.1": ["bsd_1,bsd_2,bsd_3,apache11", "apache11"],
    "Apache-2.0": ["=Apache-2.0,apache_2,apache_3,apache_4,apache_5", "=Apache-2.0,apache_2,apache_3s,apache_4,apache_5", "=Apache-2.0,apache_2", "apache_title,apache_terms"],
    "MIT": ["mit_1,mit_2,mit_3,mit_4", "mit_1,mit_2,mit_3", "mit_1,mit_2"],
    "MIT-0": ["mit0_1,mit_3,mit_4", "mit0_1,mit_3"],
    "JSON": ["mit_1,mit_2,json_1,mit_3,mit_4", "mit_1,mit_2,json_1"],
    "X11": ["mit_1,mit_2,mit_3,mit_4,x11_1", "mit_1,mit_2,mit_3,x11_1", "x11_1"],
    "NCSA": ["ncsa_1,bsd_2,bsd_3", "ncsa_1"],
    "ISC": ["isc_1", "isc_1b"],
    "0BSD": ["bsd0_1"],
    "PostgreSQL": ["postgres_1"],
    "HPND": ["hpnd_1"],
    "Zlib": ["zlib_1,zlib_2,zlib_3,zlib_4,zlib_5", "zlib_1,zlib_2,zlib_3"],
    "BSL-1.0": ["boost_1,mit_3", "boost_1"],
    "GPL-2.0": ["gpl2_title", "gpl_2.0,gpl_2,gpl_3,gpl_4", "gpl_2.0"],
    "GPL-3.0": ["gpl3_title", "gpl_3.0,gpl_2,gpl_3,gpl_4", "gpl_3.0"],
    "LGPL-2.0": ["lgpl20_title"],
    "LGPL-2.1": ["lgpl21_title", "lgpl_2.1,gpl_2b,gpl_3,lgpl_4", "lgpl_2.1,gpl_2,gpl_3,lgpl_4", "lgpl_2.1"],
    "LGPL-3.0": ["lgpl3_title", "lgpl_3.0,gpl_2b,gpl_3,lgpl_4", "lgpl_3.0,gpl_2,gpl_3,lgpl_4", "lgpl_3.0"],
    "AGPL-3.0": ["agpl3_title", "agpl_3.0,gpl_2,gpl_3,agpl_4", "agpl_3.0"],
    "GFDL-1.2": ["gfdl12_title"],
    "GFDL-1.3": ["gfdl13_title"],
    "BSD-4-Clause": ["bsd_1,bsd_2,bsd_3,bsd_ad,bsd_4", "bsd_1,bsd_2,bsd_3,bsd_ad", "bsd_1,bsd_2,bsd_ad,bsd_3"],
    "BSD-3-Clause": ["bsd_1,bsd_2,bsd_3,bsd_4", "bsd_1,bsd_2,bsd_3,bsd_4b", "bsd_1,bsd_2,bsd_3,bsd_4c"],
    "BSD-2-Clause": ["bsd_1,bsd_2,bsd_3"],
    "MPL-1.1": ["mpl11_1"],
    "MPL-2.0": ["mpl_1,mpl_2", "mpl_1", "mpl_title"],
    "EPL-1.0": ["epl1_title"],
    "EPL-2.0": ["epl2_title"],
    "CDDL-1.0": ["cddl10_title"],
    "CDDL-1.1": ["cddl11_title"],
    "CC0-1.0": ["cc0_title", "cc0_1"],
    "Unlicense": ["unlicense_1,unlicense_2", "unlicense_1"],
    "WTFPL": ["wtfpl_1"],
    "Beerware": ["beer_1"],
    "Artistic-2.0": ["artistic2_title"],
    "OFL-1.1": ["ofl_title"],
    "EUPL-1.2": ["eupl12_title"],
    "MS-PL": ["mspl_title"],
    "MS-RL": ["msrl_title"],
    "OSL-3.0": ["osl3_title"],
    "AFL-3.0": ["afl3_title"],
    "UPL-1.0": ["upl_title"],
    "BlueOak-1.0.0": ["blueoak_title"],
    "MulanPSL-2.0": ["mulan_title"],
    "SSPL-1.0": ["sspl_title"],
    "PSF-2.0": ["psf_title"],
    "PHP-3.01": ["php_title"],
    "OpenSSL": ["openssl_1"],
    "Vim": ["vim_1"],
    "ODbL-1.0": ["odbl_title"],
    "PDDL-1.0": ["pddl_title"],
    "all rights reserved": ["reserved"],
}

#: How notices begin, between that and the name, and what may follow a name.
VERBS = ["licensed", "licenced", "released", "distributed", "available", "published", "provided", "offered", "covered", "redistributed"]
BETWEEN = ["under", "under the", "under a", "under an", "under the terms of", "under the terms of the", "under the terms and conditions of the", "under the conditions of the", "under either", "under either of", "under either the", "under either of the"]
#: Beginnings after which a name counts only with the word license.
NAMED = ["uses the", "use the", "using the", *(f"{v} by the" for v in VERBS)]
#: Sentences with the name of a holder in them, as what stands before and after it, by identifier.
HOLDERS = {
    "bsd_4": ("neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd_4c": ("neither the names of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd_4b": ("the name of", "may not be used to endorse or promote products derived from this software without specific prior written permission"),
    "x11_1": ("except as contained in this notice the name of", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
}
#: Words that a holder's name has at most.
_HOLDER = 20
AFTER = ["", "license", "licence"]
TAG = "spdx license identifier"
TAG_AFTER = ["", "only", "or later"]
#: What "license:" and its like become, so that it differs from the word license before a name.
COLON = "licensecolon"
#: Words between the names of a list.
AND = ["or", "and", "and or", "or the", "and the"]

#: Every known sentence, notice and tag has a match of this in the text; texts without any need no look.
ANCHORS = r"licen|permission|copyright|software|warrant|reserved|spdx|universal|charityware|redistribut|acknowledgement|mpl\W+was|to\W+deal|terms\W+and|do\W+what|this\W+notice|(?:released|distributed|available|published|provided|offered|covered)\W+(?:under|by)"


def _squeeze(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def _gnu() -> dict[str, str]:
    """The notices of the GNU licenses: kinds of work times licenses times versions."""
    out = {}
    licenses = {"gpl": ("GNU General Public License", ["2", "3"]), "lgpl": ("GNU Lesser General Public License", ["2.1", "3"]), "agpl": ("GNU Affero General Public License", ["3"])}
    for short, (name, versions) in licenses.items():
        for v in versions:
            for work in ("program", "library", "software", "file"):
                head = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name}"
                to = f"{short}_{v if '.' in v else v + '.0'}"
                out[_squeeze(f"{head} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version")] = to
                out[_squeeze(f"{head} as published by the Free Software Foundation, either version {v}, or (at your option) any later version")] = to
                out[_squeeze(f"{head} as published by the Free Software Foundation, version {v}")] = to
                out[_squeeze(f"{head} as published by the Free Software Foundation; only version {v}")] = to
                out[_squeeze(f"{head} version {v} as published by the Free Software Foundation")] = to
    return out


def known() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    return {_squeeze(s): name for name, s in SENTENCES.items()} | _gnu()


def _trie(phrases: list[str]) -> str:
    """A pattern of phrases that takes the longest: shared words are tried once."""
    by: dict[str, list[str]] = {}
    for p in phrases:
        head, _, rest = p.partition(" ")
        by.setdefault(head, []).append(rest)
    parts = []
    for head in sorted(by, key=lambda h: (-len(h), h)):
        rest = [r for r in by[head] if r]
        tail = f"(?: {_trie(rest)})" if rest else ""
        parts.append(head + (f"{tail}?" if tail and "" in by[head] else tail))
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _names() -> dict[str, str]:
    return {n: to for to, names in NAMES.items() for n in names}


def _licensed() -> list[str]:
    """Names that have the word license in them."""
    return [n for n in _names() if re.search("licen[sc]e", n)]


_NAME = f"{_trie(list(_names()))}(?: licen[sc]e)?"
_NOTICE = rf"(?:{_trie(VERBS)} {_trie(BETWEEN)}|{COLON}) "
_BY = rf"{_trie(NAMED)} "
_MORE = rf"(?: {_trie(AND)} {_NAME})*"
_GAPS = "|".join(rf"{a} (?:[a-z0-9]+ ){{1,{_HOLDER}}}?{b}" for a, b in HOLDERS.values())
_PATTERN = rf"(?<![a-z0-9])(?:{_trie(list(known()))}|{_GAPS}|{_NOTICE}{_NAME}{_MORE}|{_BY}(?:{_trie(list(_names()))} licen[sc]e|{_trie(_licensed())}){_MORE}|{TAG} {_trie([names[0] for names in NAMES.values()])}(?: only| or later)?)(?![a-z0-9])"


def words(text: Column) -> Column:
    """A text's words of ASCII letters and digits, lower case, joined by one space. In SPDX tags
    each license of an expression gets a tag of its own."""
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tag = "spdx-license-identifier:"

    def line(x: Column) -> Column:
        at = F.instr(x, tag)
        return F.when(at > 0, F.concat(F.left(x, at), F.regexp_replace(F.substring(x, at + 1, F.length(x)), r" (?:or|and) ", f" {tag} "))).otherwise(x)

    # license: X, "license": "X"
    folded = F.when(F.contains(folded, F.lit("licen")), F.regexp_replace(folded, r"\blicen[sc]es?\x22?[ \t]*[:=][ \t]*\x22?", f" {COLON} ")).otherwise(folded)
    tagged = F.when(F.contains(folded, F.lit(tag)), F.array_join(F.transform(F.split(folded, "\n"), line), "\n")).otherwise(folded)
    return F.trim(F.regexp_replace(tagged, "[^a-z0-9]+", " "))


def _rules() -> list[tuple[str, str]]:
    """(sequence, license), longest sequences first, then by name."""
    flat = [(seq, name) for name, seqs in RULES.items() for seq in seqs]
    return sorted(flat, key=lambda x: (-x[0].count(","), x[1], x[0]))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def scan(documents: DataFrame) -> DataFrame:
    """`documents` with `license_sentences` (identifiers in order; a notice or tag is = and the
    license) and `licenses` (sorted array of names without repeats; empty where there is none,
    for null and empty texts too).

    Sentences may be wrapped, in comments or within other sentences. Of sentences that start at
    one place the longest counts, and what it covers is not looked at again, so a shorter
    sentence or notice inside it does not count. Very long texts are read as a whole. Columns of
    these names are replaced, others pass through; repeated rows give equal results, and an
    empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    hits = F.regexp_extract_all(words(text), F.lit(f"({_PATTERN})"), 1)
    lead = rf"^(?:{_NOTICE}|{_BY}|{TAG} )"
    bare = lambda s: F.regexp_replace(s, "(?<=.) (?:licen[sc]e|only|or later)$", "")
    sentences, names = _map(known()), _map({n: f"={to}" for n, to in _names().items()})
    name = lambda s: F.coalesce(names[s], names[bare(s)])
    # a list is cut before each word between names behind which another name stands
    several = lambda s: F.transform(F.split(F.regexp_replace(s, rf" {_trie(AND)} (?={_NAME}(?: {_trie(AND)} |$))", ";"), ";"), name)
    notice = lambda s: F.when(name(s).isNotNull(), F.array(name(s))).otherwise(F.filter(several(s), lambda x: x.isNotNull()))
    holder = F.lit(None).cast("string")
    gap = lambda s: F.coalesce(*[F.when(s.startswith(f"{a} ") & s.endswith(f" {b}"), F.lit(k)) for k, (a, b) in HOLDERS.items()], holder)
    to = lambda s: F.when(sentences[s].isNotNull(), F.array(sentences[s])).when(gap(s).isNotNull(), F.array(gap(s))).otherwise(notice(F.regexp_replace(s, lead, "")))
    found = F.when(text.rlike(f"(?i){ANCHORS}"), F.flatten(F.transform(hits, to))).otherwise(F.array().cast("array<string>"))
    out = documents.withColumn("license_sentences", found)
    # Each rule in turn takes its sequences out of the row's identifiers and leaves its name.
    rest = F.concat(F.lit(";"), F.array_join("license_sentences", ";;"), F.lit(";"))
    for seq, name in _rules():
        rest = F.replace(rest, F.lit(f";{seq.replace(',', ';;')};"), F.lit(f"<{name}>"))
    rest = F.regexp_replace(rest, ";=([^;]+);", "<$1>")
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(rest, F.lit("<([^>]+)>"), 1)))
    return out.withColumn("licenses", F.when(F.size("license_sentences") > 0, names).otherwise(F.array().cast("array<string>")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License sentences and licenses of all documents."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.size("license_sentences").cast("long").alias("n_sentences"), F.array_join("license_sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    """Words are listed and compared with known sentences at each place; sentences inside longer
    ones go."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda rows: ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    rest = "';' || ids || ';'"
    for seq, name in _rules():
        rest = f"replace({rest}, {quote(';' + seq.replace(',', ';;') + ';')}, {quote('<' + name + '>')})"
    return rf"""
WITH RECURSIVE names(n, id) AS (VALUES {values((n, '=' + to) for n, to in _names().items())}),
tags(n, id) AS (VALUES {values((names[0], '=' + to) for to, names in NAMES.items())}),
lead AS (
  SELECT v || ' ' || b AS p, false AS must FROM (VALUES {values((v,) for v in VERBS)}) v(v), (VALUES {values((b,) for b in BETWEEN)}) b(b)
  UNION ALL SELECT '{COLON}', false UNION ALL SELECT p, true FROM (VALUES {values((v,) for v in NAMED)}) n(p)),
called AS (SELECT DISTINCT n || a AS s, id, len(string_split(n || a, ' ')) AS k FROM names, (VALUES {values((f' {a}' if a else '',) for a in AFTER)}) a(a)),
known AS (
  SELECT s, id, 0 AS lead FROM (VALUES {values(known().items())}) k(s, id)
  UNION ALL SELECT p || ' ' || s, id, 1 FROM lead, called WHERE NOT must OR regexp_matches(s, 'licen[sc]e')
  UNION ALL SELECT '{TAG} ' || n || a, id, 0 FROM tags, (VALUES {values((f' {a}' if a else '',) for a in TAG_AFTER)}) a(a)),
sized AS (SELECT s, min(id) AS id, max(lead) AS lead, len(string_split(s, ' ')) AS k, split_part(s, ' ', 1) AS first, split_part(s, ' ', 2) AS second FROM known GROUP BY s),
holder(id, a, b) AS (VALUES {values((k, a, b) for k, (a, b) in HOLDERS.items())}),
d AS (SELECT row_number() OVER () AS ord, doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\blicen[sc]es?"?[ \t]*[:=][ \t]*"?', ' {COLON} ', 'g') AS text FROM documents),
line AS (SELECT ord, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS i FROM (SELECT ord, string_split(text, chr(10)) AS p FROM d)),
tagged AS (
  SELECT ord, i, CASE WHEN contains(x, 'spdx-license-identifier:') THEN left(x, instr(x, 'spdx-license-identifier:')) || regexp_replace(substr(x, instr(x, 'spdx-license-identifier:') + 1), ' (or|and) ', ' spdx-license-identifier: ', 'g') ELSE x END AS x FROM line),
w AS (SELECT ord, flatten(list(regexp_extract_all(x, '[a-z0-9]+') ORDER BY i)) AS w FROM tagged GROUP BY ord),
spot AS (SELECT ord, w, unnest(range(1, len(w) + 1)) AS i FROM w),
plain AS (SELECT ord, w, i, k, id, lead FROM spot JOIN sized ON w[i] = first AND w[i + 1] = second AND array_to_string(w[i : i + k - 1], ' ') = s),
longest AS (SELECT * FROM plain a WHERE lead = 1 AND NOT EXISTS (SELECT 1 FROM plain b WHERE b.ord = a.ord AND b.i = a.i AND b.k > a.k)),
between AS (SELECT x, len(string_split(x, ' ')) AS k FROM (VALUES {values((a,) for a in AND)}) t(x)),
best AS (
  SELECT s.ord, s.i, arg_max(c.id, n.k * 100 + c.k) AS id, arg_max(n.k + c.k, n.k * 100 + c.k) AS k
  FROM (SELECT * FROM spot WHERE ord IN (SELECT ord FROM longest) AND w[i] IN ('or', 'and')) s
  JOIN between n ON array_to_string(s.w[s.i : s.i + n.k - 1], ' ') = n.x JOIN called c ON array_to_string(s.w[s.i + n.k : s.i + n.k + c.k - 1], ' ') = c.s GROUP BY s.ord, s.i),
chain AS (
  SELECT ord, i AS begun, i, k, id FROM longest
  UNION ALL SELECT c.ord, c.begun, b.i, b.k, b.id FROM chain c JOIN best b ON b.ord = c.ord AND b.i = c.i + c.k),
gap AS (
  SELECT s.ord, s.i, h.id, min(e) - s.i + len(string_split(h.b, ' ')) AS k
  FROM spot s JOIN holder h ON array_to_string(s.w[s.i : s.i + len(string_split(h.a, ' ')) - 1], ' ') = h.a,
    LATERAL (SELECT unnest(range(s.i + len(string_split(h.a, ' ')) + 1, s.i + len(string_split(h.a, ' ')) + {_HOLDER} + 1)) AS e) l
  WHERE array_to_string(s.w[e : e + len(string_split(h.b, ' ')) - 1], ' ') = h.b GROUP BY s.ord, s.i, h.id, h.b),
hit AS (
  SELECT ord, i, k, id FROM plain UNION ALL SELECT ord, i, k, id FROM gap
  UNION ALL SELECT ord, i, k, id FROM chain c WHERE i > begun),
free AS (SELECT * FROM hit a WHERE NOT EXISTS (SELECT 1 FROM hit b WHERE b.ord = a.ord AND b.k > a.k AND b.i <= a.i AND b.i + b.k >= a.i + a.k)),
seq AS (SELECT ord, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids_comma, string_agg(id, ';;' ORDER BY i) AS ids FROM free GROUP BY ord),
named AS (SELECT ord, n, ids_comma, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace({rest}, ';=([^;]+);', '<\1>', 'g'), '<([^>]+)>', 1))), ',') AS licenses FROM seq)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids_comma, '') AS sentences, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN named ON d.ord = named.ord
"""


ORACLE = _oracle()
