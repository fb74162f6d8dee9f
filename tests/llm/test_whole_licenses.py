"""Licenses as they stand in files: with stops inside, wrapped, in comments, as tags and notices."""

import re
import textwrap

import duckdb
import pandas as pd
import pytest

from sondage.llm import licenses

S = licenses.SENTENCES
NEITHER = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
NAME = "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission."
X11 = "Except as contained in this notice, the name of {} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from {}."
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
MIT = " ".join([S["mit_1"], "", S["mit_2"], S["mit_3"], S["mit_4"]])
BSD = f"Copyright (c) 2020, A. B. All rights reserved. {S['bsd_1']} 1. {S['bsd_2']} 2. {S['bsd_3']} 3. {NEITHER.format('the copyright holder')} THIS SOFTWARE IS PROVIDED BY"
APACHE = 'Copyright 2019 A. B. Licensed under the Apache License, Version 2.0 (the "License"); ' + " ".join(S[k] for k in ("apache_2", "apache_3", "apache_4", "apache_5"))


def found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: list(r["licenses"]) for r in rows}
    return [got[i] for i in range(len(texts))]


def test_whole_sentences_decide(spark):
    gpl2 = GPL.replace("software:", "software;").replace("version 3", "version 2")
    agpl = GPL.replace("GNU General", "GNU Affero General")
    texts = [GPL, gpl2, agpl, "This program is free software.", S["mpl_1"], S["mpl_1"].replace("2.0", "1.0"), f"Other words. {GPL} And more."]
    assert found(spark, texts) == [["GPL-3.0"], ["GPL-2.0"], ["AGPL-3.0"], [], ["MPL-2.0"], [], ["GPL-3.0"]]


@pytest.mark.parametrize("leader", ["", "# ", " * ", "// ", "    "])
def test_wrapped_licenses(spark, leader):
    known = [(MIT, ["MIT"]), (BSD, ["BSD-3-Clause", "all rights reserved"]), (APACHE, ["Apache-2.0"]), (GPL, ["GPL-3.0"])]
    full = S | {"bsd_4": NEITHER.format("Foo Bar, Inc."), "bsd_4b": NAME.format("the author"), "bsd_4c": NEITHER.replace("name of", "names of", 1).format("the X group and Y"), "x11_1": X11.format("Z", "Z")}
    known += [(", ".join([full[i] for i in seq.split(",")]), [name]) for name, seqs in licenses.RULES.items() for seq in seqs if not re.search(r"=|gpl_[23]|gpl_[0-9]", seq)]
    texts = [f"some words before\n{textwrap.indent(textwrap.fill(t, width), leader)}\nafter" for t, _ in known for width in (60, 76, 80)]
    assert found(spark, texts) == [want for _, want in known for _ in range(3)]


def test_tags_and_notices(spark):
    texts = [
        "// SPDX-License-Identifier: MIT\nint x;",
        "# SPDX-License-Identifier: Apache-2.0 OR GPL-2.0-or-later WITH x\nthis or mit",
        "/* SPDX-License-Identifier: (BSD-3-Clause AND ISC) */",
        "This code is released under the MIT License.",
        "It is distributed under the terms of the GNU General Public\n# License, version 2, see there",
        "licensed under MIT and apache",
        "published under the Mozilla Public License, v. 2.0!",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Released under the BSD 3-Clause License",
        "released under pressure of the MIT",
        "",
    ]
    want = [["MIT"], ["Apache-2.0", "GPL-2.0"], ["BSD-3-Clause", "ISC"], ["MIT"], ["GPL-2.0"], ["MIT"], ["MPL-2.0"], ["LGPL-2.1"], ["BSD-3-Clause"], [], []]
    assert found(spark, texts) == want


def test_every_known_sentence_has_an_anchor_and_every_rule_known_sentences():
    ids = set(licenses.known().values()) | set(licenses.HOLDERS) | {f"={x}" for x in licenses.NAMES}
    assert all(i in ids for seqs in licenses.RULES.values() for seq in seqs for i in seq.split(","))
    assert all(re.search(licenses.ANCHORS, s) for s in licenses.known())
    assert len(set(licenses.RULES) | set(licenses.NAMES)) >= 40


def test_sql_on_texts_of_all_kinds(spark):
    texts = [MIT, BSD, APACHE, GPL, f"{MIT} {BSD}", textwrap.fill(f"{APACHE} {GPL}", 70), "SPDX-License-Identifier: MIT OR ISC", "released under the MIT license or mit", "Licensed under the Apache License, Version 2.0", None, ""]
    texts += list(S.values()) + [f"{v} {b} {n} {a}" for v, b, n, a in zip(licenses.VERBS * 20, licenses.BETWEEN * 23, licenses._names(), licenses.AFTER * 67, strict=False)]
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype=object)})
    db = duckdb.connect()
    db.register("documents", frame)
    want = {r[0]: r[1:] for r in db.execute(licenses.ORACLE).fetchall()}
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (len(r["license_sentences"]), ",".join(r["license_sentences"]), ",".join(r["licenses"])) for r in rows} == want


HOLDERS = ["Google Inc.", "the University of California, Berkeley", "the University", "the copyright holder", "Sun Microsystems, Inc. or the names of contributors", "J. Random Hacker", "the Example Foundation of Testing and Quality Assurance"]


def test_holders_notices_and_what_is_no_license(spark):
    bsd = f"Copyright (c) 1999, X. {S['bsd_1']} 1. {S['bsd_2']} 2. {S['bsd_3']}"
    texts = [textwrap.fill(f"{bsd} 3. {NEITHER.format(h)} THIS SOFTWARE", 74) for h in HOLDERS] + [f"{bsd} {NAME.format(h)}" for h in HOLDERS] + [f"{MIT} {X11.format(h, h)}" for h in HOLDERS]
    want = [["BSD-3-Clause"]] * len(HOLDERS) * 2 + [["X11"]] * len(HOLDERS)
    gpl = GPL.replace("either version 3 of the License, or", "either version 2, or")
    cases = {
        bsd: ["BSD-2-Clause"],
        f"{bsd} {NEITHER.format('a ' * 30)}": ["BSD-2-Clause"],
        "published by the W3C": [], "provided by the MIT mathematics department": [], "distributed by the ISC network": [], "provided by the OpenSSL team": [],
        "It is covered by the MIT license": ["MIT"], "covered by the GNU General Public License version 3": ["GPL-3.0"],
        "This project uses the MIT license.": ["MIT"], "we use the Apache License, Version 2.0 here": ["Apache-2.0"], "it uses the MIT approach": [],
        "License: MIT": ["MIT"], 'x = {"license": "Apache-2.0", "v": 1}': ["Apache-2.0"], "licence = BSD-3-Clause": ["BSD-3-Clause"], "Licenses: MIT or ISC": ["ISC", "MIT"], "the license text": [],
        "licensed under either of Apache License, Version 2.0 or MIT license": ["Apache-2.0", "MIT"],
        "dual licensed under the MIT license and the GNU General Public License version 2": ["GPL-2.0", "MIT"],
        "released under MIT, ISC": ["MIT"],
        gpl: ["GPL-2.0"], GPL.replace("either version 3 of the License, or (at your option) any later version", "version 2"): ["GPL-2.0"],
    }
    texts += list(cases)
    want += list(cases.values())
    assert found(spark, texts) == want
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype=object)})
    db = duckdb.connect()
    db.register("documents", frame)
    assert [r[3].split(",") if r[3] else [] for r in sorted(db.execute(licenses.ORACLE).fetchall())] == want
