import re
from collections import Counter

from corpusq.llm import licenses as li

MIT = """Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""

CASES = [
    (0, None, "", "none"), (1, "", "", "none"), (2, "plain text", "", "none"),
    (3, "no stop before |\nReleased under the MIT License.", "MIT", "known"),
    (4, "Text. Licensed under the Apache License, Version 2.0. More text", "Apache-2.0", "known"),
    (5, MIT, "MIT", "known"), (6, "Copyright 2020 X. All rights reserved.", "Proprietary", "known"),
    (7, "Copyright 2020 X.\nnothing else", "", "unknown"),
    (8, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0,GPL-3.0", "known"),
    (9, "SPDX-License-Identifier: MIT", "MIT", "known"), (10, "the permission of the license was copyright", "", "none"),
    (11, "word " * 50_000 + "\nReleased under the MIT License.", "MIT", "known"), (None, "MIT License", "MIT", "known"),
    (3, "no stop before |\nReleased under the MIT License.", "MIT", "known"),
]


def test_licences(make):
    found = li.scan(make([(i, t) for i, t, _, _ in CASES])).collect()
    assert Counter((r["doc_id"], r["licenses"], r["status"]) for r in found) == Counter((i, x, s) for i, _, x, s in CASES)


def test_specific_rules_come_first_and_use_their_sentences(make):
    row = li.scan(make([(1, MIT)])).first()
    assert row["rules"] == "2" and row["sentences"] == 4


def test_rule_sentences_exist():
    for r in li.RULES:
        assert set(r.sentences) <= set(li.SENTENCES) | set(li.PATTERNS) | {f"spdx_{x}" for x in li.SPDX}


def test_empty_table(make):
    assert li.scan(make([])).collect() == []


def test_every_known_sentence_holds_a_trigger():
    trigger = re.compile(li.TRIGGERS)
    for name, value in [*li.SENTENCES.items(), *li.PATTERNS.items()]:
        assert any(trigger.search(word) for word in value.split()), name


def test_sentences_without_a_licence_word(make):
    texts = ["Text before. All rights reserved.", "x.\nAll  rights\nreserved.", "This program is free software. More", "Released into. This is free and "
             "unencumbered software released into the public\ndomain."]
    found = li.scan(make(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r["licenses"], r["status"], r["sentences"]) for r in found] == [
        ("Proprietary", "known", 1), ("Proprietary", "known", 1), ("", "unknown", 1), ("Unlicense", "known", 1)
    ]


MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""

GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""

GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""

NOTICES = {
    "MPL-2.0": MPL, "GPL-3.0": GPL3, "GPL-2.0": GPL2, "AGPL-3.0": GPL3.replace("GNU", "GNU Affero"), "Apache-2.0": APACHE, "BSD": BSD,
    "LGPL-2.1": GPL2.replace("program", "library").replace("GNU", "GNU Lesser").replace("version 2", "version 2.1"), "MIT": MIT,
}


def test_official_notices_wrapped_and_by_line(make):
    rows = []
    for licence, notice in NOTICES.items():
        by_line = "no stop before |\n" + re.sub(r"(?<!\n)\n *(?!\n)", " ", notice)  # every paragraph a line
        rows += [(licence, notice), (licence, "/*\n * " + notice.replace("\n", "\n * ") + "\n */"), (licence, by_line)]
    found = li.scan(make([(i, t) for i, (_, t) in enumerate(rows)])).orderBy("doc_id").collect()
    assert [r["licenses"] for r in found] == [x for x, _ in rows]
    assert found[15]["rules"] == "4"  # BSD: clause numbers stand between its sentences


def test_every_opening_with_every_name(make):
    names = {
        "MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "BSD-3-Clause": "BSD 3-Clause License", "ISC": "ISC License",
        "GPL-2.0": "GNU General Public License, version 2", "GPL-3.0": "GNU GPL v3.0 or later", "LGPL-3.0": "GNU Lesser General Public License v3",
        "AGPL-3.0": "AGPLv3", "MPL-2.0": "Mozilla Public License, v. 2.0", "CC0-1.0": "CC0 1.0", "CC-BY-NC-4.0": "CC BY-NC 4.0",
        "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International License",
    }
    openings = ["Licensed", "Released", "Distributed", "This work is licensed", "This project is released", "This file is licensed", "The source code is available"]
    rows = [(licence, f"Before. {o} under {the}{n}. After") for licence, n in names.items() for o in openings for the in ("", "the ", "the terms of the ")]
    found = li.scan(make([(i, t) for i, (_, t) in enumerate(rows)])).orderBy("doc_id").collect()
    wrong = [(t, r["licenses"]) for (x, t), r in zip(rows, found) if r["licenses"] != x]
    assert not wrong
    bare = ["Licensed under no license.", "Released under water.", "Licensed under the GNU General Public License.", "See v. 2 of it."]
    assert {r["licenses"] for r in li.scan(make(list(enumerate(bare)))).collect()} == {""}


COMMON = [
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
    ("This software is licensed under the MIT license, see LICENSE.", "MIT"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"),
    ("Dual work. Licensed under the MIT License or the GNU General Public License, version 3 or later.", "GPL-3.0,MIT"),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", "Apache-2.0,MIT"), ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0)", "GPL-2.0"),
    ("SPDX-License-Identifier: BSD-3-Clause AND (ISC OR Zlib)", "BSD-3-Clause,ISC,Zlib"), ("SPDX-License-Identifier: Nothing-1.0", ""),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("Released under the zlib license.", "Zlib"),
    ("This program is made available under the terms of the Eclipse Public License 2.0", "EPL-2.0"),
    ("Distributed under the Artistic License 2.0.", "Artistic-2.0"), ("Licensed under the GNU General Public License v3 or any later version.", "GPL-3.0"),
    (BSD + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products\n"
     "derived from this software without specific prior written permission.", "BSD-3-Clause"),
    ("Released under pressure or under water.", ""), ("Licensed under state law and see the rules.", ""),
]


def test_common_notices(make):
    found = li.scan(make([(i, t) for i, (t, _) in enumerate(COMMON)])).orderBy("doc_id").collect()
    wrong = [(t, r["licenses"]) for (t, x), r in zip(COMMON, found) if r["licenses"] != x]
    assert not wrong


def test_nulls_beside_clashing_names(spark):
    schema = "doc_id long, text string, licenses int, rules string, sentences string, status long"
    rows = [(None, None, 1, "r", "s", 2), (1, "MIT License", None, None, None, None), (1, None, 1, "r", None, 3)]
    found = li.scan(spark.createDataFrame(rows, schema)).collect()
    assert Counter((r["doc_id"], r["licenses"], r["status"]) for r in found) == Counter([(None, "", "none"), (1, "MIT", "known"), (1, "", "none")])
