import re

from cladeledger.llm import licenses
from cladeledger.llm.queries import QUERIES

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"""

ROWS = [
    (1, None), (2, ""), (3, MIT), (4, "Text before.\nReleased under the MIT License.\nText after."),
    (5, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0."), (6, "the MIT license is nice"),
    (7, "some line without end\nThis work is licensed under the GNU General Public License, version 3."), (7, "Released under the MIT License."),
    (7, "Released under the MIT License."), (None, "Released under the MIT License."), (8, "word " * 40_000 + "\nReleased under the MIT License."),
    (9, "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software"
        " Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT"
        " ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    (10, "Released under the MIT License.\nReleased under the MIT License."), (11, "\x01Released under the MIT License.\x01"),
]


def scan(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id int, text string, id string, ids int")
    return sorted((tuple(r) for r in licenses.scan(docs).collect()), key=str)


def test_odd_rows(spark):
    got = {(r[0], r[2], r[3]) for r in scan(spark, ROWS)}
    assert len(scan(spark, ROWS)) == len(ROWS)
    assert got == {
        (1, "", ""), (2, "", ""), (3, "mit-grant,mit-notice,mit-asis", "MIT"), (4, "mit-ref", "MIT"), (5, "apache2-ref,ccbync-ref", "Apache-2.0,CC-BY-NC-4.0"),
        (6, "", ""), (7, "gpl3-ref", "GPL-3.0"), (7, "mit-ref", "MIT"), (None, "mit-ref", "MIT"), (8, "mit-ref", "MIT"),
        (9, "gpl3-free,gpl-hope", "GPL-3.0-or-later"), (10, "mit-ref,mit-ref", "MIT"), (11, "mit-ref", "MIT"),
    }
    assert scan(spark, []) == []


def test_earlier_rules_take_their_sentences(spark):
    bsd = [licenses.SENTENCES[f"bsd-{x}"][0] for x in ("grant", "source", "binary", "endorse")]
    rows = [(1, ".\n".join(bsd) + "."), (2, ".\n".join(bsd[:3]) + "."), (3, ".\n".join(reversed(bsd)) + ".")]
    assert [(r[0], r[3]) for r in scan(spark, rows)] == [(1, "BSD-3-Clause"), (2, "BSD-2-Clause"), (3, "")]


def test_every_rule_uses_known_sentences():
    assert all(x in licenses.SENTENCES for _, run in licenses.RULES for x in run)
    assert all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s) for ws in licenses.SENTENCES.values() for s in ws)


def test_main_path_has_no_python(spark, sf):
    plan = QUERIES["op1_licence_scan"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


MIT_LINES = [
    *MIT.split("\n")[:1], "", *MIT.split("\n")[2:],
]
GPL_LINES = ["Copyright (C) 2019 Someone", "", *ROWS[11][1].split("\n")]
LGPL_LINES = [
    "Copyright 2019 Someone", "This library is free software; you can redistribute it and/or", "modify it under the terms of the GNU Lesser General Public",
    "License as published by the Free Software Foundation; either", "version 2.1 of the License, or (at your option) any later version.", "",
    "This library is distributed in the hope that it will be useful,", "but WITHOUT ANY WARRANTY; without even the implied warranty of",
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
]
STYLES = [("", "", ""), ("/*\n", " * ", "\n */\nint x;"), ("", "# ", "\nimport os"), ("", "// ", "\nint x;"), ("<!--\n", "  ", "\n-->"), ("", ";; ", ""), ("", "dnl ", ""), ("/***\r\n", " * ", "\r\n ***/")]


def test_licences_in_comments(spark):
    cases = [(MIT_LINES, "mit-grant,mit-notice,mit-asis", "MIT"), (GPL_LINES, "gpl3-free,gpl-hope", "GPL-3.0-or-later"), (LGPL_LINES, "lgpl21-free,lgpl-hope", "LGPL-2.1-or-later")]
    rows, want = [], []
    for lines, ids, names in cases:
        for before, prefix, after in STYLES:
            want.append((len(rows), ids.count(",") + 1, ids, names))
            rows.append((len(rows), before + "\n".join((prefix + x).rstrip() for x in lines) + after))
    assert sorted(scan(spark, rows), key=lambda r: r[0]) == want


def test_a_sentence_with_a_line_that_starts_with_copyright(spark):
    rows = [(1, "# Redistributions of source code must retain the above\n# copyright notice, this list of conditions and the following disclaimer.")]
    assert scan(spark, rows) == [(1, 1, "bsd-source", "")]
    rows = [(2, "*\n" * 40_000 + "* " * 40_000 + "\n\n# Released under the MIT License."), (3, "# Copyright 2020 A\n# Copyright 2021 B\n# Released under the MIT License.")]
    assert scan(spark, rows) == [(2, 1, "mit-ref", "MIT"), (3, 1, "mit-ref", "MIT")]
