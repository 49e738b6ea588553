"""Licence sentences that begin or end at a line's border, and the shortest strings of all."""

import re

from palimpsest.llm import license_rules as lr

PLANTED = [
    ("prose without a mark ***\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("/* SPDX-License-Identifier: MIT */\n#include <stdio.h>\nint main;", "MIT"),
    ("#!/bin/sh\r\n# SPDX-License-Identifier: GPL-2.0-or-later\r\nset -e\r\n", "GPL-2.0-or-later"),
    ("A title\rReleased under the MIT License\rmore", "MIT"),
    ("# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed", "MPL-2.0"),
    ("a head\nThis work is licensed under the\n  Apache License,\n  Version 2.0\nand a tail", "Apache-2.0"),
    ("head\nLicensed under the GNU General Public License, version 3\nor any later version", "GPL-3.0-or-later"),
    ("head\nLicensed under the GNU General Public License, version 3\nor (at your option) any later version", ""),
    ("Licensed under the MIT License\nLicensed under CC BY 4.0\nReleased under the MIT License", "MIT,CC-BY-4.0"),
    ("You may obtain a copy of the License at http://x/y\nLicensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("it was not Licensed under CC BY-NC 4.0 at all\nnor was this", ""),
    ("this is covered by terms as in\nlicensed under CC BY-NC 4.0 of old", ""),
]


def test_planted_lines(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PLANTED)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in lr.scan_licences(docs).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(PLANTED)] == PLANTED


def test_order_and_open_middles(spark):
    names = "Neither the name of A\nnor B\nnor C nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    texts = ["x\nReleased under the MIT License\ny\nLicensed under CC BY-NC 4.0\nz. See the GNU General Public License for more details", names,
             "Copyright 2024 A\n" * 3000 + "All rights reserved", "head\nCopyright 2024 A\nAll rights reserved\ntail"]
    got = {r.doc_id: r.sentences for r in lr.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "mit_ref,ccbync4_ref,gpl_see", 1: "bsd_names", 2: "rights", 3: "rights"}


def shortest(node):
    """The shortest string that a parsed pattern accepts, with a letter where it is open."""
    out = ""
    for op, arg in node:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                out += chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])
            case "BRANCH":
                out += min(map(shortest, arg[1]), key=len)
            case "SUBPATTERN":
                out += shortest(arg[3])
            case "MAX_REPEAT":
                out += shortest(arg[2]) * (arg[0] or str(arg[2][0][0]) == "ANY")
            case "ANY":
                out += "x"
            case other:
                raise ValueError(other)
    return out


def test_shortest_strings_are_found(spark):
    rows = [(name, shortest(re._parser.parse(pattern)).replace(" ", mark)) for name, pattern in lr.SENTENCES for mark in (" ", "\n * ", "-", "_")]
    docs = spark.createDataFrame([(i, text.upper()) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.sentences for r in lr.scan_licences(docs).collect()}
    assert [(got[i], text) for i, (_, text) in enumerate(rows)] == rows
    said = ["Released under CC BY 4.0.", "This work is distributed under Creative Commons Attribution ShareAlike 4.0 International.", "available under CC0 1.0 Universal"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    assert sorted((r.doc_id, r.licences) for r in lr.scan_licences(docs).collect()) == [(0, "CC-BY-4.0"), (1, "CC-BY-SA-4.0"), (2, "CC0-1.0")]
