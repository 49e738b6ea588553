"""Licence sentences, lines and rules against plain Python, on whole licence texts, cut ones and odd rows."""

import re

from palimpsest.llm import license_rules as lr

MIT = """MIT License

Copyright (c) 2024 Somebody. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify. The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://x.org/licenses

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.
See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
TEXTS = [MIT, APACHE, GPL, None, "", "\n\n", "no words here.", "Prose before.\nReleased under the MIT License.\nProse after. " * 3,
         "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: GPL-2.0+",
         "See the GNU General Public License for more details.", "The licence was lost. A permission!", "text. " * 20000 + "Licensed under CC BY-NC 4.0.",
         MIT + "\n\n" + APACHE + "\n\n" + GPL, "Licensed under the Apache License, Version 2.0.\n\nReleased under the MIT license"]


def said(piece):
    """Known sentences of a piece: from each line the runs of lines that are one, the first pattern's longest, and on behind it."""
    lines, out, i = piece.split("\n"), [], 0
    order = sorted(lr.SENTENCES, key=lambda s: "later" not in s[1])
    patterns = [re.compile(re.sub(r"\.\*(?!$)", lambda m: r"[^\n]*(?:\n[^\n]*)?", p).replace(".*", r"[^\n]*").replace(" ", r"\s")) for _, p in order]
    later = re.compile(r"or\s(at\syour\soption\s)?(any\s)?later")
    while i < len(lines):
        runs = [(k, -j) for j in range(i + 1, min(i + 80, len(lines)) + 1) if not later.match("\n".join(lines[j:j + 4]))
                for k, p in enumerate(patterns) if p.fullmatch("\n".join(lines[i:j]))]
        if runs:
            end = -min(runs)[1]
            out.append(" ".join(lines[i:end]))
            i = end
        else:
            i += 1
    if not out and any(re.fullmatch(p.replace(" ", r"\s"), piece, re.S) for _, p in lr.SENTENCES if ".*" in p[:-2]):
        out = [piece.replace("\n", " ")]
    return out


def plain(text):
    ids, keys = [], re.compile("(?i)" + "|".join(lr.KEYWORDS), re.A)
    whole = re.sub(r"(?<![^\W])([vV])\.(?=[ \t\r\n]+[0-9])", r"\1,", text or "")  # the mark of "v. 2.0" ends nothing
    for s in re.split(lr.BREAK.replace("(", "(?:").replace(r"\z", r"\Z"), whole):
        if s and keys.search(s):
            s = re.sub(r"[^a-z0-9+\n]+", " ", s.translate(str.maketrans(lr.UPPER + "\r", lr.SMALL + "\n")))
            for sentence in said(re.sub(r" ?\n[ \n]*", "\n", s).strip(" \n")):
                ids += [name for name, p in lr.SENTENCES if re.fullmatch(p, sentence)][:1]
    left, found = [*ids], []
    rest = "|" + "||".join(left) + "|" if left else ""
    for name, seq in lr.RULES:
        p = "|" + "||".join(seq) + "|"
        if p in rest:
            rest = rest.replace(p, "|~|")
            found += [] if name in found else [name]
    return len(ids), ",".join(ids), ",".join(found), len(re.findall(r"\|[^|~]+\|", rest))


def test_scans(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, MIT, None), (5, "again", ""), (5, "again", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = sorted(map(tuple, lr.scan_licences(docs).collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t, _ in rows), key=str)
    by_id = {g[0]: g for g in got}
    assert by_id[0][3] == "MIT" and by_id[1][3] == "Apache-2.0" and by_id[2][3] == "GPL-3.0-or-later" and by_id[14][3] == "MIT,Apache-2.0,GPL-3.0-or-later"
    assert by_id[13][3] == "CC-BY-NC-4.0" and by_id[11][3] == "" and by_id[11][4] == 1
    assert lr.scan_licences(docs.limit(0)).collect() == []


def test_lines_of_whole_documents(spark):
    """The rule of lines over a whole table, and over planted lines."""
    from test_license_lines import PLANTED

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + [(-1 - i, t) for i, (t, _) in enumerate(PLANTED)]
    got = sorted(map(tuple, lr.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted((i, *plain(t)) for i, t in rows)


def test_every_sentence_has_a_keyword_and_every_rule_known_sentences():
    names = {n for n, _ in lr.SENTENCES}
    assert len(names) == len(lr.SENTENCES)
    for _, pattern in lr.SENTENCES:
        assert re.search("|".join(lr.KEYWORDS), re.sub(r"\[cs\]", "s", pattern)), pattern
    assert all(set(seq) <= names for _, seq in lr.RULES)
