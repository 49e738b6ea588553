"""Licence recognition by sentences: known sentences give identifiers, ordered rules read the sequence of identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import table
from palimpsest.llm.registry import query

#: One of these, in any case, is in every known sentence as it is written, wrapped or with marks for blanks.
KEYWORDS = ("licen[cs]e", "copyright", "permission", "warrant", "redistribut", "free software", "public domain", "spdx", "as is", "liable",
            r"public[\W_]+domain", r"cc[\W_]+by", r"creative[\W_]+commons", "cc0")

#: Identifiers, and patterns of whole sentences in lower case, with single blanks for all but letters, digits and +.
SENTENCES = (
    ("spdx_mit", r"spdx license identifier mit"),
    ("spdx_apache2", r"spdx license identifier apache 2 0"),
    ("spdx_gpl2", r"spdx license identifier gpl 2 0( only)?"),
    ("spdx_gpl2p", r"spdx license identifier gpl 2 0(\+| or later)"),
    ("spdx_gpl3", r"spdx license identifier gpl 3 0( only)?"),
    ("spdx_gpl3p", r"spdx license identifier gpl 3 0(\+| or later)"),
    ("spdx_bsd2", r"spdx license identifier bsd 2 clause"),
    ("spdx_bsd3", r"spdx license identifier bsd 3 clause"),
    ("spdx_isc", r"spdx license identifier isc"),
    ("spdx_mpl2", r"spdx license identifier mpl 2 0"),
    ("mit_ref", r"(this (work|software|project|file|document) is )?(released|licensed|distributed|available) under the (terms of the )?mit licen[cs]e"),
    ("mit_title", r"(the )?mit licen[cs]e( mit)?"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction.*"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit_asis", r"the software is provided as is without warranty of any kind express or implied.*"),
    ("mit_liable", r"in no event shall the authors or copyright holders be liable for any claim.*"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("isc_asis", r"the software is provided as is and the author disclaims all warranties.*"),
    ("apache2_ref", r"(this (work|software|project|file|document) is )?(released|licensed|distributed|available) under the (terms of the )?apache licen[cs]e,? version 2 0( the license)?"),
    ("apache2_may", r"you may not use this file except in compliance with the license"),
    ("apache2_obtain", r"you may obtain a copy of the license at.*"),
    ("apache2_unless", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("apache2_see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("gpl3_ref", r"(this (work|software|project|file|document) is )?(released|licensed|distributed|available) under the (terms of the )?gnu general public licen[cs]e( gpl)? (version 3|v3)( only)?"),
    ("gpl3p_ref", r"(this (work|software|project|file|document) is )?(released|licensed|distributed|available) under the (terms of the )?gnu general public licen[cs]e( gpl)? (version 3|v3) or (any )?later( version)?"),
    ("gpl2_ref", r"(this (work|software|project|file|document) is )?(released|licensed|distributed|available) under the (terms of the )?gnu general public licen[cs]e( gpl)? (version 2|v2)( only)?"),
    ("gpl3p_free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2p_free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl21p_free", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("gpl_hope", r"this (program|library) is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl_see", r"see the gnu (lesser )?general public license for more details"),
    ("gpl_copy", r"you should have received a copy of the gnu (lesser )?general public license along with this (program|library).*"),
    ("bsd_redist", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("bsd_source", r"([0-9] )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", r"([0-9] )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd_names", r"([0-9] )?neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd_asis", r"this software is provided by the copyright (holders|owner) and contributors as is and any express or implied warranties.*"),
    ("bsd_liable", r"in no event shall the copyright (holder|owner)s? or contributors be liable.*"),
    ("mpl2_subject", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("ccbync4_ref", r"(this (work|software|project|file|document) is )?(released|licensed|distributed|available) under (the )?(cc by nc|creative commons attribution noncommercial) 4 0( international)?( licen[cs]e)?"),
    ("ccbysa4_ref", r"(this (work|software|project|file|document) is )?(released|licensed|distributed|available) under (the )?(cc by sa|creative commons attribution sharealike) 4 0( international)?( licen[cs]e)?"),
    ("ccby4_ref", r"(this (work|software|project|file|document) is )?(released|licensed|distributed|available) under (the )?(cc by|creative commons attribution) 4 0( international)?( licen[cs]e)?"),
    ("cc0_ref", r"(this (work|software|project|file|document) is )?(released|licensed|distributed|available) under (the )?cc0( 1 0)?( universal)?( licen[cs]e)?"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("rights", r"copyright .*all rights reserved"),
)

#: Licences and the sequences of identifiers that say them. Earlier rules come first and use up what they match.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "mit_asis", "mit_liable")),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("ISC", ("isc_grant", "isc_asis")),
    ("BSD-3-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_names", "bsd_asis", "bsd_liable")),
    ("BSD-3-Clause", ("bsd_source", "bsd_binary", "bsd_names", "bsd_asis")),
    ("BSD-2-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_asis", "bsd_liable")),
    ("BSD-2-Clause", ("bsd_source", "bsd_binary", "bsd_asis")),
    ("Apache-2.0", ("apache2_ref", "apache2_may", "apache2_obtain", "apache2_unless", "apache2_see")),
    ("GPL-3.0-or-later", ("gpl3p_free", "gpl_hope", "gpl_see", "gpl_copy")),
    ("GPL-2.0-or-later", ("gpl2p_free", "gpl_hope", "gpl_see", "gpl_copy")),
    ("LGPL-2.1-or-later", ("lgpl21p_free", "gpl_hope", "gpl_see", "gpl_copy")),
    ("GPL-3.0-or-later", ("gpl3p_free",)), ("GPL-2.0-or-later", ("gpl2p_free",)), ("LGPL-2.1-or-later", ("lgpl21p_free",)),
    ("MIT", ("spdx_mit",)), ("Apache-2.0", ("spdx_apache2",)), ("GPL-2.0-only", ("spdx_gpl2",)), ("GPL-2.0-or-later", ("spdx_gpl2p",)),
    ("GPL-3.0-only", ("spdx_gpl3",)), ("GPL-3.0-or-later", ("spdx_gpl3p",)), ("BSD-2-Clause", ("spdx_bsd2",)),
    ("BSD-3-Clause", ("spdx_bsd3",)), ("ISC", ("spdx_isc",)), ("MPL-2.0", ("spdx_mpl2",)),
    ("Apache-2.0", ("apache2_ref",)), ("GPL-3.0-or-later", ("gpl3p_ref",)), ("GPL-3.0-only", ("gpl3_ref",)), ("GPL-2.0-only", ("gpl2_ref",)),
    ("MIT", ("mit_ref",)), ("MIT", ("mit_title",)), ("MIT", ("mit_grant",)), ("ISC", ("isc_grant",)), ("MPL-2.0", ("mpl2_subject",)),
    ("CC-BY-NC-4.0", ("ccbync4_ref",)), ("CC-BY-SA-4.0", ("ccbysa4_ref",)), ("CC-BY-4.0", ("ccby4_ref",)), ("CC0-1.0", ("cc0_ref",)),
    ("Unlicense", ("unlicense",)),
)
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sentences end in a mark before white space or the end, or at an empty line.
BREAK = r"[.!?;]+([ \t\r\n]+|\z)|\n[ \t\r]*\n"
OUTSIDE = r"[^a-z0-9+]+"
#: As BREAK, but the mark of "v. 2.0" ends nothing.
ENDS = r"(?!(?<=\b[vV])\.[ \t\r\n]+[0-9])" + BREAK
#: Known sentences from a line's start to a line's end, wrapped anywhere; what is open in the middle runs on for one line at most.
#: Those that end in "later" are tried first, and a line's end before "or later" ends none: their beginnings say another licence.
LINES = (r"(?<![^\n])(?:" + "|".join(re.sub(r"\.\*(?!$)", lambda m: r".*(?:\n.*)?", p).replace(" ", r"\s") for _, p in sorted(SENTENCES, key=lambda s: "later" not in s[1]))
         + r")(?![^\n])(?!\nor\s(?:at\syour\soption\s)?(?:any\s)?later)")
#: Sentences that are open in the middle, as a whole piece of any number of lines.
OPEN = r"(?s)^(?:" + "|".join(p.replace(" ", r"\s") for _, p in SENTENCES if ".*" in p[:-2]) + ")$"
#: Stands for identifiers that a rule has used.
USED = "|~|"


def _sequence(ids: tuple[str, ...]) -> str:
    return "|" + "||".join(ids) + "|"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order; null for a text without any keyword.

    A sentence starts at the start of a piece or line and ends at the end of one. Each step has its own list, so that it is
    computed once for a piece.
    """
    keyword = "(?i)" + "|".join(KEYWORDS)
    pieces = F.filter(F.split(text, ENDS), lambda s: s.rlike(keyword))

    def plain(piece: Column) -> Column:
        letters = F.regexp_replace(F.translate(piece, UPPER + "\r", SMALL + "\n"), r"[^a-z0-9+\n]+", " ")
        return F.btrim(F.regexp_replace(letters, r" ?\n[ \n]*", "\n"), F.lit(" \n"))

    def said(found: Column) -> Column:
        whole = F.when(found["piece"].rlike(OPEN), F.array(found["piece"])).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(found["lines"]) > 0, found["lines"]).otherwise(whole)

    def identify(sentence: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, pattern in reversed(SENTENCES):
            found = F.when(sentence.rlike(f"^({pattern})$"), F.lit(name)).otherwise(found)
        return found

    found = F.transform(F.transform(pieces, plain), lambda s: F.struct(s.alias("piece"), F.regexp_extract_all(s, F.lit(LINES), F.lit(0)).alias("lines")))
    sentences = F.transform(F.flatten(F.transform(found, said)), lambda s: F.translate(s, "\n", " "))
    return F.when(text.rlike(keyword), F.filter(F.transform(sentences, identify), lambda i: i.isNotNull()))


def match_rules(ids: Column) -> Column:
    """``licences`` (in order of the rules, each once) and ``rest``, the sequence with what rules used struck out."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_sequence(seq)).alias("seq")) for name, seq in RULES])
    start = F.struct(F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")).alias("rest"), F.array().cast("array<string>").alias("licences"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["seq"])
        return F.struct(F.when(hit, F.replace(state["rest"], rule["seq"], F.lit(USED))).otherwise(state["rest"]).alias("rest"),
                        F.when(hit, F.array_append(state["licences"], rule["name"])).otherwise(state["licences"]).alias("licences"))

    return F.aggregate(rules, start, apply, lambda s: F.struct(F.array_distinct(s["licences"]).alias("licences"), s["rest"].alias("rest")))


def scan_licences(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_known (known sentences), sentences, licences, and n_open, known sentences that no rule used.

    Lists are joined by commas. A null or empty text, and one without known sentences, has empty lists and zeros. Each row
    is read for itself: nothing is shuffled, and no other column of ``docs`` is looked at.
    """
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    some = F.size("ids") > 0
    found = found.withColumn("m", F.when(some, match_rules(F.col("ids"))))
    left = F.regexp_replace(F.regexp_replace("m.rest", r"\|~\|", ""), r"[^|]", "")
    return found.select(
        "doc_id", F.when(some, F.size("ids")).otherwise(0).cast("long").alias("n_known"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("sentences"),
        F.coalesce(F.array_join("m.licences", ","), F.lit("")).alias("licences"),
        F.coalesce(F.floor(F.length(left) / 2), F.lit(0)).cast("long").alias("n_open"))


def _oracle() -> str:
    """Sentences by runs of lines: from each line, the runs that are a known sentence; the first pattern's longest run, and on behind it."""
    cases = " ".join(f"when regexp_full_match(s, '{pattern}') then '{name}'" for name, pattern in SENTENCES)
    by_line = [re.sub(r"\.\*(?!$)", r".*(\\n.*)?", p).replace(" ", r"\s") for _, p in sorted(SENTENCES, key=lambda s: "later" not in s[1])]
    kinds = " ".join(f"when regexp_full_match(txt, '{p}') then {k}" for k, p in enumerate(by_line))
    widest = max(p.count(" ") + 2 for _, p in SENTENCES)  # a sentence cannot have more lines than words, and one that it runs on for
    keyword = "(?i)" + "|".join(KEYWORDS)
    opened = "(?s)" + "|".join(p.replace(" ", r"\s") for _, p in SENTENCES if ".*" in p[:-2])
    steps = "r0"
    ctes = []
    for k, (name, seq) in enumerate(RULES):
        pattern = _sequence(seq)
        ctes.append(f"r{k + 1} as materialized (select doc_id, n, ids, case when contains(rest, '{pattern}') then list_append(found, '{name}') else found end as found,"
                    f" replace(rest, '{pattern}', '{USED}') as rest from {steps})")
        steps = f"r{k + 1}"
    return rf"""
with recursive p as materialized (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
w as materialized (select n, string_split_regex(regexp_replace(text, '(\b[vV])\.([ \t\r\n]+[0-9])', '\1,\2', 'g'), '{BREAK}') as s from p where regexp_matches(text, '{keyword}')),
k as materialized (select n, pos, trim(regexp_replace(regexp_replace(translate(s, '{UPPER}' || chr(13), '{SMALL}' || chr(10)), '[^a-z0-9+\n]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) as piece
        from (select n, unnest(s) as s, generate_subscripts(s, 1) as pos from w) where regexp_matches(s, '{keyword}')),
l as materialized (select n, pos, string_split(piece, chr(10)) as ls from k),
c as (select n, pos, i, unnest(range(i, least(i + {widest}, len(ls) + 1))) as j, ls from (select n, pos, ls, unnest(range(1, len(ls) + 1)) as i from l)),
t as (select n, pos, i, j, array_to_string(ls[i:j], chr(10)) as txt, array_to_string(ls[j + 1:j + 4], chr(10)) as rest from c),
m as materialized (select n, pos, i, j, txt from (select *, row_number() over (partition by n, pos, i order by kind, j desc) as best
        from (select *, case {kinds} end as kind from t where not regexp_matches(rest, '^or\s(at\syour\soption\s)?(any\s)?later')) where kind is not null) where best = 1),
o1 as (select n, pos, min(i) as i from m group by n, pos),
u as (select n, pos, i from o1 union all
      select n, pos, nxt from (select u.n, u.pos, min(b.i) as nxt from u join m a on a.n = u.n and a.pos = u.pos and a.i = u.i join m b on b.n = u.n and b.pos = u.pos and b.i > a.j group by u.n, u.pos, u.i)),
f as (select n, pos, i, replace(txt, chr(10), ' ') as s from u join m using (n, pos, i) union all
      select n, pos, 0, replace(piece, chr(10), ' ') from k where (n, pos) not in (select (n, pos) from m) and regexp_full_match(piece, '{opened}')),
g as (select n, list(id order by pos, i) as ids from (select n, pos, i, case {cases} end as id from f) where id is not null group by n),
r0 as materialized (select p.doc_id, p.n, coalesce(ids, []) as ids, []::varchar[] as found,
              case when ids is null then '' else '|' || array_to_string(ids, '||') || '|' end as rest from p left join g using (n)),
{", ".join(ctes)},
o as (select n, list(name order by k) as licences from (select n, name, min(k) as k from (select n, unnest(found) as name, generate_subscripts(found, 1) as k from {steps})
      group by n, name) group by n)
select doc_id, len(ids)::bigint as n_known, array_to_string(ids, ',') as sentences, coalesce(array_to_string(licences, ','), '') as licences,
       (length(regexp_replace(replace(rest, '{USED}', ''), '[^|]', '', 'g')) // 2)::bigint as n_open
from {steps} left join o using (n)"""


@query("op4_license_rules", _oracle())
def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
