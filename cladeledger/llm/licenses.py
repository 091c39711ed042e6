"""Licence scans by sentence rules, in DataFrame functions only.

Comment marks in front of lines are left out. A text is cut into sentences, at empty lines and at copyright lines,
and sentences of several lines also into those lines. Each is normalised to words of
a-z and 0-9 and looked up among known licence sentences. The identifiers found in a document, in order, form its
sequence; ordered rules then take licences out of it: an earlier rule takes its run of identifiers away from
later ones, so that a full text is not also reported as a mere mention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence wording, normalised.
SENTENCES = {
    "apache2-ref": ("licensed under the apache license version 2 0", "this project is licensed under the apache license version 2 0",
                    "released under the apache license version 2 0"),
    "apache2-head": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
                     "licensed under the apache license version 2 0 the license"),
    "apache2-file": ("you may not use this file except in compliance with the license",),
    "apache2-asis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "mit-ref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
                  "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-asis": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd-ref": ("released under the bsd license", "licensed under the bsd license"),
    "gpl3-ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"),
    "gpl2-ref": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"),
    "gpl3-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl2-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl-hope": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "mpl2-ref": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "ccby-ref": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "ccbysa-ref": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "ccbync-ref": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc0-ref": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}
# Licence and its run of sentences, the more telling ones first.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-asis")),
    ("Apache-2.0", ("apache2-head", "apache2-file", "apache2-asis")),
    ("Apache-2.0", ("apache2-head", "apache2-asis")),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("Apache-2.0", ("apache2-head",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("MIT", ("mit-ref",)),
    ("BSD", ("bsd-ref",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("ISC", ("isc-grant",)),
    ("CC-BY-4.0", ("ccby-ref",)),
    ("CC-BY-SA-4.0", ("ccbysa-ref",)),
    ("CC-BY-NC-4.0", ("ccbync-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Unlicense", ("unlicense",)),
)

# Wording that the SQL does not know.
_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu"
_OR_LATER = "of the license or at your option any later version"
_HOPE = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
MORE_SENTENCES = {
    "lgpl21-free": (f"this library {_FREE} lesser general public license as published by the free software foundation either version 2 1 {_OR_LATER}",),
    "lgpl3-free": tuple(f"this {x} {_FREE} lesser general public license as published by the free software foundation either version 3 {_OR_LATER}" for x in ("library", "program")),
    "lgpl-hope": (f"this library {_HOPE}",),
    "agpl3-free": (f"this program {_FREE} affero general public license as published by the free software foundation either version 3 {_OR_LATER}",),
    "lgpl21-ref": ("licensed under the gnu lesser general public license version 2 1",),
    "lgpl3-ref": ("licensed under the gnu lesser general public license version 3",),
    "agpl3-ref": ("licensed under the gnu affero general public license version 3",),
    "epl2-ref": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
                 "licensed under the eclipse public license 2 0", "licensed under the eclipse public license version 2 0"),
    "epl1-ref": ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",),
    "bsl1-ref": ("distributed under the boost software license version 1 0",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
}
MORE_RULES = (
    ("LGPL-2.1-or-later", ("lgpl21-free",)), ("LGPL-3.0-or-later", ("lgpl3-free",)), ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("LGPL-2.1", ("lgpl21-ref",)), ("LGPL-3.0", ("lgpl3-ref",)), ("AGPL-3.0", ("agpl3-ref",)),
    ("EPL-2.0", ("epl2-ref",)), ("EPL-1.0", ("epl1-ref",)), ("BSL-1.0", ("bsl1-ref",)), ("Zlib", ("zlib-grant",)),
)

# Comment marks in front of a line with the blanks around them; a line of nothing else becomes empty.
_PREFIX = r"(?md)^[ \t]*+(?:@?(?:dnl|rem|REM)(?=[ \t\r\n]|$))?+[ \t/*#;%!|<>(){}:'\"\\=+~-]*+"
# Only with a year or sign, since wrapped sentences have lines that start with the word. The line ends around it go
# too; a run of them is tried once.
_COPYRIGHT = r"(?mid)(?:(?<![\r\n])[\r\n]++|^)((?:portions )?(?:copyright\b[^\n]*(?:\(c\)|\x{A9}|[12][0-9]{3})|c\) ?[12][0-9]{3}|\x{A9}|all rights reserved)[^\r\n]*)[\r\n]*+"

# A full stop, question or exclamation mark after a letter, digit, quote or bracket ends a sentence; so does an
# empty line.
_END = r"([a-zA-Z0-9)\"'\x{80}-\x{10FFFF}][.!?])[ \t\n\r]+"
_EMPTY_LINE = r"\n[ \t\r]*\n"
_MARK = "\u0001"


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``place`` (sentence and line) and normalised ``sentence``, in DataFrame rows."""
    text = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), _MARK, " "), _PREFIX, "")
    text = F.regexp_replace(text, _COPYRIGHT, f"{_MARK}$1{_MARK}")
    cut = F.regexp_replace(F.regexp_replace(text, _EMPTY_LINE, _MARK), _END, f"$1{_MARK}")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.posexplode(F.split(cut, _MARK, -1)).alias("no", "unit"),
    )
    lines = F.split(F.col("unit"), "\n", -1)
    each = F.when(F.contains("unit", F.lit("\n")), F.concat(F.array("unit"), lines)).otherwise(F.array("unit"))
    rows = rows.select("doc_id", "text_key", "no", F.posexplode(each).alias("line", "piece"))
    return rows.select("doc_id", "text_key", F.struct("no", "line").alias("place"), _normal(F.col("piece")).alias("sentence"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id``, ``n_sentences`` known, their ``sentence_ids`` in order, and ``licences`` in alphabetical order.

    Null and empty texts have none. Repeated rows are each reported alike; a document that repeats a licence line
    has its identifier as often, and its licence once. Strings are comma-joined, empty if nothing is found.
    """
    known = [(s, name) for name, wordings in (SENTENCES | MORE_SENTENCES).items() for s in wordings]
    # The list is a constant of this module, a few dozen rows.
    listed = F.broadcast(docs.sparkSession.createDataFrame(known, "sentence string, id string"))
    found = sentences(docs).join(listed, "sentence").groupBy("doc_id", "text_key").agg(
        F.transform(F.sort_array(F.collect_set(F.struct("place", "id"))), lambda s: s["id"]).alias("ids")
    )
    found = found.withColumn("rest", F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")))
    rules = (*RULES, *MORE_RULES)
    for i, (_, run) in enumerate(rules):
        wanted = F.lit(f" {'  '.join(run)} ")
        found = found.withColumn(f"has_{i}", F.contains("rest", wanted)).withColumn("rest", F.replace("rest", wanted, F.lit(" | ")))
    names = F.array_compact(F.array(*[F.when(F.col(f"has_{i}"), name) for i, (name, _) in enumerate(rules)]))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "ids", F.array_sort(F.array_distinct(names)).alias("names"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return joined.select(
        "doc_id", F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("bigint").alias("n_sentences"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("sentence_ids"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licences"),
    )


def oracle() -> str:
    """The same scan over ``documents`` in DuckDB SQL."""
    known = ", ".join(f"('{s}', '{name}')" for name, wordings in SENTENCES.items() for s in wordings)
    steps, last = [], "sequences"
    for i, (_, run) in enumerate(RULES):
        wanted = f" {'  '.join(run)} "
        steps.append(f"r{i} as (select * replace (replace(rest, '{wanted}', ' | ') as rest), contains(rest, '{wanted}') as has_{i} from {last})")
        last = f"r{i}"
    names = ", ".join(f"case when has_{i} then '{name}' end" for i, (name, _) in enumerate(RULES))
    end = _END.replace("'", "''")
    return rf"""
    with known(sentence, id) as (values {known}),
    cut as (
        select doc_id, string_split(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '{_EMPTY_LINE}', chr(1), 'g'),
            '{end}', '\1' || chr(1), 'g'), chr(1)) as units from documents
    ),
    units as (select doc_id, unnest(range(len(units))) as no, unnest(units) as unit from cut),
    pieces as (
        select doc_id, no, unnest(range(len(each))) as line, unnest(each) as piece
        from (select doc_id, no, case when contains(unit, chr(10)) then list_concat([unit], string_split(unit, chr(10))) else [unit] end as each from units)
    ),
    found as (
        select doc_id, no, line, id
        from (select *, trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g')) as sentence from pieces) join known using (sentence)
    ),
    sequences as (
        select doc_id, count(*) as n, string_agg(id, ',' order by no, line, id) as ids, ' ' || string_agg(id, '  ' order by no, line, id) || ' ' as rest
        from found group by 1
    ),
    {', '.join(steps)}
    select d.doc_id, coalesce(n, 0)::bigint as n_sentences, coalesce(ids, '') as sentence_ids,
        coalesce(array_to_string(list_sort(list_distinct([x for x in [{names}] if x is not null])), ','), '') as licences
    from documents d left join {last} using (doc_id)
    """
