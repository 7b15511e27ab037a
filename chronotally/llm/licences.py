"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences after ``.``, ``!`` or ``?`` followed by white space (not after the ``v.`` of a version), at lines without
letters or digits, at a colon that ends a line and before the number or letter of a list; other line ends are spaces, as licence texts
are wrapped. Of a sentence that isn't known, the longest tail from a line's start that is known counts, as a heading or a copyright line may stand
right before it; what is left is cut at all its line ends and stops. A sentence is normalised
(ASCII small letters, every run of other signs one space, and the wordings of "is licensed under the" reduced to "under") and
looked up among the known licence sentences. The sequence of a text's sentence identifiers is then matched against the
rules: each names a licence and the identifiers that must occur in this order, other sentences between them allowed.

Signs that lead the lines of a comment (``*``, ``//``, ``#``) are among those other signs.

All work is per row: no shuffle, no Python. Texts without any word that every known sentence has one of skip the splitting.

Defined results: a null or empty text has no sentences (empty strings, counts 0). Repeated rows are each scanned; null doc_ids
stay null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: known sentences, normalised, by identifier
SENTENCES = {
    "apache2-notice": ["under apache license version 2 0", "under apache license 2 0", "under apache 2 0 license", "under apache license version 2 0 the license"],
    "apache2-limits": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "apache2-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-notice": ["under mit license", "under mit licence", "under license mit"],
    "mit-title": ["mit license", "the mit license", "the mit license mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl3-notice": ["under gnu general public license version 3", "under gnu gpl version 3", "under gplv3", "under gnu general public license v3 0"],
    "gpl2-notice": ["under gnu general public license version 2", "under gnu gpl version 2", "under gplv2", "under gnu general public license v2 0"],
    "lgpl3-notice": ["under gnu lesser general public license version 3", "under gnu lgpl version 3"],
    "agpl3-notice": ["under gnu affero general public license version 3", "under gnu agpl version 3"],
    "gpl-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd3-notice": ["under bsd 3 clause license", "under 3 clause bsd license", "under new bsd license"],
    "bsd2-notice": ["under bsd 2 clause license", "under 2 clause bsd license"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl2-notice": ["under mozilla public license version 2 0", "under mozilla public license 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"],
    "ccby4-notice": ["under cc by 4 0", "under creative commons attribution 4 0 international license"],
    "ccbysa4-notice": ["under cc by sa 4 0", "under creative commons attribution sharealike 4 0 international license"],
    "ccbync4-notice": ["under cc by nc 4 0", "under creative commons attribution noncommercial 4 0 international license"],
    "ccbyncnd4-notice": ["under cc by nc nd 4 0"],
    "cc0-notice": ["under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0"],
    "spdx-apache2": ["spdx license identifier apache 2 0"],
    "spdx-mit": ["spdx license identifier mit"],
    "spdx-gpl3": ["spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later"],
    "rights": ["all rights reserved"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-warranty": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc-notice": ["under isc license", "isc license"],
    "zlib-warranty": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "zlib-notice": ["under zlib license", "under zlib libpng license"],
    "unlicense-domain": ["this is free and unencumbered software released into the public domain"],
    "unlicense-free": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "unlicense-notice": ["under unlicense"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "boost-notice": ["boost software license version 1 0", "under boost software license version 1 0"],
    "epl2-notice": ["under eclipse public license 2 0 which is available at", "under eclipse public license v 2 0", "under eclipse public license v2 0", "under eclipse public license 2 0"],
    "epl2-header": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "gpl2-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl21-redistribute": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl3-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl-warranty": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "agpl3-redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "apache2-copyright": ["subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"],
    "apache2-title": ["apache license", "apache license version 2 0 january 2004"],
    "spdx-bsd3": ["spdx license identifier bsd 3 clause"],
    "spdx-bsd2": ["spdx license identifier bsd 2 clause"],
    "spdx-gpl2": ["spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0 or later", "spdx license identifier gpl 2 0"],
    "spdx-lgpl21": ["spdx license identifier lgpl 2 1 only", "spdx license identifier lgpl 2 1 or later"],
    "spdx-mpl2": ["spdx license identifier mpl 2 0"],
    "spdx-isc": ["spdx license identifier isc"],
    "spdx-cc0": ["spdx license identifier cc0 1 0"],
}
# fixed values: licences and the identifiers that must follow each other
RULES = [
    ("Apache-2.0", ["apache2-notice"]),
    ("Apache-2.0-header", ["apache2-notice", "apache2-limits", "apache2-copy", "apache2-as-is"]),
    ("Apache-2.0", ["spdx-apache2"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["spdx-mit"]),
    ("MIT-text", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["spdx-gpl3"]),
    ("GPL-3.0-header", ["gpl-redistribute", "gpl-warranty"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("LGPL-3.0", ["lgpl3-notice"]),
    ("AGPL-3.0", ["agpl3-notice"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("BSD-3-Clause-text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause-text", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("CC-BY-4.0", ["ccby4-notice"]),
    ("CC-BY-SA-4.0", ["ccbysa4-notice"]),
    ("CC-BY-NC-4.0", ["ccbync4-notice"]),
    ("CC-BY-NC-ND-4.0", ["ccbyncnd4-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("all-rights-reserved", ["rights"]),
    ("ISC-text", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-notice"]),
    ("ISC", ["spdx-isc"]),
    ("Zlib-text", ["zlib-warranty", "zlib-grant"]),
    ("Zlib", ["zlib-notice"]),
    ("Unlicense-text", ["unlicense-domain", "unlicense-free"]),
    ("Unlicense", ["unlicense-notice"]),
    ("BSL-1.0-text", ["boost-grant"]),
    ("BSL-1.0", ["boost-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("EPL-2.0", ["epl2-header"]),
    ("GPL-2.0-header", ["gpl2-redistribute", "gpl-warranty"]),
    ("LGPL-2.1-header", ["lgpl21-redistribute", "lgpl-warranty"]),
    ("LGPL-3.0-header", ["lgpl3-redistribute", "gpl-warranty"]),
    ("AGPL-3.0-header", ["agpl3-redistribute", "gpl-warranty"]),
    ("Apache-2.0-text", ["apache2-title", "apache2-copyright"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("BSD-2-Clause", ["spdx-bsd2"]),
    ("GPL-2.0", ["spdx-gpl2"]),
    ("LGPL-2.1", ["spdx-lgpl21"]),
    ("MPL-2.0", ["spdx-mpl2"]),
    ("CC0-1.0", ["spdx-cc0"]),
]
#: Every known sentence has one of these.
MARKS = ["under", "licen", "permission", "warranty", "copyright", "redistribut", "reserved", "unencumbered", "anyone"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines of the longest tail of a piece that is looked up; a known sentence wrapped over more lines needs a blank line before it.
TAIL_LINES = 40
SENTENCE_END = r"([.!?])[ \t\r\n\f\x0b]+"
WRAPPED_END = r"(?<![^a-z0-9]v)[.!?][ \t\r\n\f\x0b]+|:[ \t\r]*\n|\n[^a-z0-9\n]*(?=\n)|\n(?=[^a-z0-9\n]*([0-9]{1,2}[.)]|\([a-z0-9]{1,2}\)|[a-z][.)])[ \t])"
WORDING = r"^(this (work|software|project|program|file|document|code|content|text) is |the (work|software|project|code) is )?(licensed|released|distributed|published|made available|available|provided) under (the )?(terms of (the )?)?"

KNOWN = {sentence: name for name, wordings in SENTENCES.items() for sentence in wordings}


def _pattern(names: list[str]) -> str:
    return "," + ",(.*,)?".join(names) + ","


def _normal(sentence: Column) -> Column:
    words = F.trim(F.regexp_replace(sentence, "[^a-z0-9]+", " "))
    return F.regexp_replace(words, WORDING, "under ")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in order), licences (in rule order) and their counts for each document."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    small = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    name = lambda s: F.element_at(known, _normal(s))
    parts = lambda s: F.transform(F.split(s, SENTENCE_END + r"|\n"), name)
    let = lambda value, then: F.transform(F.array(value), then)[0]

    def tails(lines: Column) -> Column:
        """Names of a piece of several lines: of the longest tail that is known and of the parts before it."""
        n = F.size(lines)
        first = F.greatest(F.lit(2), n - (TAIL_LINES - 1))
        known_tails = F.transform(F.sequence(first, n), lambda i: name(F.array_join(F.slice(lines, i, n - i + 1), " ")))
        at = lambda names: F.array_position(F.transform(names, lambda x: x.isNotNull()), True).cast("int")
        before = lambda k: F.array_join(F.slice(lines, 1, first + k - 2), "\n")
        split = lambda names, k: F.when(k == 0, parts(F.array_join(lines, "\n"))).otherwise(F.concat(parts(before(k)), F.array(F.element_at(names, F.greatest(k, F.lit(1))))))
        return let(known_tails, lambda names: let(at(names), lambda k: split(names, k)))

    def names_of(s: Column) -> Column:
        unknown = F.when(F.contains(s, F.lit("\n")), tails(F.split(s, "\n"))).otherwise(parts(s))
        return let(name(s), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(unknown))

    found = F.filter(F.flatten(F.transform(F.split(F.col("small"), WRAPPED_END), names_of)), lambda x: x.isNotNull())
    some = F.lit(False)
    for mark in MARKS:
        some = some | F.contains(F.col("small"), F.lit(mark))
    names = F.when(some, F.array_join(found, ",")).otherwise("")
    by_licence: dict[str, list[str]] = {}
    for licence, sequence in RULES:
        by_licence.setdefault(licence, []).append(_pattern(sequence))
    ordered = F.concat(F.lit(","), F.col("sentences"), F.lit(","))
    hits = [F.when(ordered.rlike("|".join(patterns)), F.lit(licence)) for licence, patterns in by_licence.items()]
    count = lambda c: F.when(F.col(c) == "", F.lit(0)).otherwise(F.size(F.split(F.col(c), ","))).cast("long")
    return (
        docs.select("doc_id", small.alias("small"))
        .select("doc_id", names.alias("sentences"))
        .select("doc_id", "sentences", F.when(F.col("sentences") == "", "").otherwise(F.concat_ws(",", *hits)).alias("licences"))
        .select("doc_id", "sentences", "licences", count("sentences").alias("n_sentences"), count("licences").alias("n_licences"))
    )


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(docs)


def sql() -> str:
    """The same in DuckDB's SQL, whose patterns can't look around: cuts are marked in the text, one kind after another."""
    by_licence: dict[str, list[str]] = {}
    for licence, sequence in RULES:
        by_licence.setdefault(licence, []).append(_pattern(sequence))
    known = ", ".join(f"('{sentence}', '{name}')" for sentence, name in KNOWN.items())
    hits = ", ".join(f"CASE WHEN regexp_matches(',' || sentences || ',', '{'|'.join(patterns)}') THEN '{licence}' END" for licence, patterns in by_licence.items())
    # U+E000 marks a cut between sentences, U+E001 one that only a sentence that isn't known is cut at (a version's "v. ")
    marked = "translate(coalesce(text, ''), '" + UPPER + "\ue000\ue001', '" + LOWER + "  ')"
    for found, made in (
        (r"\n([^a-z0-9\n]*(?:[0-9]{1,2}[.)]|\([a-z0-9]{1,2}\)|[a-z][.)])[ \t])", "\ue000\\1"),
        (r"([^a-z0-9]v)[.!?]([ \t\r\n\f\x0b])", "\\1\ue001\\2"),
        (r"[.!?][ \t\r\n\f\x0b]+", "\ue000"),
        (r":[ \t\r]*\n", "\ue000"),
        (r"\n[^a-z0-9\n]*\n", "\ue000\n"),
    ):
        marked = f"regexp_replace({marked}, '{found}', '{made}', 'g')"
    normal = lambda c: f"regexp_replace(trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g')), '{WORDING}', 'under ')"
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
cut AS (SELECT r, string_split({marked}, '\ue000') AS parts FROM d),
piece AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM cut),
whole AS (SELECT p.r, p.place, p.part, k.name FROM piece p LEFT JOIN known k ON k.sentence = {normal("p.part")}),
split AS (SELECT r, place, string_split(part, chr(10)) AS l FROM whole WHERE name IS NULL),
tail AS (SELECT t.r, t.place, min_by(k.name, t.i) AS name, min(t.i) AS i FROM (SELECT r, place, l, unnest(generate_series(greatest(2, len(l) - {TAIL_LINES - 1}), len(l))) AS i FROM split) t JOIN known k ON k.sentence = {normal("array_to_string(list_slice(t.l, t.i, len(t.l)), ' ')")} GROUP BY t.r, t.place),
rest AS (SELECT s.r, s.place, array_to_string(CASE WHEN t.i IS NULL THEN s.l ELSE list_slice(s.l, 1, t.i - 1) END, chr(10)) AS part FROM split s LEFT JOIN tail t ON t.r = s.r AND t.place = s.place),
lines AS (SELECT r, place, unnest(parts) AS line, generate_subscripts(parts, 1) AS row FROM (SELECT r, place, string_split(translate(part, '\ue001', chr(10)), chr(10)) AS parts FROM rest)),
named AS (SELECT r, place, 0 AS row, name FROM whole WHERE name IS NOT NULL UNION ALL SELECT l.r, l.place, l.row, k.name FROM lines l JOIN known k ON k.sentence = {normal("l.line")} UNION ALL SELECT r, place, 1000000000, name FROM tail),
joined AS (SELECT r, string_agg(name, ',' ORDER BY place, row) AS sentences FROM named GROUP BY r),
every AS (SELECT d.doc_id, coalesce(j.sentences, '') AS sentences FROM d LEFT JOIN joined j ON j.r = d.r),
ruled AS (SELECT doc_id, sentences, CASE WHEN sentences = '' THEN '' ELSE concat_ws(',', {hits}) END AS licences FROM every)
SELECT doc_id, sentences, licences,
  CAST(CASE WHEN sentences = '' THEN 0 ELSE len(string_split(sentences, ',')) END AS BIGINT) AS n_sentences,
  CAST(CASE WHEN licences = '' THEN 0 ELSE len(string_split(licences, ',')) END AS BIGINT) AS n_licences
FROM ruled"""
