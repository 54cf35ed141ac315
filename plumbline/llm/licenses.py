"""Licence scans by sentence rules, in DataFrame functions only, without a shuffle.

A text is normalised (letters A-Z lower-cased, everything but letters and digits to one space) with marks for full
stops before white space and for line ends. A known licence sentence stands between two marks; single line ends,
with or without a comment prefix, may also stand between its words, while full stops and blank lines end it. Of
sentences that begin at one place the longest counts. The identifiers found, in order, are the text's sequence; a sentence that is not known breaks
nothing. Rules are tried in their order: a rule holds where its identifiers follow each other, and takes them
out, so a later rule cannot use them again.

Defined results: null and empty texts have no sentences and no licence; repeated rows get equal results; a rule
that holds several times is listed once; other columns stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[.!?]+[ \t\r\n]+|[.!?]*[\r\n]+"
#: Comment prefixes that are words; those of signs are white space anyway.
COMMENT = r"(?:(?:dnl|rem|c) )?"
#: Marks of a full stop and of a line end; no other capital is left in a lower-cased text.
MARKS = [(r"[.!?]+(?=[ \t\r\n])", " S "), (r"\r\n|\r|\n", " L "), (r"[^a-z0-9SL]+", " ")]

#: Sentences of public licence texts and notices, and their identifiers.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-notice-the": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-language": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-notice-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "cc-by-nc4-notice": "Licensed under CC BY-NC 4.0",
    "cc-by4-notice": "Licensed under CC BY 4.0",
    "cc-by-sa4-notice": "Licensed under CC BY-SA 4.0",
    "cc0-notice": "Licensed under CC0 1.0",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-notice": "Licensed under the BSD 3-Clause License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
}
#: Ordered rules; a longer form stands before its parts.
RULES = [
    ("Apache-2.0", ["apache-notice-the", "apache-obtain", "apache-asis", "apache-language"]),
    ("Apache-2.0", ["apache-notice-the"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-licensed"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-notice"]),
    ("CC-BY-4.0", ["cc-by4-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("BSD-3-Clause", ["bsd-notice"]),
    ("BSD", ["bsd-redistribution"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-free"]),
]


def plain(sentence: str) -> str:
    """The normal form of a known sentence."""
    low = sentence.translate(str.maketrans(UPPER, LOWER))
    return " ".join("".join(c if c in LOWER + "0123456789" else " " for c in low).split())


def marked(text: Column) -> Column:
    """The words of a text with its marks, one mark at each end."""
    out = F.translate(text, UPPER, LOWER)
    for pattern, mark in MARKS:
        out = F.regexp_replace(out, pattern, mark)
    return F.concat(F.lit("L "), F.trim(out), F.lit(" L"))


def _pattern(sentence: str) -> str:
    """The words of a known sentence, over single line ends; its own full stops ("v. 2.0") belong to it."""
    out = sentence.translate(str.maketrans(UPPER, LOWER))
    for pattern, mark in MARKS:
        out = re.sub(pattern, mark, out)
    wrap = f" (?:L {COMMENT})?"
    return wrap.join(out.split()).replace(f"{wrap}S{wrap}", f" S{wrap}")


def _lookup(sentences: dict[str, str]) -> dict[str, str]:
    """Normal form to identifier for the oracle, which ends a sentence at each ``BREAK``."""
    return {plain(re.split(BREAK, s)[0]): name for name, s in sentences.items()}


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    longest = sorted(sentences.values(), key=lambda s: -len(plain(s)))
    known = "[SL] " + COMMENT + "(" + "|".join(map(_pattern, longest)) + ")(?= [SL])"
    table = F.create_map(*[F.lit(x) for name, s in sentences.items() for x in (plain(s), name)])
    found = F.regexp_extract_all(marked(text), F.lit(known), 1)
    return F.transform(found, lambda s: table[F.regexp_replace(s, "(?:L " + COMMENT + "|S )", "")])


def licences(docs: DataFrame, *, text_col: str = "text", sentences: dict[str, str] = SENTENCES,
             rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """``docs`` without the text, with ``sentence_ids`` (array) and ``licences`` (array, in rule order)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [c for c in docs.columns if c not in (text_col, "sentence_ids", "licences")]
    found = docs.select(*own, sentence_ids(text, sentences).alias("sentence_ids"))
    # Each identifier stands between spaces of its own, so a sequence is a plain substring.
    line = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "")
    table = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit("".join(f" {i} " for i in ids)).alias("ids")) for name, ids in rules])
    walked = F.aggregate(
        table, F.struct(line.alias("left"), F.array().cast("array<string>").alias("names")),
        lambda acc, r: F.struct(
            F.replace(acc["left"], r["ids"], F.lit("|")).alias("left"),
            F.when(F.contains(acc["left"], r["ids"]), F.array_append(acc["names"], r["name"])).otherwise(acc["names"]).alias("names")),
        lambda acc: F.array_distinct(acc["names"]))
    none = F.array().cast("array<string>")
    return found.withColumn("licences", F.when(F.size("sentence_ids") > 0, walked).otherwise(none))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for (doc_id, n_sentences, licences) of ``licences`` over a table."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    keys, names = zip(*_lookup(SENTENCES).items())
    steps = ", ".join(
        f"replace(s{n}, {quoted(''.join(f' {i} ' for i in ids))}, '|') AS s{n + 1}, contains(s{n}, {quoted(''.join(f' {i} ' for i in ids))}) AS m{n}"
        for n, (_, ids) in enumerate(RULES))
    wins = ", ".join(f"CASE WHEN m{n} THEN {quoted(name)} END" for n, (name, _) in enumerate(RULES))
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(
    regexp_split_to_array(coalesce(text, ''), '{BREAK}'),
    lambda s: map_extract(map([{', '.join(map(quoted, keys))}], [{', '.join(map(quoted, names))}]),
                     trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')))[1]),
    lambda x: x IS NOT NULL) AS ids FROM {table}),
lines AS (SELECT doc_id, len(ids) AS n, coalesce(array_to_string(list_transform(ids, lambda x: ' ' || x || ' '), ''), '') AS s0 FROM cut),
tried AS (SELECT doc_id, n, s0, {steps} FROM lines)
SELECT doc_id, n AS n_sentences,
  array_to_string(list_filter([{wins}], lambda x, i: x IS NOT NULL AND list_position([{wins}], x) = i), ',') AS licences
FROM tried"""
