"""Licence scans by sentence rules. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenloom.llm._common import stash


@dataclass(frozen=True)
class Rule:
    """A licence is recognised where its sentences follow one another in a text, in this order."""

    licence: str
    sentences: tuple[str, ...]


#: Sentences as their licences publish them. A rule's sentences are matched after normalising.
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
)
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
_ZERO_BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_BOOST = "Distributed under the Boost Software License, Version 1.0"
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v"
_MPL_COPY = "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"
_UNLICENSE = "This is free and unencumbered software released into the public domain"
_UNLICENSE_GRANT = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"
_ZLIB = "This software is provided 'as-is', without any express or implied warranty"
_ZLIB_LIABLE = "In no event will the authors be held liable for any damages arising from the use of this software"
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"
_CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"
_GNU = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}"
_GNU_HOPE = "This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
_GNU_LATER, _GNU_ONLY = "either version {} of the License, or (at your option) any later version", "version {} of the License"
_GNU_KINDS = (
    ("GPL-2.0", "General Public License", "2", "program"),
    ("GPL-3.0", "General Public License", "3", "program"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "library"),
    ("LGPL-3.0", "Lesser General Public License", "3", "library"),
    ("AGPL-3.0", "Affero General Public License", "3", "program"),
)
_CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
_NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
}
_NOTICES = ("Released under the {}", "Licensed under the {}", "This work is licensed under the {}", "This project is licensed under the {}", "This software is released under the {}", "Distributed under the {}")


def _rules() -> tuple[Rule, ...]:
    """The rule base: notices by licence name, the Creative Commons family, the GNU notices, and grants as published."""
    out = [Rule(licence, (notice.format(name),)) for licence, names in _NAMES.items() for name in names for notice in _NOTICES]
    for kind, name in _CC_KINDS.items():
        for version in _CC_VERSIONS:
            port = "International" if version == "4.0" else "Unported" if version == "3.0" else "Generic"
            out += [Rule(f"CC-{kind}-{version}", (f"Licensed under CC {kind} {version}",))]
            out += [Rule(f"CC-{kind}-{version}", (f"This work is licensed under a Creative Commons {name} {version} {port} License",))]
            out += [Rule(f"CC-{kind}-{version}", (f"This work is licensed under the Creative Commons {name} {version} {port} License",))]
    for licence, name, version, thing in _GNU_KINDS:
        for end, suffix in ((_GNU_LATER, "-or-later"), (_GNU_ONLY, "-only")):
            out.append(Rule(licence + suffix, (_GNU.format(thing, name, end.format(version)), _GNU_HOPE.format(thing))))
    return (
        *out,
        Rule("Apache-2.0", _APACHE),
        Rule("MIT", (_MIT_GRANT,)),
        Rule("BSD", (_BSD_GRANT + " 1", _BSD_SOURCE)),  # numbered clauses
        Rule("BSD", (_BSD_GRANT + " " + _BSD_SOURCE,)),  # clauses after signs
        Rule("BSD-3-Clause", (_BSD_NAMES,)),
        Rule("ISC", (_ISC,)),
        Rule("0BSD", (_ZERO_BSD,)),
        Rule("BSL-1.0", (_BOOST,)),
        Rule("MPL-2.0", (_MPL, "2.0", _MPL_COPY)),
        Rule("Unlicense", (_UNLICENSE, _UNLICENSE_GRANT)),
        Rule("Zlib", (_ZLIB, _ZLIB_LIABLE)),
        Rule("EPL-2.0", (_EPL,)),
        Rule("CC0-1.0", (_CC0,)),
    )


RULES = _rules()

#: What normalising turns into one space: all but ASCII letters and digits.
FILLER = "[^a-z0-9]+"


def _normalised(sentence: str) -> str:
    import re

    return re.sub(FILLER, " ", "".join(c.lower() if c.isascii() else c for c in sentence)).strip()


def known_sentences(rules: tuple[Rule, ...]) -> dict[str, int]:
    """An identifier for each distinct normalised sentence, in the order of the rules."""
    found: dict[str, int] = {}
    for rule in rules:
        for sentence in rule.sentences:
            found.setdefault(_normalised(sentence), len(found))
    return found


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def marked(text: Column) -> Column:
    """Normalised sentences, each after `|`, or after `/` where only a line's end without . ! ? parts it from the last."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ|/", "abcdefghijklmnopqrstuvwxyz--")
    ends = F.translate(F.regexp_replace(lower, r"(?<![.!?])[.!?]++(?:[\t\x0b\f\r ]+|(?=\n))", "|"), "\n", "/")
    words = F.regexp_replace(ends, "[^a-z0-9|/]+", " ")
    runs = F.regexp_replace(F.regexp_replace(words, r"(?<![ /])[ /]*+\|[ |/]*+", "|"), " ?/[ /]*+", "/")
    inner = F.trim(runs, F.lit(" |/"))
    return _bound(inner, lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("|"), x)))


def _pattern(sentence: str) -> str:
    """A mark before a known sentence, which goes over as many lines as it takes; the sentence is group 1."""
    return "[|/](?=(" + "[ /]".join(sentence.split()) + ")(?:[|/]|$))"


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A constant table: as much as the rule base holds, whatever the input."""
    cell = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)} AS t({names})")


def _head(sentence: str) -> str:
    return " ".join(sentence.split()[:2])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Licences of each document (doc_id, text), found over whole texts.

    A text is split into sentences at each line's end and at . ! ? before white space. A rule's sentence may
    go over several lines, blank ones and comment leaders of signs included, where no . ! ? ends one of them; it
    begins and ends with a line or sentence. A rule's sentences must be neighbours among all sentences with a
    letter or digit. Each rule is tried at each place; a document's matches are listed by place, then rule.

    The cost of a text does not depend on the number of rules: the first two words of its sentences and lines
    are looked up among those of the known sentences, and only a text that has one of them is compared, with
    the sentences that begin so. That gives identifiers with the places where they begin and end; these are
    joined with the rules by the first identifier, and then by the next place and the next identifier, as often
    as the longest rule has sentences. All of it is rows of (text, place, identifier), so a text that repeats a
    licence is not held in one row, and only texts with a known beginning are shuffled. Texts are read once.

    Returns doc_id, n_sentences (with a letter or digit), n_matches, licences (distinct, in ascending order,
    joined by commas; empty if none) and matches (array of structs sentence, licence: place of the match's
    first sentence or line among these sentences, from 0). Null and empty texts have none. Repeated rows and null
    doc_ids are scanned like others. An empty table gives no rows. Other columns are not read.
    """
    spark, known = docs.sparkSession, known_sentences(rules)
    if any(len(s.split()) < 2 for s in known):
        raise ValueError("a known sentence has two words at least")
    marks = lambda c: F.length(c) - F.length(F.translate(c, "|/", ""))
    match = "array<struct<sentence:long,licence:string>>"
    begins = lambda m: F.transform(F.regexp_extract_all(m, F.lit("[|/](?=([a-z0-9]+[ /][a-z0-9]+))"), F.lit(1)), lambda h: F.translate(h, "/", " "))
    heads = F.split(F.lit("|".join(sorted({_head(s) for s in known}))), "[|]")

    def looked_up(m: Column) -> Column:
        found = F.array_intersect(begins(m), heads)
        return _bound(found, lambda x: F.struct(marks(m).cast("long").alias("n_sentences"), x.alias("heads"), F.when(F.size(x) > 0, m).alias("marked")))

    of_text = _bound(marked(F.coalesce(F.col("text").cast("string"), F.lit(""))), looked_up)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), of_text.alias("t"))
    rows = stash(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "t.n_sentences", "t.heads", "t.marked"), "licence-texts")
    without = rows.where("size(heads) = 0").select("doc_id", "n_sentences", F.lit(0).cast("long").alias("n_matches"), F.lit("").alias("licences"), F.array().cast(match).alias("matches"))

    sentences = F.broadcast(_values(spark, [(_head(s), i, _pattern(s)) for s, i in known.items()], "head, id, pattern"))
    asked = rows.where("size(heads) > 0").select("row", "doc_id", "n_sentences", "marked", F.explode("heads").alias("head")).join(sentences, "head")
    before = F.split("marked", F.col("pattern"))  # each part but the last ends before a match
    found = asked.select("row", "doc_id", "n_sentences", "id", F.transform(before, marks).alias("ahead"), F.transform(F.regexp_extract_all("marked", F.col("pattern"), F.lit(1)), marks).alias("inside"))
    place = F.transform(F.sequence(F.lit(1), F.size("inside")), lambda i: F.aggregate(F.slice("ahead", 1, i), i.cast("long") - 1, lambda x, y: x + y))
    places = F.when(F.size("inside") > 0, F.arrays_zip(place.alias("start"), F.col("inside").alias("more")))
    found = found.select("row", "doc_id", "n_sentences", "id", F.explode_outer(places).alias("at"))
    found = stash(found.select("row", "doc_id", "n_sentences", F.when(F.col("at").isNotNull(), F.col("id")).alias("id"), F.col("at.start").alias("start"), (F.col("at.start") + F.col("at.more") + 1).alias("next")), "licence-sentences")

    sequences = [[known[_normalised(s)] for s in r.sentences] for r in rules]
    longest = max(map(len, sequences), default=1)
    wide = [(n, r.licence, len(seq), *seq, *[-1] * (longest - len(seq))) for n, (r, seq) in enumerate(zip(rules, sequences, strict=True))]
    ordered = F.broadcast(_values(spark, wide, ", ".join(["rule", "licence", "n", *(f"s{i}" for i in range(longest))])))
    hits = found.where("id is not null").select("row", "id", "start", "next")
    live = hits.join(ordered, hits["id"] == F.col("s0")).drop("id")
    done = live.where("n = 1").select("row", "start", "rule", "licence")
    for i in range(1, longest):
        onward = hits.select("row", F.col("start").alias("next"), F.col("id").alias(f"s{i}"), F.col("next").alias("after"))
        live = live.where(F.col("n") > i).join(onward, ["row", "next", f"s{i}"]).drop("next").withColumnRenamed("after", "next")
        done = done.unionByName(live.where(F.col("n") == i + 1).select("row", "start", "rule", "licence"))
    matched = done.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rule", "licence"))).alias("hits"))
    of_row = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_sentences").alias("n_sentences")).join(matched, "row", "left")
    matches = F.coalesce(F.transform("hits", lambda h: F.struct(h["start"].alias("sentence"), h["licence"].alias("licence"))), F.array().cast(match))
    of_row = of_row.select("doc_id", "n_sentences", matches.alias("matches"))
    licences = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",")
    return without.unionByName(of_row.select("doc_id", "n_sentences", F.size("matches").cast("long").alias("n_matches"), licences.alias("licences"), "matches"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The digest columns of `scan` in DuckDB SQL over `documents`, for texts that wrap no known sentence over lines."""
    known = known_sentences(rules)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(s)}, {i})" for s, i in known.items())
    sequences = [[known[_normalised(s)] for s in r.sentences] for r in rules]
    most = max(map(len, sequences))
    rows = ", ".join(f"({quote(r.licence)}, {', '.join(map(str, [*seq, *[-2] * (most - len(seq))]))})" for r, seq in zip(rules, sequences, strict=True))
    columns = ", ".join(f"s{i}" for i in range(most))
    onward = "".join(f" AND (s{i} = -2 OR s{i} = lead{i})" for i in range(1, most))
    leads = "".join(f", lead(coalesce(id, -1), {n}) OVER (PARTITION BY k ORDER BY i) AS lead{n}" for n in range(1, most))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
known(sentence, id) AS (VALUES {values}),
parts AS (SELECT k, unnest(string_split_regex(text, '[.!?]+[\\t\\x0B\\f\\r ]+|\\n')) AS raw, generate_subscripts(string_split_regex(text, '[.!?]+[\\t\\x0B\\f\\r ]+|\\n'), 1) AS i FROM docs),
clean AS (SELECT k, i, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM parts),
full_ AS (SELECT * FROM clean WHERE sentence <> ''),
ids AS (SELECT k, i, coalesce(id, -1) AS id{leads} FROM full_ LEFT JOIN known USING (sentence)),
rules(licence, {columns}) AS (VALUES {rows}),
hits AS (SELECT k, licence FROM ids JOIN rules ON id = s0{onward}),
per_doc AS (SELECT k, count(*) AS n_matches, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM hits GROUP BY k),
sizes AS (SELECT k, count(*) AS n_sentences FROM full_ GROUP BY k)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licences, '') AS licences
FROM docs LEFT JOIN sizes USING (k) LEFT JOIN per_doc USING (k)
"""
