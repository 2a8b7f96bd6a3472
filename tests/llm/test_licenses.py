import random
import re

import duckdb
import pandas as pd
import pytest

from eigenloom.llm.licenses import RULES, Rule, known_sentences, oracle_sql, scan


def brute(text, rules=RULES):
    norm = lambda s: re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in s)).strip(" ")
    known = known_sentences(rules)
    parts = [p for p in map(norm, re.split("[.!?]+[\t\x0b\f\r ]+|\n", text or "")) if p]
    ids = [known.get(p, -1) for p in parts]
    hits = []
    for i in range(len(ids)):
        for r in rules:
            seq = [known[norm(s)] for s in r.sentences]
            if ids[i : i + len(seq)] == seq:
                hits.append((i, r.licence))
    return len(parts), hits


def texts():
    rng = random.Random(5)
    pool = [s for r in RULES for s in r.sentences] + ["Lorem ipsum", "Éa", "", "LICENSED under CC BY-NC 4.0", "released  under the MIT-license", "K"]
    out = ["".join(rng.choice(pool) + rng.choice([". ", "\n", "!? ", " ", ".\n"]) for _ in range(rng.randrange(0, 9))) for _ in range(120)]
    return [*out, None, "", "\n\n. ! ", "Released under the MIT License." * 500, "x" * 20000 + "\nReleased under the MIT License."]


def test_scan_against_brute_force_and_sql(spark):
    rows = [(i, t, "m") for i, t in enumerate(texts())] + [(None, "Released under the MIT License.", None), (3, texts()[3], "m")]
    out = scan(spark.createDataFrame(rows, "doc_id long, text string, matches string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((d, brute(t)[0], [*map(tuple, brute(t)[1])]) for d, t, _ in rows), key=key)
    assert sorted(((r.doc_id, r.n_sentences, [(m.sentence, m.licence) for m in r.matches]) for r in out), key=key) == want
    assert all(r.n_matches == len(r.matches) and r.licences == ",".join(sorted({m.licence for m in r.matches})) for r in out)
    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]})
    assert documents is not None
    got = duckdb.sql(oracle_sql()).fetchall()
    assert sorted(got, key=key) == sorted(((r.doc_id, r.n_sentences, r.n_matches, r.licences) for r in out), key=key)


def test_own_rules_and_empty_table(spark):
    rules = (Rule("Two", ("A b", "C d")), Rule("One", ("C d",)))
    docs = spark.createDataFrame([(1, "a B. c d"), (2, "a b. x. c d"), (3, "c d")], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in scan(docs, rules).collect()} == {1: "One,Two", 2: "One", 3: "One"}
    assert scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        scan(docs, (Rule("Short", ("word",)),))


def test_a_known_sentence_that_overlaps_itself_and_long_rules(spark):
    rules = (Rule("Again", ("x y x y",)), Rule("Long", ("a b", "c d", "a b", "c d")), Rule("Quote's", ("a b",)))
    docs = spark.createDataFrame([(1, "x y\nx y\nx y"), (2, "a b. c d. a b. c d. a b. c d"), (3, "a b. c d\n\na b\n# c d")], "doc_id long, text string")
    found = {r.doc_id: [(m.sentence, m.licence) for m in r.matches] for r in scan(docs, rules).collect()}
    assert found == {
        1: [(0, "Again"), (1, "Again")],
        2: [(0, "Long"), (0, "Quote's"), (2, "Long"), (2, "Quote's"), (4, "Quote's")],
        3: [(0, "Long"), (0, "Quote's"), (2, "Quote's")],
    }


def test_the_plan_has_no_python(spark):
    plan = scan(spark.range(3).selectExpr("id AS doc_id", "'a' AS text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


APACHE = """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS"
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice, this
#    list of conditions and the following disclaimer.
#
# 3. Neither the name of the copyright holder nor the names of its contributors may
#    be used to endorse or promote products derived from this software without
#    specific prior written permission.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
CC0 = "To the extent possible under law, the author has waived all copyright\nand related or neighboring rights to this work.\n"


def test_wrapped_published_headers(spark):
    texts = [APACHE, MIT, GPL, CC0, APACHE.replace("\n", "\r\n"), "Licensed under the Apache License.\nVersion 2.0", "x licensed under CC\nBY-NC 4.0", GPL.replace("any later version", "a later version"), BSD, MPL]
    rows = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: (r.n_sentences, [(m.sentence, m.licence) for m in r.matches]) for r in rows}
    assert all(found[i][0] == brute(t)[0] for i, t in enumerate(texts))
    assert [found[i][1] for i in range(10)] == [[(1, "Apache-2.0")], [(0, "MIT")], [(0, "GPL-3.0-or-later")], [(0, "CC0-1.0")], [(1, "Apache-2.0")], [], [], [], [(0, "BSD"), (6, "BSD-3-Clause")], [(0, "MPL-2.0")]]
