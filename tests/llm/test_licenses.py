from __future__ import annotations

import random
import re

import pytest
from palaver.llm import licenses

from .conftest import prose

LINES = [
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
    "SPDX-License-Identifier: BSD-3-Clause", "under the MIT licence", "https://creativecommons.org/licenses/by-sa/4.0/", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "GNU Lesser General Public License v2.1", "license: MIT", "Das ist mit Lizenz, mit freundlichen Grüßen", "CC·BY·NC", "cc by nc sa", "APACHE\tLICENSE -- version 2", "the MIT campus under the sun",
    "this is free and unencumbered software released into the public domain", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "Mozilla Public License Version 2.0",
]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, rules):
    """Each rule at each word, without gates; then every pair of detections."""
    words = words_of(text)
    line = " " + " ".join(words) + " "
    found = []
    for rank, r in enumerate(rules):
        for m in re.finditer(r["pattern"], line):
            start = line.count(" ", 0, m.start()) - 1
            found.append((start, m[0].count(" ") + 1, r["label"], r["priority"], r["score"], rank))

    def beaten(d):
        return any(b[0] <= d[0] and b[0] + b[1] >= d[0] + d[1] and (b[3] > d[3] or b[3] == d[3] and (b[1] > d[1] or b[1] == d[1] and b[5] < d[5])) for b in found)

    base = [(i, label) for label, p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(base), sorted(d for d in found if not beaten(d))


def query_row(i, text, rules):
    n, base, found = brute(text, rules)
    labels = lambda xs: ",".join(sorted(set(xs)))
    scores = [licenses.BASE_SCORE] * bool(base) + [d[4] for d in found]
    return (i, n, len(base), min(base)[0] if base else None, max(base)[0] if base else None, labels(b[1] for b in base), labels([b[1] for b in base] + [d[2] for d in found]), max(scores, default=0.0))


def test_rules_are_many_ordered_and_no_wider_than_said():
    rules = licenses.rules()
    assert len(rules) > 300 and len({r["label"] for r in rules}) > 60
    for r in rules:
        re.compile(r["pattern"])
        assert not re.search(r"(?<!\\S)[+*](?!\?)|\{\d+,\}", r["pattern"].replace(r"\S+", "w"))
        wide = r["pattern"].count(" ") + sum(int(x) for x in re.findall(r"\{1,(\d+)\}", r["pattern"])) + 1
        assert wide <= licenses.WIDEST


def test_query_against_brute_force(spark, tmp_path, clashing):
    rng, rules = random.Random(4), licenses.rules()
    texts = [None, "", " .,- ", "\x00\x1f", *LINES]
    for _ in range(60):
        texts.append("\n".join(rng.choice([prose(rng, 8), *LINES]) for _ in range(rng.randrange(1, 9))))
    texts += [" ".join(LINES), "\n".join([LINES[2]] * 400), "Licensed under " * 20 + "the MIT license", "Ä under the MIT license \U0001f600 cc by nc"]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(3, texts[7]), (7, texts[7])]
    clashing(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in licenses.op11_licenses(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((query_row(i, t, rules) for i, t in rows), key=repr)
    assert {"gpl-3", "mit", "apache-2", "cc-by-nc", "bsd-3", "cc-by-sa", "lgpl-2.1", "unlicense", "agpl"} <= {x for r in got for x in r[6].split(",")}


def test_detections_that_stand(spark):
    """Of each text the labels that are left, in order; a held interval gives way, an overlapping one does not."""
    cases = {
        "GNU Lesser General Public License version 2.1": ["lgpl-2.1"],
        "licensed under the GNU Affero General Public License version 3": ["agpl-3"],
        "SPDX-License-Identifier: MIT": ["mit"],
        "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International": ["cc-by-nc-sa"],
        "we run it under PostgreSQL and FreeBSD; mit freundlichen Grüßen an Apache": [],
        "MIT License and ISC License": ["mit", "isc"], "Licensed under GPLv3 or later.": ["gpl-3"], "MPL-2.0 License; Apache Licence v2": ["apache-2"],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: [d["label"] for d in r["found"]] for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_a_long_text_of_many_detections(spark):
    text = "Released under the MIT License. " * 20_000 + "end"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], len(r["base"]), len(r["found"]), r["base"][-1]["start"]) == (100_001, 20_000, 20_000, 99_996)


def test_own_phrases_and_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([("a", "house rules apply: house rules apply", 1)], "id string, body string, base int")
    r = licenses.scan(df, key="id", text="body", base=[("house", "rules apply")]).first()
    assert [(b["start"], b["label"]) for b in r["base"]] == [(1, "house"), (4, "house")] and r["found"] == []


@pytest.mark.parametrize("phrase", [p for _, p in licenses.BASE])
def test_phrases_only_at_whole_words(spark, phrase):
    df = spark.createDataFrame([(1, f"x{phrase}"), (2, f"{phrase}x"), (3, phrase.upper().replace(" ", "--")), (4, phrase.replace(" ", " "))], "doc_id long, text string")
    assert {r["doc_id"]: len(r["base"]) for r in licenses.scan(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
