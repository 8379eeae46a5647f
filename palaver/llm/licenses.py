"""License scan by ordered signature rules, in DataFrame functions alone.

A text becomes its words, joined by one space. Words that rules need are looked for first; a rule's expression runs only
over texts that hold all of its own. Detections are intervals of words. One that lies within another gives way to a higher
priority, at equal priority to the longer, and at equal length to the rule that stands first.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Label and phrase; fixed values of the contract.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
BASE_SCORE = 0.95
#: Licenses: label, SPDX identifier, name, a word that the name can't do without, address. All as words and expressions over
#: words; L stands for license in its spellings, V for an optional `version` or `v`.
LICENSES = (
    ("mit", "mit", "(?:mit|expat) L", "L", "opensource org licenses mit"),
    ("mit-0", "mit 0", "mit no attribution(?: L)?", "attribution", "github com aws mit 0"),
    ("apache-1.1", "apache 1 1", "apache(?: software)? LV 1 1", "apache", "apache org licenses license 1 1"),
    ("apache-2", "apache 2 0", "apache(?: software)? LV 2(?: 0)?", "apache", "apache org licenses license 2 0"),
    ("bsd-2", "bsd 2 clause", "(?:(?:2|two) clause bsd(?: L)?|simplified bsd(?: L)?|freebsd L)", "bsd", "opensource org licenses bsd 2 clause"),
    ("bsd-3", "bsd 3 clause", "(?:(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: L)?", "bsd", "opensource org licenses bsd 3 clause"),
    ("bsd-4", "bsd 4 clause", "(?:(?:4|four) clause bsd(?: L)?|original bsd L)", "bsd", "spdx org licenses bsd 4 clause"),
    ("bsd", "bsd", "bsd(?: style)? L", "bsd", "opensource org licenses bsd L"),
    ("0bsd", "0bsd", "(?:zero clause bsd|bsd zero clause)(?: L)?", "bsd", "opensource org licenses? 0bsd"),
    ("isc", "isc", "isc L", "isc", "opensource org licenses isc"),
    ("gpl-1", "gpl 1 0", "gnu general public LV 1(?: 0)?", "gnu", "gnu org licenses old licenses gpl 1 0"),
    ("gpl-2", "gpl 2 0", "gnu general public LV 2(?: 0)?", "gnu", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "gpl 3 0", "gnu general public LV 3(?: 0)?", "gnu", "gnu org licenses gpl 3 0"),
    ("gpl", "gpl", "gnu (?:general public L|gpl)", "gnu", "gnu org licenses gpl html"),
    ("lgpl-2", "lgpl 2 0", "gnu (?:library|lesser) general public LV 2(?: 0)?", "gnu", "gnu org licenses old licenses lgpl 2 0"),
    ("lgpl-2.1", "lgpl 2 1", "gnu lesser general public LV 2 1", "gnu", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", "lgpl 3 0", "gnu lesser general public LV 3(?: 0)?", "gnu", "gnu org licenses lgpl 3 0"),
    ("lgpl", "lgpl", "gnu (?:(?:lesser|library) general public L|lgpl)", "gnu", "gnu org licenses lgpl html"),
    ("agpl-3", "agpl 3 0", "(?:gnu )?affero general public LV 3(?: 0)?", "affero", "gnu org licenses agpl 3 0"),
    ("agpl", "agpl", "(?:gnu )?affero general public L", "affero", "gnu org licenses agpl html"),
    ("gfdl-1.2", "gfdl 1 2", "gnu free documentation LV 1 2", "gnu", "gnu org licenses old licenses fdl 1 2"),
    ("gfdl-1.3", "gfdl 1 3", "gnu free documentation LV 1 3", "gnu", "gnu org licenses fdl 1 3"),
    ("gfdl", "gfdl", "gnu (?:free documentation L|fdl)", "gnu", "gnu org (?:copyleft|licenses) fdl html"),
    ("mpl-1.1", "mpl 1 1", "mozilla public LV 1 1", "mozilla", "mozilla org mpl mpl 1 1"),
    ("mpl-2", "mpl 2 0", "mozilla public LV 2(?: 0)?", "mozilla", "mozilla org (?:en us )?mpl 2 0"),
    ("mpl", "mpl", "mozilla public L", "mozilla", "mozilla org mpl"),
    ("epl-1", "epl 1 0", "eclipse public LV 1(?: 0)?", "eclipse", "eclipse org legal epl v10"),
    ("epl-2", "epl 2 0", "eclipse public LV 2(?: 0)?", "eclipse", "eclipse org legal epl (?:2 0|v20)"),
    ("cddl-1", "cddl 1 0", "common development and distribution LV 1(?: 0)?", "distribution", "opensource org licenses cddl 1 0"),
    ("cddl-1.1", "cddl 1 1", "common development and distribution LV 1 1", "distribution", "spdx org licenses cddl 1 1"),
    ("cpl-1", "cpl 1 0", "common public LV 1(?: 0)?", "common", "opensource org licenses cpl1 0"),
    ("eupl-1.1", "eupl 1 1", "european union public LV 1 1", "european", "spdx org licenses eupl 1 1"),
    ("eupl-1.2", "eupl 1 2", "european union public LV 1 2", "european", "spdx org licenses eupl 1 2"),
    ("artistic-1", "artistic 1 0", "(?:perl )?artistic LV 1(?: 0)?", "artistic", "opensource org licenses artistic 1 0"),
    ("artistic-2", "artistic 2 0", "artistic LV 2(?: 0)?", "artistic", "opensource org licenses artistic 2 0"),
    ("boost-1", "bsl 1 0", "boost software L(?:V 1(?: 0)?)?", "boost", "boost org license 1 0"),
    ("zlib", "zlib", "(?:zlib(?: libpng)?|libpng zlib) L", "zlib", "zlib net zlib L"),
    ("libpng", "libpng", "libpng L", "libpng", "libpng org pub png src libpng license"),
    ("unlicense", "unlicense", "the unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public L", "fuck", "wtfpl net"),
    ("cc0-1", "cc0 1 0", "cc0(?: L)?(?:V 1(?: 0)?)?(?: universal)?", "cc0", "creativecommons org publicdomain zero 1 0"),
    ("cc-pd", "cc pddc", "public domain (?:dedication|mark)(?: 1 0)?", "domain", "creativecommons org publicdomain mark 1 0"),
    ("cc-by", "cc by", "creative commons attribution(?: [1-4] [0-5])?(?: international| unported| generic)? L", "commons", "creativecommons org licenses by [1-4] [0-5]"),
    ("cc-by-sa", "cc by sa", "creative commons attribution share ?alike(?: [1-4] [0-5])?(?: international| unported| generic)?(?: L)?", "commons", "creativecommons org licenses by sa"),
    ("cc-by-nd", "cc by nd", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [0-5])?(?: international| unported| generic)?(?: L)?", "commons", "creativecommons org licenses by nd"),
    ("cc-by-nc", "cc by nc", "creative commons attribution non ?commercial(?: [1-4] [0-5])?(?: international| unported| generic)?(?: L)?", "commons", "creativecommons org licenses by nc"),
    ("cc-by-nc-sa", "cc by nc sa", "creative commons attribution non ?commercial share ?alike(?: [1-4] [0-5])?(?: international| unported| generic)?(?: L)?", "commons", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [0-5])?(?: international| unported| generic)?(?: L)?", "commons", "creativecommons org licenses by nc nd"),
    ("odbl-1", "odbl 1 0", "open (?:data commons open )?database L(?:V 1(?: 0)?)?", "database", "opendatacommons org licenses odbl"),
    ("odc-by-1", "odc by 1 0", "open data commons attribution L(?:V 1(?: 0)?)?", "commons", "opendatacommons org licenses by"),
    ("pddl-1", "pddl 1 0", "public domain dedication and L", "dedication", "opendatacommons org licenses pddl"),
    ("ofl-1.1", "ofl 1 1", "(?:sil )?open font L(?:V 1 1)?", "font", "scripts sil org ofl"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source L", "ncsa", "opensource org licenses ncsa"),
    ("python-2", "psf 2 0", "(?:python software foundation|psf) L(?:V 2)?", "foundation", "docs python org [23] license"),
    ("php-3.01", "php 3 01", "php LV 3 01", "php", "php net license 3 01"),
    ("ruby", "ruby", "ruby L", "ruby", "ruby lang org en about license"),
    ("postgresql", "postgresql", "postgresql L", "postgresql", "postgresql org about licence"),
    ("openssl", "openssl", "openssl L", "openssl", "openssl org source license"),
    ("ms-pl", "ms pl", "microsoft public L", "microsoft", "opensource org licenses ms pl"),
    ("ms-rl", "ms rl", "microsoft reciprocal L", "microsoft", "opensource org licenses ms rl"),
    ("afl-3", "afl 3 0", "academic free LV 3(?: 0)?", "academic", "opensource org licenses afl 3 0"),
    ("osl-3", "osl 3 0", "open software LV 3(?: 0)?", "software", "opensource org licenses osl 3 0"),
    ("upl-1", "upl 1 0", "universal permissive L(?:V 1(?: 0)?)?", "permissive", "oss oracle com licenses upl"),
    ("x11", "x11", "x11 L", "x11", "spdx org licenses x11"),
    ("sspl-1", "sspl 1 0", "server side public L(?:V 1(?: 0)?)?", "server", "mongodb com licensing server side public license"),
    ("busl-1.1", "busl 1 1", "business source L(?:V 1 1)?", "business", "mariadb com bsl11"),
    ("elastic-2", "elastic 2 0", "elastic L(?:V 2(?: 0)?)?", "elastic", "elastic co licensing elastic license"),
    ("openrail-m", "openrail m", "(?:creativeml |bigscience )?open ?rail m(?: L)?", "m", "huggingface co spaces compvis stable diffusion license"),
)
#: Sentences that stand in the licenses themselves, with a word that each needs.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3", "neither the name of (?:\\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products", "endorse"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "advertising"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("apache-2", "you may not use this file except in compliance with the L", "compliance"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public L", "redistribute"),
    ("gpl-2", "gnu general public L(?: as published by the free software foundation)? either version 2(?: of the L)?", "either"),
    ("gpl-3", "gnu general public L(?: as published by the free software foundation)? either version 3(?: of the L)?", "either"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public L", "redistribute"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public L", "redistribute"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public L v(?:ersion)? 2 0", "mozilla"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public L", "eclipse"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("wtfpl", "you just do what the fuck you want to", "fuck"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "liable"),
    ("boost-1", "distributed under the boost software L version 1 0", "boost"),
    ("cc0-1", "to the extent possible under law (?:\\S+ ){1,12}(?:has|have) waived all copyright and related", "waived"),
    ("public-domain", "(?:has been |is |was )?(?:placed|released|dedicated) (?:in|into|to) the public domain", "domain"),
    ("proprietary", "all rights reserved (?:no part of this|unauthori[sz]ed)", "reserved"),
    ("proprietary", "(?:this|the) (?:document|software|work|file) is (?:confidential and proprietary|proprietary and confidential)", "proprietary"),
    ("ofl-1.1", "this font software is L under the sil open font L", "font"),
)
_L, _V = "licen[cs]e[sd]?", "(?: version| v)? v?"
_UNDER = "(?:under|by) (?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?)?"
#: No detection has more words than this; a test holds the rules to it.
WIDEST = 64


def rules() -> list[dict]:
    """Every rule, first the stronger: label, priority, score, pattern over words, the words that a text must hold."""
    full = lambda x: re.sub(r"\bL(?=V|\b)", _L, x).replace("V ", _V)
    word = lambda x: "license" if x == "L" else x
    out = []

    def add(label: str, priority: int, score: float, pattern: str, *needs: str) -> None:
        out.append({"label": label, "priority": priority, "score": score, "pattern": f"(?<= ){pattern}(?= )", "needs": sorted(set(map(word, needs)))})

    for label, spdx, _, _, _ in LICENSES:
        add(label, 90, 1.0, f"spdx license identifier {spdx}(?: only| or later)?", "spdx", "identifier", spdx.split(" ")[0])
    for label, text, needs in SENTENCES:
        add(label, 80, 0.98, full(text), needs)
    for label, spdx, name, needs, address in LICENSES:
        short = spdx.removesuffix(" 0")
        add(label, 70, 0.9, full(_UNDER + name), "under" if needs == "L" else needs)
        add(label, 70, 0.9, full(f"(?:under|by) (?:the )?(?:terms of the )?{short}(?: 0)?(?: only| or later)?(?: L)"), "license", short.split(" ")[0])
        add(label, 65, 0.85, f"(?:licen[cs]ed under|licen[cs]e(?: is)?) (?:the )?{short}(?: 0)?(?: only| or later)?", "license", short.split(" ")[0])
        if re.match(r"[a-z]+ \d", short):
            glued = short.replace(" ", "v", 1)
            add(label, 65, 0.85, f"(?:licen[cs]ed under|under|licen[cs]e(?: is)?) (?:the )?{glued}(?: 0)?(?: only| or later)?", glued.split(" ")[0])
        add(label, 60, 0.8, full(address), address.split(" ")[0])
        add(label, 50, 0.6, full(name), needs)
    return out


def _tree(words: list[str]) -> str:
    """A pattern of any of the words that reads what they begin with once."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    end = "" in by
    inner = "|".join(c + _tree(rest) for c, rest in by.items() if c)
    return "" if not inner else f"(?:{inner})" + ("?" if end else "")


_RULE = "array<struct<rank:int,label:string,priority:int,score:double,pattern:string,needs:array<string>>>"
_FOUND = "array<struct<start:bigint,length:bigint,label:string,priority:int,score:double,rank:int>>"
_FIRST, _LAST = "\x02", "\x03"


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often it stands in there."""
    return F.transform(F.array(value), use)[0]


def words_joined(text: Column) -> Column:
    """The words of a text in ASCII small letters, joined by one space; empty for null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def places(padded: Column, pattern: Column) -> Column:
    """Where a pattern matches, leftmost and not overlapping: array of (start, length) in words. The first and last word of
    each match are marked, and the marks found among the words, so that time is linear in the text."""
    marked = F.regexp_replace(padded, pattern, F.lit(f"{_FIRST}$0{_LAST}"))

    def read(m: Column) -> Column:
        def marks(ws: Column) -> Column:
            at = lambda sign: F.filter(F.transform(ws, lambda w, i: F.when(F.contains(w, F.lit(sign)), i.cast("long"))), lambda i: i.isNotNull())
            return F.zip_with(at(_FIRST), at(_LAST), lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))

        return F.when(F.contains(m, F.lit(_FIRST)), once(F.split(F.trim(m), " "), marks)).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))

    return once(marked, read)


def _reach(found: Column) -> Column:
    """How far back in detections, by start, one may lie that holds another: the first power of two beyond which all end before."""
    clear = lambda w: F.forall(F.transform(found, lambda d, i: F.when(i >= w, F.get(found, i - w)["start"] + WIDEST <= d["start"]).otherwise(True)), lambda x: x)
    return F.aggregate(F.lit([1 << k for k in range(1, 31)]), F.lit(0), lambda w, p: F.when(w > 0, w).when((p > F.size(found)) | clear(p), p).otherwise(0))


def standing(found: Column) -> Column:
    """Detections that no other one holds and outdoes."""

    def by_start(ds: Column) -> Column:
        def within(w: Column) -> Column:
            def holds(d: Column, b: Column) -> Column:
                inside = (b["start"] <= d["start"]) & (b["start"] + b["length"] >= d["start"] + d["length"])
                longer = (b["length"] > d["length"]) | ((b["length"] == d["length"]) & (b["rank"] < d["rank"]))
                return inside & ((b["priority"] > d["priority"]) | ((b["priority"] == d["priority"]) & longer))

            return F.filter(ds, lambda d, i: ~F.exists(F.slice(ds, F.greatest(i - w, F.lit(0)) + 1, 2 * w + 1), lambda b: holds(d, b)))

        return once(_reach(ds), within)

    return F.when(F.size(found) > 1, once(F.array_sort(found), by_start)).otherwise(found)


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", base=BASE, ruled: list[dict] | None = None) -> DataFrame:
    """One row per row of docs: key, n_words, base (array of start, length, label of every place of a base phrase, by start)
    and found (array of start, length, label, priority, score, rank of the detections that stand, by start).

    No word, no place: null, empty and wordless texts have neither. A phrase that repeats is found at each place. Null
    keys, repeated rows and ids stay as they come, other columns are left out. A row is worked on by itself, in time
    linear in its text, so nothing is exchanged.
    """
    ruled = rules() if ruled is None else ruled
    table_of = lambda rs: F.from_json(F.lit(json.dumps(rs)), _RULE)
    listed = [{"rank": i, **r} for i, r in enumerate(ruled)]
    phrases = [{"rank": i, "label": label, "priority": 100, "score": BASE_SCORE, "pattern": f"(?<= ){p}(?= )", "needs": sorted(set(p.split(" ")))} for i, (label, p) in enumerate(base)]
    needed = sorted({w for r in listed + phrases for w in r["needs"]} | {"licence", "licenses", "licences", "licensed", "licenced"})

    def detect(rs: list[dict], padded: Column, hot: Column) -> Column:
        fit = F.filter(table_of(rs), lambda r: F.size(F.array_except(r["needs"], hot)) == 0)
        each = lambda r: F.transform(places(padded, r["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), r["label"].alias("label"), r["priority"].alias("priority"), r["score"].alias("score"), r["rank"].alias("rank")))
        return F.when(F.size(hot) > 0, F.flatten(F.transform(fit, each))).otherwise(F.array().cast(_FOUND))

    # Each inline() is a step whose columns are computed once.
    step = lambda df, *new: df.select("*", F.inline(F.array(F.struct(*new))))
    df = step(docs.select(F.col(key).alias("key"), F.col(text).alias("_text")), words_joined(F.col("_text")).alias("_words")).drop("_text")
    seen = F.regexp_extract_all(F.concat(F.lit(" "), "_words", F.lit(" ")), F.lit(f" ({_tree(needed)})(?= )"), F.lit(1))
    df = step(df, F.array_distinct(F.transform(F.array_distinct(seen), lambda w: F.regexp_replace(w, f"^{_L}$", "license"))).alias("_hot"), F.concat(F.lit(" "), "_words", F.lit(" ")).alias("_padded"))
    df = step(df, detect(phrases, F.col("_padded"), F.col("_hot")).alias("base"), detect(listed, F.col("_padded"), F.col("_hot")).alias("found"))
    df = step(df.withColumnRenamed("found", "_all"), standing(F.col("_all")).alias("found"))
    count = F.when(F.col("_words") == "", 0).otherwise(F.length("_words") - F.length(F.replace("_words", F.lit(" "), F.lit(""))) + 1).cast("long")
    return df.select(F.col("key").alias(key), count.alias("n_words"), F.array_sort("base").alias("base"), "found")


def op11_licenses(spark, sf_dir: str) -> DataFrame:
    """Words, base places and labels, all labels and the best score of every document."""
    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = lambda *of: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(f"{c}.label") for c in of]))), ",")
    return got.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0))["start"].alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        labels("base").alias("base_labels"),
        labels("base", "found").alias("labels"),
        F.coalesce(F.greatest(F.array_max("base.score"), F.array_max("found.score")), F.lit(0.0)).alias("score"),
    )
