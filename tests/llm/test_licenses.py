"""The licence scan against plain Python."""

import re
import time

import pytest

import __spark_entry__ as entry_module
from recordflow.llm.license_rules import GATES, rules, written
from recordflow.llm.licenses import scan

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text):
    ws = words(text)
    hits = [(i, p) for p in BASE for i in range(len(ws)) if tuple(ws[i : i + len(p)]) == p]
    places = [i for i, _ in hits]
    return len(ws), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({BASE[p] for _, p in hits}))


def own(text):
    norm = " " + "".join(w + " " for w in words(text))
    found = []
    for r in rules():
        if f" {r.keyword}" in norm:
            found += [(m.start(), m.end(), r) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm)]
    found.sort(key=lambda d: (d[0], -d[1], d[2].priority, d[2].label, d[2].weight))
    kept = []
    for d in found:
        if kept and d[1] <= kept[-1][1]:
            continue
        if kept and d[0] < kept[-1][1]:
            if d[2].priority < kept[-1][2].priority:
                kept[-1] = d
            continue
        kept.append(d)
    return {d[2].label for d in kept}, max([d[2].weight for d in kept], default=0.0)


def check(row, text):
    want, (labels, weight) = base(text), own(text)
    assert tuple(row[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want, text
    assert row["labels"] == ",".join(sorted(labels | set(filter(None, want[4].split(","))))), text
    assert row["score"] == max(weight, 0.5 if want[1] else 0.0) and 0 <= row["score"] <= 1


def test_there_are_hundreds_of_written_rules():
    assert len(written()) > 200 and len({r.pattern for r in written()}) == len(written())
    for r in rules():
        assert any(g in f" {r.keyword} " or g in f" {r.keyword}" for g in GATES), r


def test_matches_have_their_keyword():
    """A sentence for each alternative of each pattern, made of its plain parts."""
    for r in rules():
        for text in texts_of(re._parser.parse(r.pattern)):
            if re.fullmatch(r.pattern, text):
                assert f" {r.keyword}" in f" {text}", (r, text)


def texts_of(parsed):
    """Some texts that a pattern matches: every branch once, repeats at their least and most (up to two)."""
    out = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "NOT_LITERAL":
            more = ["x"]
        elif name == "IN":
            first = value[0]
            more = [chr(first[1]) if str(first[0]) == "LITERAL" else chr(first[1][0]) if str(first[0]) == "RANGE" else "x"]
        elif name == "BRANCH":
            more = [t for branch in value[1] for t in texts_of(branch)]
        elif name == "SUBPATTERN":
            more = texts_of(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            inner = texts_of(value[2])
            more = [t * n for n in {value[0], min(value[1], max(value[0], 1))} for t in inner]
        else:
            raise AssertionError(name)
        out = [a + b for a in out[:300] for b in more]
    return list(dict.fromkeys(out))


# A notice as it stands in real files, and labels it must have.
NOTICES = [
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("Eclipse Public License - v 2.0", "epl-2.0"), ("GPLv3", "gpl-3"), ("BSD-3-Clause license", "bsd-3-clause"),
    ("it under the terms of the GNU General Public License as published by\n the Free Software Foundation; either version 3 of the License, or\n (at your option) any later version.", "gpl-3"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
    ("GNU Affero General Public License version 3", "agpl-3"), ("Licensed under the Apache License, Version 2.0 (the \"License\");", "apache-2.0"),
    ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd"),
    ("Distributed under the Boost Software License, Version 1.0.", "boost-1.0"), ("CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"),
    ("https://creativecommons.org/licenses/by-nd/3.0/", "cc-by-nd-3.0"), ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("SIL Open Font License, Version 1.1", "ofl-1.1"),
    ("The Software shall be used for Good, not Evil.", "json"), ("CC0 1.0 Universal", "cc0"), ("Python Software Foundation License Version 2", "python-2.0"),
]


@pytest.mark.parametrize(("text", "label"), NOTICES)
def test_usual_notices(text, label):
    assert label in own(text)[0], own(text)


def test_long_repeated_notices_take_seconds(spark):
    notice = "Licensed under the Apache License Version 2.0. All rights reserved. "
    docs = spark.createDataFrame([(1, notice * 15_000), (2, notice * 40)], "doc_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r for r in scan(docs).collect()}
    assert time.monotonic() - began < 60
    assert got[1]["labels"] == got[2]["labels"] and got[1]["n_base"] == 15_000 and "apache-2.0" in got[1]["labels"].split(",")
    check(got[2], notice * 40)


def test_phrases_and_rules(spark):
    texts = [
        "", None, " .,;\n", "cc by cc by", "CC-BY all rights reserved. ALL\nRIGHTS-RESERVED", "Licensed under CC BY-NC 4.0.", "acc by", "cc bye",
        "Licensed under the Apache License, Version 2.0", "This is licensed under the GNU General Public License, version 3 or later.",
        "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: BSD-3-Clause", "https://creativecommons.org/licenses/by-sa/4.0/",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the MIT License",
        "GNU Lesser General Public License version 2.1", "Copyright (c) 2020 x. All rights reserved", "é all rights reserved ü", "the license of the gnu general public license is gpl 3",
        "word " * 20000 + "all rights reserved " * 50, "gpl v2 or later license terms of the license agreement " * 7 + "mit license",
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in scan(docs).collect():
        check(r, texts[r["doc_id"]])
    assert scan(docs.limit(0)).count() == 0 and scan(docs).columns.count("labels") == 1


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in entry_module.queries()["op7_licenses"](spark, SF_DIR).collect():
        check(r, texts.pop(r["doc_id"]))
    assert not texts
