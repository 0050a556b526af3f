import re

import pyarrow.parquet as pq
import pytest

from fleetlake.llm import license_scan as m
from fleetlake.llm.license_templates import TEMPLATES

PLAIN = "The ship left the port under a clear sky, and all of its crew went to work in the morning."


@pytest.fixture(scope="module")
def model():
    words = [set(re.split("[^a-z0-9]+", f"{PLAIN} this is a free version of the work {i}".lower())) for i in range(60)]
    return m.fit([sorted(w) for w in words])


def grams(line):
    w = [x for x in re.split("[^a-z0-9]+", line.lower()) if x]
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


def brute(docs, model):
    """Score every paragraph without the bound."""
    out = set()
    for doc_id, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            own = grams(line)
            p = model.probabilities(own)
            if 1 - p[-1] >= model.least:
                family = model.families[int(p[:-1].argmax())]
                share = max(len(own & set(m.template_grams(t))) / len(m.template_grams(t)) for t in TEMPLATES[family])
                out.add((doc_id, i, family, round(float(p[:-1].max()), 6), round(share, 6), share >= m.CONFIRMED))
    return out


def got(df):
    return {(r.doc_id, r.paragraph, r.family, round(r.probability, 6), round(r.template_share, 6), r.confirmed) for r in df.collect()}


def test_templates_and_variations_are_told_apart(model):
    for family, texts in TEMPLATES.items():
        for text in texts:
            for line in (text, text.upper(), f"{PLAIN} {text}", text.replace(" ", "  ") + " " + PLAIN):
                p = model.probabilities(grams(line))
                assert model.families[int(p[:-1].argmax())] == family and 1 - p[-1] >= model.least, (family, line)
    for line in ("", PLAIN, "the of a in to", "this work was free", "the public", "version 2"):
        assert 1 - model.probabilities(grams(line))[-1] < model.least, line


def test_bound_and_joins_equal_scoring_every_paragraph(make_docs, model):
    docs = [(i, f"{PLAIN}\n{t}\n{t} {PLAIN}\n{' '.join(t.split()[::2])}") for i, t in enumerate(x for v in TEMPLATES.values() for x in v)]
    docs += [(100, None), (101, ""), (102, PLAIN * 50), (103, "Released under the MIT License. " * 300), (103, "Released under the MIT License. " * 300),
             (None, "Licensed under CC BY-NC 4.0.")]
    rows = m.licences(make_docs(docs).selectExpr("*", "lang AS family", "doc_id AS grams", "lang AS line"), model)
    assert got(rows) == brute(docs, model)


def test_empty_table(make_docs):
    assert m.licences(make_docs([])).collect() == []


def test_query_finds_the_licence_lines(spark, run_query):
    d = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    marks = {"apache license, version 2.0": "apache-2.0", "the mit license": "mit", "cc by-nc 4.0": "cc-by-nc", "gnu general public license": "gpl"}
    expected = {(r["doc_id"], i, f) for r in docs for i, line in enumerate(r["text"].split("\n")) for k, f in marks.items() if k in line.lower()}
    rows = run_query("op9_license_scan", d)
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in rows if r["confirmed"]} == expected
    model = m.train(spark.read.parquet(f"{d}/documents.parquet"))
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in rows} == {x[:3] for x in brute([(r["doc_id"], r["text"]) for r in docs], model)}


MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify and merge")
WRAPPED = {
    "mit": MIT,
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
           "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
            "License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
            "and redistribute it freely, subject to the following restrictions",
}


def test_wrapped_notices_are_confirmed_where_they_start(make_docs, model):
    import textwrap

    docs, expected, at = [], set(), 0
    for width in (30, 72):
        for family, text in WRAPPED.items():
            for mark, gap in (("", "\n"), ("# ", "")):
                lines = [mark + x for x in textwrap.wrap(text, width)]
                docs.append((at, "\n".join([PLAIN, PLAIN]) + "\n" + gap + "\n".join(lines) + "\n" + gap + PLAIN))
                # the templates of the GNU family start at "you can redistribute"
                first = next(i for i, x in enumerate(lines) if "you" in x) if "gpl" in family else 0
                expected.add((at, 2 + len(gap) + first, family))
                at += 1
    docs.append((None, "\n".join(textwrap.wrap(MIT, 72))))
    docs.append((None, PLAIN + "\n" + PLAIN))
    rows = [r for r in m.licences(make_docs(docs), model).collect() if r.confirmed]
    assert sorted(((r.doc_id, r.paragraph, r.family) for r in rows), key=str) == sorted(expected | {(None, 0, "mit")}, key=str)
