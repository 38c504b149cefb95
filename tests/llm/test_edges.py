"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.llm import ann, decontam, hashing, html_extract, licenses, line_dedup, mixing, ngram_join, suffix_dedup, toxicity, warc

LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(20_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs far away", "a"),
    (2, "", "b"),
    (3, None, None),
    (4, LONG, "b"),
    (5, "one", None),
    (6, " \n\t ", "a"),
    (None, "no id here but some words to read in any case", "c"),
]
SCHEMA = "doc_id long, text string, source string"
EXTRA = ["r", "_t", "w", "n", "drop", "_gone", "size", "score", "line", "gram"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in EXTRA}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(9, "brown fox jumps over the lazy dog and runs far"), (8, "no id"), (7, None), (None, "quick brown fox")], "item_id long, text string")
    out = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in decontam.decontaminate(docs, bench).collect()}
    assert (1, 11, ("9",)) in out and (None, 2, ("8",)) in out and (2, 0, ()) in out and (3, 0, ()) in out and (4, 0, ()) in out
    assert decontam.decontaminate(docs, bench).count() == len(ROWS)
    assert decontam.decontaminate(none, bench).count() == 0
    assert decontam.decontaminate(docs, bench.filter("false")).agg(F.sum("n_hit")).first()[0] == 0
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3, 4, 5, 6}


def test_long_texts_in_one_batch(spark):
    """Some hundred long texts in one partition are read in slices of bounded bytes; each loses what it shares."""
    import numpy as np

    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(20_000)])
    rows = [(k, "\n".join(" ".join(words[rng.integers(0, len(words), 20)]) for _ in range(1000))) for k in range(60)]
    rows += [(100 + k, t) for k, t in rows[:3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = dict(line_dedup.drop_duplicate_lines(df).collect())
    assert [k for k, t in out.items() if not t] == [100, 101, 102] and all(out[k] == t for k, t in rows[:60])
    groups = {r.doc_id: r.component_id for r in ngram_join.similar_groups(df).collect()}
    assert groups == {k: k % 100 for k, _ in rows}


def test_line_dedup(spark, docs, none):
    out = line_dedup.drop_duplicate_lines(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert {r.doc_id: r.text for r in out.collect()}[4] == LONG
    assert line_dedup.drop_duplicate_lines(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d\nfirst line here\na b c d"), (2, "A, b; c d!\nother words follow now")], "doc_id long, text string")
    got = dict(line_dedup.drop_duplicate_lines(twice).collect())
    assert got == {1: "a b c d\nfirst line here", 2: "other words follow now"}


def test_suffix_dedup(docs, none):
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, depth=40).collect()}
    assert len(out[1]["spans"]) == 1 and bytes(out[1].kept) == b"" and out[2].n_bytes == 0 and out[3].n_bytes == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_ngram_join(docs, none):
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()]
    assert len(out) == len(ROWS) and (2, 0, 2) in out and (3, 0, 3) in out and (5, 1, 5) in out and (6, 0, 6) in out
    assert [x for x in out if x[0] is None][0][2] is None
    assert ngram_join.similar_groups(none).count() == 0
    assert ngram_join.keep_one(docs).columns == docs.columns and ngram_join.keep_one(docs).count() == len(ROWS)


def test_mixing(docs, none):
    out = mixing.mix(docs, [1, 2, 3]).drop("r").collect()
    assert len(out) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in out)
    assert {r.doc_id: r["size"] for r in out}[3] == 0
    assert mixing.mix(none, [1, 2, 3]).count() == 0
    assert mixing.emit(docs, [1, 2, 3]).columns == [*docs.columns, "mix_copy"]
    assert sorted(map(str, mixing.mix(docs.repartition(5), [1, 2, 3]).drop("r").collect())) == sorted(map(str, out))


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (99, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model, into="tox").collect()
    assert len(out) == len(ROWS) and all(0 <= r.tox <= 1 for r in out)
    assert toxicity.train(none, labels) is None and toxicity.train(docs, labels.filter("false")) is None
    assert toxicity.score(none, None).count() == 0


def test_licenses(spark, docs, none):
    assert licenses.detect_licenses(none).count() == 0
    assert licenses.detect_licenses(docs).agg(F.sum("n_known")).first()[0] == 0
    text = "Intro.\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\nReleased under the MIT license!"
    r = licenses.detect_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.licenses == ["Apache-2.0", "MIT"] and [m["rule"] for m in r.matches] == ["apache-header", "mit-released"]


def test_pipeline_toxicity_keeps_columns(spark):
    """Columns of the names the stage uses itself come through with their own values, nulls and empty texts too."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit("mine")).withColumn("_toxicity", F.lit(7)).withColumn("r", F.lit(1))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("text")))
    out = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert out.exceptAll(docs).count() == 0 and out.filter("text is null").count() == docs.filter("text is null").count()


def test_nearest(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (50, [1.0, 1e-3]), (7, [1e200, 1e200])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("bucket", F.lit(1))
    out = ann.nearest(v, v.filter("vec_id % 50 = 0"), k=5).collect()
    got = {q: [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
    assert got == {0: [1, 50, 7, 2], 50: [0, 1, 7, 2]}
    assert ann.nearest(v.filter("false"), v.filter("false")).count() == 0


def test_nearest_parts(spark):
    """Cells of few vectors over two copies, hot cells in parts, repeated ids and copies: each query's neighbours are exact where every code is within its bound."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(400, 8)), np.tile(rng.normal(size=(1, 8)), (200, 1))]
    ids = np.r_[np.arange(590), [7] * 10]
    v = spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    out = ann.nearest(v, v.filter("vec_id % 50 = 0"), k=5, tables=4, fill=1, recall=1.0, fit=1000, block=16, calls=3).toPandas()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 590, 50):
        s = np.full(590, -2.0)
        np.maximum.at(s, ids, np.round(u @ u[i], 12))
        s[i] = -2
        own = out[out.query_id == i].sort_values("rank")
        assert own.vec_id.tolist() == np.lexsort((np.arange(590), -s))[:5].tolist() and np.allclose(own.score, s[own.vec_id])


def test_cells_within_bound():
    """A cell is probed if and only if one of its codes costs no more than the bound."""
    table = ann.rotations(4, 1, 2, 3, 5)[0]
    x = np.random.default_rng(1).normal(size=(20, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    one, two = (ann.costs(x, s) for s in table)
    total = (one[:, :, None] + two[:, None, :]).reshape(20, 64)
    for cells in (1, 4, 8, 16, 64):
        r, c = ann._within(x, table, cells, 0.4)
        assert set(zip(r.tolist(), c.tolist(), strict=True)) == {(i, j) for i in range(20) for j in range(cells) if total[i].reshape(cells, -1)[j].min() <= 0.4}



def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (None, "n", "<p>x</p>"), (5, "h", "é" * 70_000), (1, "http://a/", "<p>x</p>")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    warc.write_pages(p, f"file://{tmp_path}/w")
    back = warc.read_archive(spark, f"file://{tmp_path}/w").collect()
    assert sorted(r.record_type for r in back) == ["response"] * 4 + ["revisit"] * 3
    by = {r.record_id: r for r in back}
    assert bytes(by["urn:page:5"].payload).decode() == "é" * 70_000 and by["urn:page:4"].refers_to == "urn:page:3"
    assert by["urn:page:2"].payload_digest == warc.digest(b"<p>x</p>") and by["urn:page:2"].payload_bytes == 8
    some = warc.read_archive(spark, f"file://{tmp_path}/w", ["record_id", "record_type"]).filter("record_type = 'revisit'")
    assert some.count() == 3
    warc.write_pages(p.filter("false"), f"file://{tmp_path}/e")
    assert warc.read_archive(spark, f"file://{tmp_path}/e").count() == 0


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><header>Top</header>{}<aside>Side</aside><div class='cookie-notice'>Cookies</div><footer>&copy; x</footer>"
    rows = [(1, "http://h.org/1", page.format("<article><h1>A &amp; B</h1><p>one  <b>two</b>\n three<p>four<div class='comments'><p>no</p></div></article>")), (2, "http://h.org/2", None), (3, None, ""), (4, "x", page.format("<div><p>free text</p></div><script>if (a<b) x('<p>')</script>"))]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h"))
    out = {r.page_id: r for r in html_extract.extract_main_text(p).collect()}
    assert out[1].text == "A & B\none two three\nfour" and out[1].n_chars == 24 and out[2].text == "" and out[3].n_chars == 0 and out[4].text == "free text"
    assert html_extract.extract_main_text(p.filter("false")).count() == 0


def test_html_template(spark):
    pages = [(i, f"http://host.org/{i}", f"<div><p>Menu of the site</p></div><div><p>Story {i} is told here</p></div>") for i in range(6)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract_main_text(p).collect()} == {i: f"Story {i} is told here" for i in range(6)}


def test_sha_of_kept(spark):
    docs = spark.createDataFrame([(1, "x" * 50 + "abc"), (2, "y" * 10)], "doc_id long, text string")
    out = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs, depth=40).collect()}
    assert out == {1: b"abc", 2: b"y" * 10} and len(hashlib.sha256(out[1]).hexdigest()) == 64


def test_gram_of_many_contexts(spark):
    """Some 4,000 distinct contexts of one gram, more bytes than one pass of hashes holds, in one task."""
    import numpy as np

    letters, gram = np.random.default_rng(5).integers(97, 123, 2 * hashing.PIECE).astype(np.uint8), suffix_dedup.GRAM
    at = np.arange(len(letters) - gram + 1)
    least = int(hashing.span_hashes(hashing.prefix_sums(letters), at, at + gram).argmin())
    gram = letters[least : least + suffix_dedup.GRAM].tobytes().decode()
    side = np.random.default_rng(6).integers(97, 123, (4000, 736)).astype(np.uint8)
    rows = [(i, x[:368].tobytes().decode() + gram + x[368:].tobytes().decode()) for i, x in enumerate(side)]
    rows[1] = (1, rows[0][1][:450] + rows[1][1][450:])
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_t", F.xxhash64("text"))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.repeated_spans(d).collect()}
    end = next(i for i in range(450, 768) if rows[0][1][i] != rows[1][1][i])
    assert got == {0: [(0, end)], 1: [(0, end)]}


def test_licenses_as_published(spark):
    """Every rule matches its own sentences: on one line, one to a line, wrapped, and wrapped within comment marks."""
    import textwrap

    rows, want = [], []
    for rule, _, ids in licenses.RULES:
        own = [licenses.SENTENCES[i].replace("{}", "Foo Inc. and its partners") for i in ids]
        wrapped = textwrap.wrap(" ".join(own), 40, break_on_hyphens=False)
        for text in (" ".join(own), "\n".join(own), "\n".join(wrapped), "\n".join(f" * {x}" for x in wrapped), "#!/bin/sh\n" + "".join(f"# {x}\r\n" for x in wrapped) + "#\r\nimport sys"):
            rows.append((len(rows), text))
            want.append([rule])
    rows += [(len(rows), "All rights\n\nreserved."), (len(rows) + 1, "Nearly all rights reserved."), (len(rows) + 2, "All rights reserved by them.")]
    want += [[]] * 3
    got = {r.doc_id: [m["rule"] for m in r.matches] for r in licenses.detect_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_article_structure():
    """Words of a class drop nothing inside an article, whole names do; a page cut off inside a tag is read once."""
    import time

    page = "<article><div class='post-header'><h1>Title</h1></div><p class='alert'>note</p><section class='related-work'>rel</section><p>body</p><div class='comments'><p>me too</p></div></article>"
    assert html_extract.extract_text(page) == "Title\nnote\nrel\nbody"
    for tail in ("<a " + "b" * 1_000_000, "<a " * 100_000, "<a href=\"" + "b" * 1_000_000, "<p" + " a='" * 100_000):
        began = time.time()
        assert html_extract.extract_text("<p>text</p>" + tail).startswith("text") and time.time() - began < 5


def test_template_of_a_host(spark):
    """Constant blocks and menus of links go with or without an article element, whatever their class; copies and variants of a page make no template."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    menu = "".join(f"<div class='z'><a href='/{i}'>Item {i}</a></div>" for i in range(4))
    shape = "<html><body><div class='q'>{menu}</div><div class='m'><h1>Head {k}</h1><p>{text}</p><p>Seen everywhere on this host</p></div><div class='b'>Small print</div></body></html>"
    rows = [(k, f"http://plain.example/{k}", shape.format(menu=menu, k=k, text=words(k))) for k in range(5)]
    rows += [(10 + k, f"http://art.example/{k}", f"<body><article><h1>Head {k}</h1><p>We use crumbs</p><p>{words(k)}</p></article></body>") for k in range(4)]
    rows += [(20 + k, f"http://copies.example/{k}", "<body><p>one text</p><p>two text</p></body>") for k in range(4)]
    rows += [(30 + k, f"http://variants.example/{k}", f"<body><article><p>{words(1)}</p><p>{words(2)}</p><p>last {k}</p></article></body>") for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()}
    assert all(got[k] == f"Head {k}\n{words(k)}" for k in range(5))
    assert all(got[10 + k] == f"Head {k}\n{words(k)}" for k in range(4))
    assert all(got[20 + k] == "one text\ntwo text" for k in range(4))
    assert all(got[30 + k] == f"{words(1)}\n{words(2)}\nlast {k}" for k in range(4))


def test_notice_longer_than_the_stories(spark):
    """A host's notice goes though it is longer than each story; labels inside an article go, words of other names stay."""
    notice = "We value what you read here and keep small files on your device for it. " * 4
    rows = [(k, f"http://n.example/{k}", f"<body><article><p>{notice}</p><p>Story number {k} tells what happened on day {k * 7}.</p></article></body>") for k in range(6)]
    inner = "".join(f"<div {c}>Buy now</div>" for c in ("class='ad-slot'", "id='comments-area'", "class='post-comments'", "class='cookie-consent-bar'", "class='newsletter-signup'", "class='share-buttons'"))
    kept = "<div class='share-price'>Shares rose</div><div class='ad-hoc'>A group met</div><div class='social-history'>How they lived</div>"
    rows += [(10, "http://a.example/", f"<article><p>Start</p>{inner}{kept}<p>End</p></article>")]
    rows += [(11, "http://b.example/", "<div class='alert-box story'><p>All of it</p><ul><li>one</li><li><a href='/'>two</a></li></ul></div><ul><li><a>Home</a></li><li><a>News</a></li></ul><div class='alert-box'>Hurry</div>")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Story number {k} tells what happened on day {k * 7}." for k in range(6))
    assert got[10] == "Start\nShares rose\nA group met\nHow they lived\nEnd" and got[11] == "All of it\none\ntwo"


def test_deep_pages_take_linear_memory():
    import time
    import tracemalloc

    for page in ("<div>" * 200_000 + "deep", "<div class='x/y'><p>t</p>" * 30_000, "<ul><li>" * 60_000 + "x"):
        tracemalloc.start()
        began = time.time()
        assert html_extract.extract_text(page)
        assert tracemalloc.get_traced_memory()[1] < 200 << 20 and time.time() - began < 20
        tracemalloc.stop()


def test_lines_of_negative_ids(spark):
    """Near lines of documents with ids below zero; the least id keeps its line."""
    a = "the quick brown fox jumps over the lazy dog and then it runs far away from here"
    rows = [(-5, "first of five\n" + a), (-3, "other of three\n" + a.replace("lazy", "hazy")), (2, "unlike\n" + a)]
    out = {r.doc_id: r.text for r in line_dedup.drop_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {-5: rows[0][1], -3: "other of three", 2: "unlike"}


MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice{next} shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """ * Redistribution and use in source and binary forms, with or without modification,
 * are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 *
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
{third}"""
NEITHER = """ *
 * 3. Neither the name of {name} nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
"""
GPL2 = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_licenses_of_common_files(spark):
    """Licence texts as files have them, and SPDX expressions."""
    bsd3 = BSD.replace("{third}", NEITHER)
    cases = [
        (MIT.replace("{next}", ""), ["MIT"]),
        (MIT.replace("{next}", " (including the next paragraph)"), ["MIT"]),
        (bsd3.replace("{name}", "the copyright holder"), ["BSD-3-Clause"]),
        (bsd3.replace("{name}", "Foo Inc."), ["BSD-3-Clause"]),
        (bsd3.replace("{name}", "the University of Somewhere, its Regents,"), ["BSD-3-Clause"]),
        (BSD.replace("{third}", ""), ["BSD-2-Clause"]),
        (GPL2, ["GPL-2.0-or-later"]),
        (ISC, ["ISC"]),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint main;", ["Apache-2.0", "MIT"]),
        ("# SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0-only"]),
        ("/* SPDX-License-Identifier: GPL-2.0+ */", ["GPL-2.0-or-later"]),
        ("/* SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) OR BSD-3-Clause */", ["BSD-3-Clause", "GPL-2.0-only"]),
        ("SPDX-License-Identifier: (MIT AND (BSD-2-Clause OR 0BSD))", ["0BSD", "BSD-2-Clause", "MIT"]),
        ("SPDX-License-Identifier: MITNFA", []),
        ("to the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work.", ["CC0-1.0"]),
        ("Neither the name of the game nor the names of the players were known.", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.detect_licenses(df).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
