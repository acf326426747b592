import random
import re
import textwrap
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from llm_cases import SCHEMA, odd_rows, row

from casemill.llm import licenses, line_dedup, queries, url_filter
from casemill.llm.components import components

PAGES = "page_id long, url string, html string, host string, path string, rule string, verdict string, address string"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_sql(name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(table, df.toArrow())
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    return names, sorted(cur.fetchall(), key=repr)


# ---- components ----

def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (300, 200), (200, 300), (50, 30)]
    out = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert out == {**{i: 0 for i in range(1, 41)}, 50: 0, **{100 + i: 100 for i in range(1, 60)}, 300: 200}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


# ---- URL filter ----

def page(page_id, url, html=None):
    return page_id, url, html, "h", "p", "r", "v", "a"


ODD_PAGES = [
    page(1, None), page(2, ""), page(3, "no scheme"), page(4, "http://a.EXAMPLE.net/en/x?q#f"), page(5, "http://example.net/de"),
    page(6, "https://x.example.com/de/1"), page(7, "https://x.example.com/de"), page(8, "ftp://org/fr/"), page(9, "http://notexample.net"),
    page(10, "http://a.net"), page(11, "http://b.org/en/1", '<link rel="canonical" href="http://spam.net/1">'),
    page(12, "http://c.org/en/2", "<LINK href='//b.org/en/1' rel=canonical>"), page(13, "http://d.org/x/3", '<meta http-equiv="refresh" content="0; url=../3">'),
    page(14, "http://e.com/1", '<meta http-equiv="refresh" content="0;url=http://f.com/2">'), page(15, "http://f.com/2", '<link rel="canonical" href="http://h.org/fr/9">'),
    page(16, "http://g.com/a/b", '<link rel="canonical" href="/ok">'), page(17, "http://g.com/ok"), page(17, "http://g.com/ok"),
    page(None, "http://spam.net/1#top"), page(18, "https://spam.net/1"), page(19, "http://q.com/1", '<link rel="canonical" href="http://spam.net/2">'),
    page(20, "http://f.com/2?x", '<link rel="canonical" href="http://spam.net/2"><meta http-equiv="refresh" content="0;url=http://h.org/fr/9">'),
    page(21, "a://b://c"), page(22, "http://" + "x." * 3000 + "net/" + "y" * 5000),
]


def test_url_verdicts(spark):
    out = url_filter.judged_urls(spark.createDataFrame(ODD_PAGES, PAGES), url_filter.rule_table(spark, queries.URL_RULES))
    said = {r["page_id"]: (r["host"], r["rule"], r["verdict"], r["reason"]) for r in out.collect()}
    assert out.count() == len(ODD_PAGES)
    assert said[1] == said[2] == said[3] == ("", None, "allow", "default")
    assert said[4] == ("a.example.net", "example.net/en/", "allow", "rule") and said[5][1:3] == ("net/", "block")
    assert said[6][1] == "example.com/de/" and said[7][1] is None and said[8][1] == "org/fr/"
    assert said[9] == ("notexample.net", None, "allow", "default") and said[10][1] is None
    assert said[11][2:] == said[12][2:] == ("block", "alias") and said[13][2:] == ("allow", "default")
    assert said[14][2:] == said[15][2:] == ("allow", "default") and said[16][2:] == ("allow", "default")
    assert said[19][2:] == ("allow", "default") and said[20][2:] == ("allow", "default"), "an allowed address of the component comes first"


def test_redirect_table_and_sql(spark):
    docs = spark.createDataFrame(ODD_PAGES, PAGES)
    out = url_filter.judged_urls(docs, url_filter.rule_table(spark, queries.URL_RULES))
    names, want = by_sql("op1_url_filter", pages=docs.select("page_id", "url", "html"))
    assert got(out.select(*names)) == want
    moved = spark.createDataFrame([("http://g.com/ok", "http://spam.net/9"), (None, "x")], "url string, target string")
    out = url_filter.judged_urls(docs, url_filter.rule_table(spark, queries.URL_RULES), moved)
    assert {r["verdict"] for r in out.where("page_id IN (16, 17)").collect()} == {"block"}
    none = url_filter.judged_urls(spark.createDataFrame([], PAGES), url_filter.rule_table(spark, []))
    assert none.count() == 0


# ---- line dedup ----

def plain(line):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[0-9]+", "0", line)))


def brute_lines(rows):
    """Lines are dropped that recur as they are, or whose fixed words recur, word by word and leaf by leaf."""
    lines = [(r[:2], k, plain(x)) for r in set((r[0], r[1]) for r in rows if r[1] is not None) for k, x in enumerate(r[1].split("\n"))]
    by_line, by_leaf = defaultdict(set), defaultdict(list)
    for doc, k, x in lines:
        words = x.split(" ") if x else []
        if words:
            by_line[x].add(doc)
        if len(words) >= 4:
            for wild in range(4):
                by_leaf[wild, len(words), tuple(w for i, w in enumerate(words[:4]) if i != wild)].append((doc, k, words))
    gone = {(doc, k) for doc, k, x in lines if x and len(by_line[x]) >= (2 if len(x.split(" ")) >= 50 else 3)}
    for held in by_leaf.values():
        if len({doc for doc, _, _ in held}) < 3:
            continue
        fixed = [p for p, column in enumerate(zip(*(w for _, _, w in held))) if 2 * max(Counter(column).values()) >= len(held)]
        n = len(held[0][2])
        if not (3 <= len(fixed) < n and 3 * len(fixed) >= 2 * n):
            continue
        templates = defaultdict(set)
        for doc, _, words in held:
            templates[tuple(words[p] for p in fixed)].add(doc)
        gone |= {(doc, k) for doc, k, words in held if len(templates[tuple(words[p] for p in fixed)]) >= 3}
    out = []
    for r in rows:
        own = r[1].split("\n") if r[1] is not None else []
        kept = [x for k, x in enumerate(own) if (r[:2], k) not in gone]
        out.append((r[0], None if r[1] is None else "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=repr)


def line_rows():
    noise = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    log = "2024-05-0{0} INFO request {0}77 served from cache node-{0} in {0} ms for user someone"
    vary = "connection to host {} closed after waiting for a reply from the remote side today"
    rows = [row(i, f"{noise[i % 10]} own line of document number {noise[i % 7]} {i * 'x'}y\n" + log.format(i) + "\n" + vary.format(noise[i])) for i in range(8)]
    rows += [row(20, "one two three"), row(21, "one two three"), row(22, "one two three"), row(23, "same line in two\nof four documents"),
             row(24, "same line in two"), row(25, "\n\n"), row(26, "same\tline  in two "), row(27, "same line in twoo")]
    return rows + odd_rows()


def checked_lines(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = line_dedup.without_lines(docs)
    want = brute_lines(rows)
    assert got(out) == want
    names, sql = by_sql("op3_line_dedup", documents=docs.select("doc_id", "text"))
    hashed = out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256")).select(*names)
    assert got(hashed) == sql
    return {r[0]: r for r in want}


def test_lines(spark):
    by_id = checked_lines(spark, line_rows())
    assert by_id[3][3] == 2 and by_id[24][3] == 1 and by_id[20][3] == 1 and by_id[27][3] == 0
    assert line_dedup.without_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_learned_fields(spark):
    names, towns = "alice bob carol dave erin".split(), "Berlin Paris Rome Oslo Bern".split()
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [row(i, "\n".join([f"Posted by {names[i]} in Travel", "All rights reserved.", f"{names[i]} has joined the group today", "Thanks",
                              f"the user {names[i]} has logged in at noon from {towns[i]} by the old client", f"{names[i]} {towns[i]} alone {i * 'x'} own{names[i]}",
                              f"own line {names[i]} of {towns[i]} number {'y' * i}"])) for i in range(5)]
    rows += [row(10, "lead\n" + long), row(11, long + "\ntail"), row(12, "short of fifty words shared by two"), row(13, "short of fifty words shared by two")]
    by_id = checked_lines(spark, rows)
    for i in range(5):
        left = by_id[i][1].split("\n")
        assert len(left) == 2 and left[0].endswith(f"own{names[i]}") and left[1].startswith("own line"), left
    assert by_id[10][1] == "lead" and by_id[11][1] == "tail" and by_id[12][3] == 0


def test_lines_of_random_templates(spark):
    rnd = random.Random(21)
    words = [f"t{chr(97 + i)}" for i in range(20)]
    shapes = [[rnd.choice(words) if rnd.random() < 0.75 else None for _ in range(rnd.randrange(3, 12))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = [" ".join(w or rnd.choice(words) for w in rnd.choice(shapes)) for _ in range(rnd.randrange(0, 6))]
        lines += [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 9))) for _ in range(3)]
        rows.append(row(i, "\n".join(lines)))
    checked_lines(spark, rows + rows[:5] + odd_rows())


# ---- licences ----

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
"""
BSD2 = " ".join(licenses.SENTENCES[i] + (":" if i == 29 else ".") for i in (29, 30, 31))


def licence_rows():
    texts = [MIT, BSD2, BSD2 + " " + licenses.SENTENCES[32] + ".", "no full stop here\nReleased under the MIT License.\nmore", "Licensed under CC BY-NC 4.0.\nAll rights reserved.",
             "a licence that nobody knows", "Licensed under the Apache License, Version 2.0 and more words.", "x. licensed UNDER the apache license version 2.0!",
             ". ".join(licenses.SENTENCES[i] for i in (31, 30, 29)), "This work is licensed under the GNU General Public License, version 3.", "license" * 3000]
    return [row(i, t) for i, t in enumerate(texts)] + [row(100 + (r[0] or 0), r[1]) for r in odd_rows()]


def test_licences(spark):
    docs = spark.createDataFrame(licence_rows(), SCHEMA)
    out = licenses.scanned(docs)
    said = {r["doc_id"]: r["licences"] for r in out.collect()}
    assert said[0] == ["MIT"] and said[1] == ["BSD-2-Clause"] and said[2] == ["BSD-3-Clause"] and said[3] == ["MIT"]
    assert said[4] == ["CC-BY-NC-4.0", "All-Rights-Reserved"] and said[5] == [] and said[6] == [] and said[7] == ["Apache-2.0"]
    assert said[8] == [] and said[9] == ["GPL-3.0"] and said[10] == []
    assert all(v == [] for k, v in said.items() if k >= 97)
    names, want = by_sql("op6_license_scan", documents=docs.select("doc_id", "text"))
    assert [tuple(r) for r in got(out.select(*names))] == want
    assert licenses.scanned(spark.createDataFrame([], SCHEMA)).count() == 0


GPL = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
NOTICES = [
    (GPL.format(":", ",", 3), "GPL-3.0-or-later"), (GPL.format(";", ";", 3), "GPL-3.0-or-later"), (GPL.format(";", ";", 2), "GPL-2.0-or-later"),
    (GPL.format(":", ",", 2), "GPL-2.0-or-later"), (MPL.format("http"), "MPL-2.0"), (MPL.format("https"), "MPL-2.0"), (APACHE, "Apache-2.0"),
]


def test_notices_as_they_are_printed(spark):
    rows = []
    for text, _ in NOTICES:
        blocks = text.split("\n\n")
        for width in (50, 72, 10_000):
            wrapped = "\n\n".join(textwrap.fill(b, width) for b in blocks)
            rows += [row(len(rows), wrapped), row(len(rows) + 1, " * " + wrapped.replace("\n", "\n * ").replace(" * \n", "\n"))]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = licenses.scanned(docs)
    assert [r["licences"] for r in out.orderBy("doc_id").collect()] == [[licence] for _, licence in NOTICES for _ in range(6)]
    names, want = by_sql("op6_license_scan", documents=docs.select("doc_id", "text"))
    assert got(out.select(*names)) == want


def test_every_licence_of_a_text_and_none_of_strewn_sentences(spark):
    bsd = [licenses.SENTENCES[i] for i in (29, 30, 31)]
    far = "\n".join(f"line {i} of other words" for i in range(2000))
    near = "\n".join(f"line {i} of other words" for i in range(5))
    texts = [GPL.format(":", ",", 3) + "\n\nOther files:\n\n" + GPL.format(";", ";", 2),
             "This work is licensed under the GNU General Public License, version 3.\nreleased under the mit license\nThis work is licensed under the GNU General Public License, version 3.",
             f"{bsd[0]}.\n{bsd[1]}.\n{far}\n{bsd[2]}.", f"{bsd[0]}.\n{bsd[1]}.\n{near}\n{bsd[2]}.", far + "\nAll rights reserved.\n" + far,
             BSD2 + " " + licenses.SENTENCES[32] + ".\n\n" + BSD2 + " " + licenses.SENTENCES[32] + ".", BSD2 + " " + licenses.SENTENCES[32] + ".\n\n" + far + "\n\n" + BSD2,
             "All rights reserved.\n" * 20_000]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    out = licenses.scanned(docs)
    said = {r["doc_id"]: r["licences"] for r in out.collect()}
    assert said[0] == ["GPL-3.0-or-later", "GPL-2.0-or-later"] and said[1] == ["MIT", "GPL-3.0"]
    assert said[2] == [] and said[3] == ["BSD-2-Clause"] and said[4] == ["All-Rights-Reserved"] == said[7]
    assert said[5] == ["BSD-3-Clause"] and said[6] == ["BSD-3-Clause", "BSD-2-Clause"]
    names, want = by_sql("op6_license_scan", documents=docs.select("doc_id", "text"))
    assert got(out.select(*names)) == want


@pytest.mark.parametrize("sentence", licenses.SENTENCES.values())
def test_every_sentence_has_an_anchor(sentence):
    assert any(a in sentence for a in licenses.ANCHORS)


def test_plans_are_native(spark):
    docs = spark.createDataFrame(line_rows()[:3], SCHEMA)
    for df in (licenses.scanned(docs), line_dedup.line_keys(docs), line_dedup.without_lines(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


