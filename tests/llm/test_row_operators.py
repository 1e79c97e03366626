"""Operators that work row by row, against plain Python."""

import hashlib
import random
import re

import pytest
from llm.helpers import corpus, documents, words

from variantloom.llm import bpe, chat, html, licenses, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def by_value(rows):
    return sorted(map(repr, rows))


# --- byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.public_vocabulary()


def test_bpe_equals_the_public_library(spark, vocabulary):
    import tiktoken

    tokens, pattern = vocabulary
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rows = [*corpus(), (20, "x" * 3000), (21, "I'll  say 'twas 12,345\r\n\r\n   !!"), (22, "<|endoftext|>")]
    got = bpe.encode(documents(spark, rows), tokens, pattern).collect()
    want = [(i, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert by_value((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in got) == by_value(want)
    digests = bpe.digests(documents(spark, rows), tokens, pattern).collect()
    assert by_value(tuple(r) for r in digests) == by_value((i, len(e), sha(" ".join(map(str, e))), sha(d)) for i, e, d in want)


def test_bpe_of_no_rows(spark, vocabulary):
    assert bpe.encode(documents(spark, []), *vocabulary).collect() == []


def test_perfect_hash_is_minimal_and_refuses_strangers():
    keys = [f"key{i}".encode() for i in range(5000)]
    table = bpe.PerfectHash(keys)
    assert table.slots(keys).tolist() == list(range(5000))
    assert sorted(table.key_at.tolist()) == list(range(5000))
    assert all(keys[s] != b"stranger" for s in table.slots([b"stranger", b""]))


# --- quality


def plain_stats(text):
    text = text or ""
    found = WORD.findall(text)
    grams = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(re.findall("[A-Z]", text))


def test_quality_statistics(spark):
    rows = [(i, t) for i, t in corpus() if i != 12] + [(30, "a b\na b\n\n \n#*$\na b c"), (31, " ".join(words(1, 9) * 3 + words(2, 20)))]
    got = quality.score(documents(spark, rows)).collect()
    assert by_value((r["doc_id"], *[r[s] for s in quality.STATS]) for r in got) == by_value((i, *plain_stats(t)) for i, t in rows)
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.score(documents(spark, [])).collect() == []


def test_quality_learns_which_rules_to_trust(spark):
    rng = random.Random(5)
    good = [(i, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(80))) for i in range(300)]
    junk = [(300 + i, " ".join("".join(rng.choices("abc#*$%", k=5)) for _ in range(80))) for i in range(40)]
    kept = {r["doc_id"] for r in quality.filter_kept(documents(spark, good + junk)).collect()}
    assert kept == {i for i, _ in good}


def test_quality_filter_keeps_columns(spark):
    docs = documents(spark, [(1, " ".join(words(9, 60, 4000))), (2, "x"), (None, " ".join(words(8, 60, 4000)))])
    got = quality.filter_kept(docs)
    assert got.columns == docs.columns
    assert by_value(tuple(r) for r in got.collect()) == by_value(tuple(r) for r in docs.collect() if r["doc_id"] != 2)


# --- chat


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string, formatted string")


CHAT = [
    (1, 1, "assistant", "<|end|>\n tail <"),
    (1, 0, "user", "<\\|x|> <|assistant|>\n"),
    (2, 0, None, None),
    (2, None, "assistant", "é\U0001f600"),
    (3, 0, "r|<>%\n", "|"),
    (3, 1, "assistant", ""),
    (None, 0, "user", "no id"),
    (4, 0, "end", "role named as a control string"),
    (5, 7, "user", "twice"),
    (5, 7, "user", "twice"),
    *[(6, i, "assistant" if i % 2 else "user", f"turn {i} " * 200) for i in range(400)],
]


def test_chat_reads_back(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        formatted = chat.format_conversations(turns(spark, CHAT))
        got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
        parts = formatted.where("conv_id = 6").count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts > 1 and len(got) == len({r[0] for r in CHAT})
    for conv, row in got.items():
        own = sorted((r for r in CHAT if r[0] == conv), key=lambda r: ((r[1] is not None), r[1] or 0, r[2] or "", r[3] or ""))
        learned = "".join(t or "" for _, _, role, t in own if role == "assistant")
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == sha("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learned), sha(learned))
    assert chat.read_back(chat.format_conversations(turns(spark, []))).collect() == []


def test_chat_text_cannot_end_a_turn(spark):
    rows = chat.format_conversations(turns(spark, [r for r in CHAT if r[0] == 1])).collect()
    assert rows[0]["formatted"].count("<|") == 4


# --- licences


def test_license_digest_ignores_layout(spark):
    mit = licenses.MIT
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper()),
        (2, mit.replace(",", " ;")),
        (3, mit + " and more"),
        (4, "text\nLicensed under the Apache Licence, version 2.0\nLICENSED UNDER CC BY-NC 4.0\n"),
        (5, None),
        (6, "...\n"),
        (None, "Released under the MIT License."),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert [got[i]["license_id"] for i in (1, 2, 3, 5, 6, None)] == ["MIT", "MIT", None, None, None, "MIT"]
    assert got[1]["license_digest"] == got[2]["license_digest"] and got[5]["license_digest"] is None
    assert got[4]["notices"] == "Apache-2.0,CC-BY-NC-4.0" and got[None]["notices"] == "MIT"
    assert licenses.scan(documents(spark, [])).collect() == []


def test_usual_licenses_are_known(spark):
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
    mit = licenses.MIT.replace("\n", " ").replace("THE AUTHORS OR COPYRIGHT", "THE\nAUTHORS OR COPYRIGHT")
    longest = {}
    for i, t in licenses.known_texts():
        longest[i] = max(longest.get(i, ""), t, key=len)
    usual = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "Zlib"]
    rows = [(0, "/*\n * " + apache.replace("\n", "\n * ") + "\n */"), (1, gpl), (2, "MIT License\n\nCopyright (c) 2020 A\n\n" + mit)]
    rows += [(10 + n, "Copyright 2020 A\n\n" + longest[i].upper()) for n, i in enumerate(usual)]
    rows += [(30, "# SPDX-License-Identifier: MIT\ncode\n# This work is licensed under a Creative Commons Attribution 4.0 International License.")]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert [got[i]["license_id"] for i in (0, 1, 2)] == ["Apache-2.0", "GPL-3.0", "MIT"] and got[0]["notices"] == "Apache-2.0"
    assert [got[10 + n]["license_id"] for n in range(len(usual))] == usual
    assert got[30]["notices"] == "CC-BY-4.0,MIT" and got[30]["license_id"] is None


def test_known_licenses_come_from_a_table(spark):
    table = spark.createDataFrame([("House-1", "House licence, first line"), ("House-1", None)], "license_id string, known_text string")
    rows = [(1, "HOUSE LICENSE -- first line"), (2, "a\nHouse License: First Line"), (3, "Released under the MIT License."), (4, None)]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licenses.scan(documents(spark, rows), table).collect()}
    assert got == {1: ("House-1", "House-1"), 2: (None, "House-1"), 3: (None, ""), 4: (None, "")}


# --- HTML


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


ARTICLE = "<article><h1>Head</h1><p>First &amp; <b>bold</b>\n text.<p>Second <a href='x'>link</a> para &lt;x&gt;</p><div class='share'>Share me</div></article>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, host string, text string")


def test_html_main_text(spark):
    nav = "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- <p>no</p> --><div class='ad'>Buy</div>"
    rest = "<aside>side</aside><section class='comments'><p>A reader says something long, longer and longer than anything else here, many words</p></section><footer>foot</footer><script>var a='</p>';</script>"
    rows = [
        (1, "http://a.example/1", page(nav + ARTICLE + rest)),
        (2, "http://a.example/2", page(nav + ARTICLE + "<form><p>Sign up</p></form>" + rest)),
        (3, "http://b.example/2", page("<div id='main'><p>Only a div" + "<p>and one more")),
        (4, None, "plain text &eacute; with no tags"),
        (5, "http://c.example/", None),
        (6, "http://c.example/", ""),
        (None, "http://c.example/", "<p>a<br>b</p><p>c"),
        (1, "http://a.example/1", page(nav + ARTICLE + rest)),
    ]
    got = html.extract_pages(pages(spark, rows)).collect()
    text = "Head\n\nFirst & bold text.\n\nSecond link para <x>"
    want = [(1, text), (2, text), (3, "Only a div\n\nand one more"), (4, "plain text é with no tags"), (5, ""), (6, ""), (None, "a b\n\nc"), (1, text)]
    assert by_value((r["page_id"], r["text"]) for r in got) == by_value(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract_pages(pages(spark, [])).collect() == []


def test_html_follows_its_host(spark):
    usual = page("<div class='story'><p>" + "Story text of the day. " * 10 + "</p></div><div class='box'><p>Small box</p></div>")
    odd = page("<div class='story'><p>Short story.</p></div><div class='box'><p>" + "A box that is longer than the story here. " * 10 + "</p></div>")
    rows = [(i, f"http://h.example/{i}", usual) for i in range(5)] + [(9, "http://h.example/9", odd), (10, "http://other.example/9", odd)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(pages(spark, rows)).collect()}
    assert got[9] == "Short story." and got[10].startswith("A box")


LONG = "<p>" + "A sentence of the article text. " * 30 + "</p>"
LINKS = "<p>See " + "<a href='x'>another article of ours</a> " * 20 + "</p>"


@pytest.mark.parametrize(
    "body, lost, extra",
    [
        (f"<article><h1>Head</h1><p>Lead</p><div class='body'>{LONG}</div></article>", ["Head", "Lead"], []),
        (f"<div class='text'><section class='a'>{LONG}</section><section class='b'><p>Second part</p></section></div>", ["Second part"], []),
        (f"<section class='a'>{LONG}</section><section class='b'><p>Second part</p></section>", ["Second part"], []),
        (f"<article><div>{LONG}</div>{LINKS}</article>", ["another article"], []),
        (f"<div class='post'><h1>Head</h1><div>{LONG}</div>{LINKS}</div>", ["Head", "another article"], []),
        (f"<div class='content has-sidebar'><article><h1>Head</h1>{LONG}</article><div class='sidebar'><p>Side</p></div></div>", ["Head"], ["Side"]),
        (f"<div class='sidebar'><article><h1>Head</h1>{LONG}</article><p>Side</p></div>", ["Head"], ["Side"]),
        (f"<form id='aspnet'><main><h1>Head</h1>{LONG}</main><p>Field</p></form>", ["Head"], ["Field"]),
        (f"<article>{LONG}<div class='comments'><article><p>Reader says</p></article></div></article>", [], ["Reader says"]),
        (f"<nav><article><p>Teaser</p></article></nav><div>{LONG}</div><div class='ad'>Buy</div>", [], ["Teaser", "Buy"]),
    ],
)
def test_html_drops_no_part_of_the_article(body, lost, extra):
    whole = page(body)
    for winners in ([], [html.vote(whole)]):
        text, _ = html.extract(whole, winners)
        assert "A sentence of the article text." in text
        assert all(t in text for t in lost) and not any(t in text for t in extra)


def test_html_without_a_body_keeps_all_articles():
    whole = "<nav>Menu</nav><article><p>First article</p></article><article class='b'><p>Second article</p></article>"
    for winners in ([], [html.vote(whole), "/article"]):
        assert html.extract(whole, winners)[0] == "First article\n\nSecond article"


@pytest.mark.parametrize(
    "bad",
    ["<div " * 200_000, "<div class=a1>" * 100_000, '<a ">" ' * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<!" * 300_000, '<div "' * 100_000, "<article>" + "<div class=x>text" * 50_000],
)
def test_html_malformed_and_deep_pages_are_linear(bad):
    import time

    start = time.time()
    html.extract(bad, ["/div.aN"])
    assert time.time() - start < 12


def boxed(attributes, tag="div"):
    return f"<html><body><article><h1>T</h1><p>{'body text ' * 30}</p><{tag} {attributes}><p>inside</p></{tag}></article></body></html>"


def test_html_boxes_inside_the_article():
    for name in ("related-posts", "comments-area", "share-buttons", "site-footer", "cookie-notice-bar", "comment-list", "user-comments"):
        assert "inside" not in html.extract(boxed(f"class='{name}'"), [])[0], name
    for name in ("has-sidebar", "post-content", "post", "article-body", "section"):
        assert "inside" in html.extract(boxed(f"class='{name}'"), [])[0], name


def test_html_paths_go_by_class_whatever_the_order_of_attributes():
    page = "<body><div {}><p>" + "some words of text " * 20 + "</p></div></body>"
    votes = {html.vote(page.format(a)) for a in ("class='post a' id='p1'", "id=p2 class='a post'", "role=main class='post a' id=p3")}
    assert votes == {"/body/div.a.post"}
    assert html.vote(page.format("id=p12 role=main")) == "/body/div.pN"


def test_html_unclosed_tags_are_text_and_host_ties_go_by_the_path(spark):
    assert html.extract("<p>one <b two</p>", [])[0] == "one <b two"
    text = "some words of text " * 20
    rows = [(i, f"http://h/{i}", f"<body><div class='{'ab'[i % 2]}'><p>{text}</p></div></body>") for i in range(4)] + [(9, "http://g/", "<p>x</p>")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["host"]: r["winners"] for r in html.consensus(frame).collect()}
    assert found["h"] == ["/body/div.a", "/body/div.b"]
    many = [(i, "http://h/", f"<body><div class='{chr(97 + i // 26)}{chr(97 + i % 26)}'><p>{text}</p></div></body>") for i in range(100)]
    assert html.consensus(spark.createDataFrame(many, "page_id bigint, url string, html string")).collect() == []
