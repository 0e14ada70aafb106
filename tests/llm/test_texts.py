"""License templates, Merkle fingerprints, rollups and HTML wrappers."""

import hashlib

import pytest

from gridsight.llm import licenses, merkle, rollups, wrappers
from gridsight.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, folder, name):
    verdict, note = compare(QUERIES[name](spark, folder), connect(folder), SQL[name])
    assert verdict in ("ok", "close"), note


def test_templates(spark):
    texts = [
        ("Released under the MIT License.", {"mit-notice"}, [3]), ("released under the terms of the mit license", {"mit-notice"}, [6]),
        ("released under a mit license", set(), [3]), ("This is LICENSED under the GNU General Public License, version 3.", {"gpl-3.0"}, [6]),
        ("licensed under the general public license version 2 or any later version", {"gpl-2.0"}, [3]), ("Copyright (c) 2020 A. Person. All rights reserved.", {"rights-reserved"}, []),
        ("copyright all rights reserved", set(), []), ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}, []), ("licensed under the apache license version 2", set(), [3]),
        ("licensed under a creative commons attribution share alike 4 license", {"cc-named"}, []), ("SPDX-License-Identifier: MIT", {"spdx"}, []),
        ("x " * 30_000 + "mit license mit license", set(), [30_000, 30_002]), (None, set(), []), ("", set(), []), ("mitlicense", set(), []), ("MIT\nLicense", set(), [0])]
    rows = licenses.scan(spark.createDataFrame([(i, t, 1) for i, (t, _, _) in enumerate(texts)], "doc_id bigint, text string, n_words int")).collect()
    for row in rows:
        _, labels, places = texts[row["doc_id"]]
        assert ({m["label"] for m in row["matches"]}, [b["first"] for b in row["bases"]]) == (labels, places), row["doc_id"]
    spdx = next(r for r in rows if r["doc_id"] == 10)["matches"]
    assert [(m["first"], m["last"]) for m in spdx] == [(0, 4)]
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_merkle_query(spark, folder):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = sorted(texts)
    after = dict(zip(ids, [*ids[1:], ids[0]]))
    rows = QUERIES["op5_merkle_fingerprints"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == ids
    for row in rows:
        text, following = texts[row["doc_id"]], texts[after[row["doc_id"]]]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == merkle.tree(text)[0].hex() and row["edited_fingerprint"] == merkle.tree(edited)[0].hex()
        assert (row["near_edited"] == 1) == (text == edited) and (row["near_next"] == 1) == (text == following)
        assert 0 <= row["near_next"] <= 1
    assert len({r["fingerprint"] for r in rows}) == len(set(texts.values()))


def test_merkle_edits():
    text = "\n".join(f"Paragraph {i} has this sentence. And {i * 7} is another one!" for i in range(60))
    tree = merkle.tree(text)
    assert tree[1] == len(text) and merkle.likeness(tree, tree) == 1 and merkle.edits(tree, tree) == []
    changed = text.replace("Paragraph 30 has", "Paragraph 30 had")
    spans = merkle.edits(tree, merkle.tree(changed))
    assert [text[a:b] for a, b in spans] == ["Paragraph 30 has this sentence. "]
    assert 0.98 < merkle.likeness(tree, merkle.tree(changed)) < 1
    inserted = "New first line.\n" + text
    assert merkle.edits(tree, merkle.tree(inserted)) == [] and merkle.likeness(tree, merkle.tree(inserted)) > 0.98
    assert merkle.likeness(tree, merkle.tree("")) == 0 and merkle.tree("")[1] == 0
    assert merkle.likeness(merkle.tree("a. b. "), merkle.tree("b. a. ")) < 1


def test_following_rows(spark):
    rows = [(5, "e"), (1, None), (None, "n"), (3, "b"), (3, "a"), (1 << 60, "z"), (-9, "m")]
    got = sorted([tuple(r) for r in merkle.following(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, part int")).collect()], key=str)
    assert got == sorted([(-9, "m", ""), (1, "", "a"), (3, "a", "b"), (3, "b", "e"), (5, "e", "z"), (1 << 60, "z", "m"), (None, "n", "")], key=str)
    one = merkle.following(spark.createDataFrame([(4, "only")], "doc_id bigint, text string")).collect()
    assert [tuple(r) for r in one] == [(4, "only", "only")]
    assert merkle.following(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_ledger(spark):
    ledger = rollups.TokenLedger(spark)
    change = lambda rows: spark.createDataFrame(rows, "key bigint, op string, source string, lang string, tokenizer string, n_tokens bigint")
    assert ledger.totals().count() == 0
    first = change([(1, "insert", "a", "en", "t1", 10), (2, None, "a", "en", "t1", 5), (3, "insert", None, None, "t1", None), (None, "insert", "a", "en", "t1", 1),
                    (None, "insert", "a", "en", "t1", 1), (1, "insert", "a", "en", "t1", 7)])
    assert ledger.commit("b1", first) and not ledger.commit("b1", first)
    totals = lambda: sorted([tuple(r) for r in ledger.totals().collect()], key=str)
    assert totals() == sorted([("a", "en", "t1", 4, 17), (None, None, "t1", 1, 0)], key=str)
    ledger.commit("b2", change([(1, "insert", "b", "en", "t1", 20), (2, "delete", None, None, "t1", None), (9, "delete", None, None, "t1", 3), (3, "insert", "a", "en", "t2", 4)]))
    assert totals() == sorted([("a", "en", "t1", 2, 2), ("b", "en", "t1", 1, 20), (None, None, "t1", 1, 0), ("a", "en", "t2", 1, 4)], key=str)
    ledger.commit("b3", change([(1, "delete", None, None, "t1", None), (1, "insert", "b", "en", "t1", 2)]))
    ledger.commit("b4", change([]))
    assert totals() == sorted([("a", "en", "t1", 2, 2), (None, None, "t1", 1, 0), ("a", "en", "t2", 1, 4)], key=str)
    again = rollups.TokenLedger(spark, ledger.folder)
    assert not again.commit("b3", first) and sorted([tuple(r) for r in again.totals().collect()], key=str) == totals()


SITES = {
    # Article named by its element, with parts that are not of it, in three shapes.
    "a.example": [
        f"<html><head><title>T{i}</title><style>p{{}}</style></head><body><header><a href=/>Home</a></header><nav><ul>{'<li><a>x</a>' * (i % 3 + 2)}</ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><article><h1>Title &amp; {i}</h1>{''.join(f'<p>Line {i} {j}<b> bold</b>' for j in range(i % 4 + 1))}"
        f"{'<ul><li>One<li>Two</ul>' if i % 2 else ''}<aside>Side {i}</aside><div class=share>Share</div></article><section class=comments><p>Reader says {i}</section>"
        f"<form><label>Mail</label><input></form><footer>(c) {i}</footer><script>var a = '<p>no</p>';</script></body></html>" for i in range(30)],
    # No element names the article: the bulk of the text does, and fixed wording is left out.
    "b.example": [
        f"<div id=wrap><div class=menu><a>m{i}</a></div><div class=col><h2>Head {i}</h2><em>Printed on fine paper</em><div class=text>{'words ' * 40}{i}<br>more</div></div><div class=ad>Buy {i}</div></div>"
        for i in range(25)],
}


def test_wrappers(spark):
    pages = [(n * 100 + i, f"https://{host}/p/{i}", page) for n, (host, pages) in enumerate(SITES.items()) for i, page in enumerate(pages)]
    pages += [(900, None, None), (901, "nonsense", ""), (902, "https://c.example/", "just text &lt;b&gt;"), (None, "https://c.example/x", "<p>null key"),
              (903, "https://d.example/", "<p>a" * 20_000), (904, "https://d.example/", "<div" * 50), (905, "https://e.example", "<main><table><tr><td>1<td>2<tr><td>3</table></main>")]
    found = wrappers.extract(spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, host int"))
    assert found.count() == len(pages)
    texts = {r["page_id"]: r["text"] for r in found.collect()}
    for i in range(30):
        lines = [f"Title & {i}", *[f"Line {i} {j} bold" for j in range(i % 4 + 1)], *(["One", "Two"] if i % 2 else [])]
        assert texts[i] == "\n".join(lines), i
    for i in range(25):
        assert texts[100 + i].split("\n")[-1] == " ".join(["words"] * 40) + f" {i} more", texts[100 + i]
        assert "Buy" not in texts[100 + i] and "Printed" not in texts[100 + i]
    assert (texts[900], texts[901], texts[902], texts[None]) == ("", "", "just text <b>", "null key")
    assert texts[903] == "\n".join(["a"] * 20_000) and texts[905] == "1\n2\n3"
    assert wrappers.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("path, out", [
    ("page html body.has-sidebar article.with-sidebar header.entry-header h1", False), ("page html body header.site-header h1", True),
    ("page html body div.long-form p", False), ("page html body div.side-bar p", False), ("page html body div.post-comments p", True),
    ("page html body article div.ad-slot p", True), ("page html body article.story p", False), ("page html body form p", True), ("page html head title", True)])
def test_parts_outside_of_the_article(path, out):
    assert wrappers.outside(tuple(path.split())) is out


def test_page_query(spark, folder):
    import html
    import re
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for row in QUERIES["op1_html_wrappers"](spark, folder).collect():
        article = re.search(r"<article>(.*?)</article>", pages[row["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", part)).split()) for part in re.split(r"</?(?:h1|p)>", article))
        assert row["text"] == "\n".join(b for b in blocks if b) and row["n_chars"] == len(row["text"])
