"""HTML wrappers: what a host's wrapper covers, and which slots are the article."""

import random

from gridsight.llm import markup, wrappers


def wrapper_of(signatures):
    whole = None
    for text in sorted(signatures, key=lambda s: (-len(s), s)):
        whole = markup.read(text) if whole is None else markup.merge(whole, markup.read(text))
    return markup.read(markup.write(whole))


def uncovered(pages):
    signatures = {markup.write(markup.fold(markup.parse(page)[0])) for page in pages}
    wrapper = wrapper_of(signatures)
    return [s for s in signatures if set(markup.match(markup.read(s), wrapper)) != {n for n, _, _ in markup.slots(markup.read(s))}]


def test_wrapper_covers_its_pages():
    assert uncovered(["<ul><li>a</ul><p>b</p><ul><li>c</ul>", "<p>a</p><ul><li>b</ul><p>c</p>"]) == []
    dice = random.Random(4)

    def page(depth=0):
        parts = [(dice.choice(["p", "ul", "div", "h2"]), dice.choice(["", "<a>l</a>", "<a>l</a> x <a>m</a>"])) for _ in range(dice.randint(1, 6))]
        return "".join(f"<{tag}>{'text' if tag in ('p', 'h2') or depth > 1 else page(depth + 1)}{more}</{tag}>" for tag, more in parts)

    for _ in range(40):
        assert uncovered([page() for _ in range(dice.randint(2, 12))]) == []


def texts_of(spark, pages):
    """Texts of (url, html) pages, in their order."""
    found = wrappers.extract(spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id bigint, url string, html string"))
    return [r["text"] for r in found.orderBy("page_id").collect()]


def test_each_template_of_a_host_has_its_article(spark):
    prose = "Long words of a text that goes on and on. " * 5
    post = [f"<body><nav><a>n{i}</a></nav><article><h1>Post {i}</h1><p>{prose}{i}</p></article></body>" for i in range(30)]
    static = [f"<body><nav><a>n{i}</a></nav><div class=intro>About {i}</div><div class=text><p>{prose}s{i}</p></div></body>" for i in range(3)]
    # No element names the article, and the second template holds a small share of the host's text.
    plain = [f"<body><div class=one><p>{prose}{i}</p></div></body>" for i in range(30)] + [f"<body><div class=two><p>{prose}t{i}</p></div></body>" for i in range(3)]
    for url in ("https://a.example/", None):
        found = texts_of(spark, [(url, p) for p in post + static])
        assert found[:30] == [f"Post {i}\n{prose}{i}" for i in range(30)]
        assert all(f"{prose}s{i}" in found[30 + i] and f"n{i}" not in found[30 + i] for i in range(3))
        assert texts_of(spark, [(url, p) for p in plain]) == [f"{prose}{i}" for i in range(30)] + [f"{prose}t{i}" for i in range(3)]


def test_copies_and_named_articles_have_no_fixed_wording(spark):
    url, prose = "https://a.example/", "Long words of a text that goes on and on. " * 5
    # Copies under different menus, of one element each, next to other pages.
    copies = [f"<body><nav><a>n{i}</a></nav><div class=text><h2>Only here</h2><blockquote>Said once</blockquote><p>{prose}</p></div></body>" for i in range(25)]
    others = [f"<body><nav><a>m{i}</a></nav><div class=text><h2>Head {i}</h2><p>{prose}{i}</p></div></body>" for i in range(5)]
    found = texts_of(spark, [(url, p) for p in copies + others])
    assert found == [f"Only here\nSaid once\n{prose.strip()}"] * 25 + [f"Head {i}\n{prose}{i}" for i in range(5)]
    # A constant heading within a named article stays, and wording around different texts goes elsewhere.
    named = [f"<body><article><h2>Summary</h2><p>{prose}{i}</p></article></body>" for i in range(25)]
    assert texts_of(spark, [(url, p) for p in named]) == [f"Summary\n{prose}{i}" for i in range(25)]
    bulk = [f"<body><div class=text><h2>Head {i}</h2><h5>Printed on fine paper</h5><p>{prose}{i}</p></div></body>" for i in range(25)]
    assert texts_of(spark, [(url, p) for p in bulk]) == [f"Head {i}\n{prose}{i}" for i in range(25)]
