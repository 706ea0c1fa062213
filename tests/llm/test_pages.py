"""Page shapes that any site has: no article text may go, and nothing else may come."""

import pytest

from quantarium.llm import pages

SCHEMA = "page_id long, url string, html string"


def prose(k, name, n=25):
    return f"{name} {k} " + " ".join(f"{name[:2]}{k}w{j}" for j in range(n)) + "."


def got(spark, make, n=8, host="h.example"):
    rows = [(k, f"https://{host}/{k}", make(k)) for k in range(n)]
    found = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [found[k] for k in range(n)]


def shell(k, inside, after=""):
    """Menu, site header, advert, footer and a cookie notice around what is given."""
    return (
        f'<html><head><title>T{k}</title><style>p{{}}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="site-header">The Daily</div><div class="ad">Buy {k} now</div>'
        f'{inside}{after}<form><input name="q"><label>Search</label></form><div class="cookie-notice">We use cookies {k}</div><footer>Imprint {k}</footer><script>var x="<p>";</script></body></html>'
    )


@pytest.mark.parametrize("n", [2, 4, 8])
def test_two_blocks(spark, n):
    make = lambda k: shell(k, f'<article><h1>Title {k}</h1><div class="body"><p>{prose(k, "first", 60)}</p><p>{prose(k, "second")}</p></div><div class="more"><p>{prose(k, "rest", 8)}</p></div></article>')
    assert got(spark, make, n) == [f"Title {k}\n{prose(k, 'first', 60)}\n{prose(k, 'second')}\n{prose(k, 'rest', 8)}" for k in range(n)]


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_lead_outside_the_text(spark, tag):
    make = lambda k: shell(k, f'<{tag} class="story"><h1>Title {k}</h1><p class="lead">{prose(k, "lead", 6)}</p><div class="text"><p>{prose(k, "one", 80)}</p><p>{prose(k, "two")}</p></div></{tag}>')
    assert got(spark, make) == [f"Title {k}\n{prose(k, 'lead', 6)}\n{prose(k, 'one', 80)}\n{prose(k, 'two')}" for k in range(8)]


@pytest.mark.parametrize("n", [2, 4, 5, 8, 30])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_shared_byline(spark, n, tag):
    """The same on hosts of any size."""
    make = lambda k: shell(k, f'<{tag} class="story"><header><h1>Title {k}</h1></header><p class="by">By the staff writer.</p><p>{prose(k, "one")}</p><p>All rights with the author.</p></{tag}>')
    assert got(spark, make, n) == [f"Title {k}\nBy the staff writer.\n{prose(k, 'one')}\nAll rights with the author." for k in range(n)]


def test_shared_byline_beside_the_text(spark):
    """An article is taken whole, also where one element in it holds all that is free."""
    make = lambda k: shell(k, f'<article><p class="by">By the staff writer.</p><div class="text"><h1>Title {k}</h1><p>{prose(k, "one")}</p></div></article>')
    assert got(spark, make) == [f"By the staff writer.\nTitle {k}\n{prose(k, 'one')}" for k in range(8)]


def test_copies_on_a_host(spark):
    """Text that all pages share, because they are copies, is still an article."""
    make = lambda k: shell(0, f"<article><h1>Title</h1><p>{prose(0, 'one')}</p></article>")
    assert got(spark, make, 2) == [f"Title\n{prose(0, 'one')}"] * 2


@pytest.mark.parametrize("inner", ['div class="share price"', 'p class="ad hoc"', 'section class="comment-letter"', 'div class="has-sidebar"', 'div id="menu-of-the-day"', 'div class="newsletter-review"', 'div class="share-enabled"'])
def test_marked_words_in_content(spark, inner):
    name = inner.split()[0]
    make = lambda k: shell(k, f'<article><h1>Title {k}</h1><{inner}>{prose(k, "one")}</{name}></article>')
    assert got(spark, make) == [f"Title {k}\n{prose(k, 'one')}" for k in range(8)]


@pytest.mark.parametrize("inner", ['div class="comments"', 'ol class="comment-list"', 'div class="share-buttons"', 'aside', 'div class="ad-slot top"', 'div class="related links"', 'div id="newsletterSignup"', "form", 'div role="navigation"', 'div class="share us"'])
def test_marked_elements_go(spark, inner):
    name = inner.split()[0]
    said = (lambda k: "Share us with friends") if "us" in inner else (lambda k: f"other {k}")
    make = lambda k: shell(k, f'<article><h1>Title {k}</h1><p>{prose(k, "one")}</p><{inner}><p>{said(k)}</p></{name}><p>{prose(k, "end")}</p></article>')
    assert got(spark, make) == [f"Title {k}\n{prose(k, 'one')}\n{prose(k, 'end')}" for k in range(8)]


@pytest.mark.parametrize("reply", ['<div class="reply">{0}</div>', '<div class="r"><b>Ann {1}</b><p>{0}</p></div>', '<div class="r">{0}</div>'])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_replies_longer_than_the_article(spark, reply, tag):
    """Unmarked replies beside the text, more of them than of the article, in a number that varies."""
    replies = lambda k: "".join(reply.format(prose(100 * k + j, "reply", 40), j) for j in range(2 + k % 3))
    make = lambda k: shell(k, f'<{tag} class="post"><h1>Title {k}</h1>' + "".join(f"<p>{prose(k, f'par{j}')}</p>" for j in range(1 + k % 4)) + f"</{tag}>", f'<div class="rs">{replies(k)}</div>')
    assert got(spark, make) == ["\n".join([f"Title {k}", *(prose(k, f"par{j}") for j in range(1 + k % 4))]) for k in range(8)]


def test_text_in_like_elements_is_no_reply(spark):
    """Paragraphs written as elements of a class, in varying number, beside a lead; sections with headings; two columns."""
    paras = lambda k: [prose(k, f"para{j}") for j in range(2 + k % 3)]
    lead = lambda k: shell(k, f'<div class="x"><h1>Title {k}</h1><p class="lead">{prose(k, "lead")}</p><div class="text">' + "".join(f'<div class="para">{p}</div>' for p in paras(k)) + "</div></div>")
    assert got(spark, lead) == ["\n".join([f"Title {k}", prose(k, "lead"), *paras(k)]) for k in range(8)]
    heads = lambda k: shell(k, f'<div class="x"><div><h1>Title {k}</h1><p>{prose(k, "one")}</p></div><div class="all">' + "".join(f'<div class="part"><h2>Part {k}.{j}</h2><p>{p}</p></div>' for j, p in enumerate(paras(k))) + "</div></div>")
    assert got(spark, heads) == ["\n".join([f"Title {k}", prose(k, "one"), *(f"Part {k}.{j}\n{p}" for j, p in enumerate(paras(k)))]) for k in range(8)]
    cols = lambda k: shell(k, "".join(f'<div class="col">{"".join(f"<p>{p}{c}</p>" for p in paras(k))}</div>' for c in "ab"))
    assert got(spark, cols) == ["\n".join(p + c for c in "ab" for p in paras(k)) for k in range(8)]


def test_wrapped_and_nested(spark):
    """A form around the whole page, an article in main, teasers that are articles too, an article inside a marked wrapper."""
    form = lambda k: f'<body><form id="aspnet"><div class="menu"><a href="/">Home</a></div><article><h1>Title {k}</h1><p>{prose(k, "one")}</p></article></form></body>'
    assert got(spark, form) == [f"Title {k}\n{prose(k, 'one')}" for k in range(8)]
    main = lambda k: shell(k, f'<main class="page"><article><h1>Title {k}</h1><p>{prose(k, "one")}</p></article><div class="box">{prose(k, "other")}</div></main>')
    assert got(spark, main) == [f"Title {k}\n{prose(k, 'one')}" for k in range(8)]
    deep = lambda k: shell(k, "<div>" * 3000 + f"<p>{prose(k, 'one')}</p>" + "</div>" * 3000)
    assert got(spark, deep, 3) == [prose(k, "one") for k in range(3)]


def test_single_page_and_odd_rows(spark):
    rows = [(1, "https://a.example/", shell(1, f"<article><h1>Title 1</h1><p>By the staff.</p><p>{prose(1, 'one')}</p></article>")), (2, None, None), (2, None, None), (None, "https://b.example", ""), (3, "x", "plain <b>text</b> &amp; more")]
    found = sorted(((r.page_id is None, r.page_id, r.text) for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert found == [(False, 1, f"Title 1\nBy the staff.\n{prose(1, 'one')}"), (False, 2, ""), (False, 2, ""), (False, 3, "plain text & more"), (True, None, "")]
    assert pages.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
