"""The style tree of sites: its entropies by brute force, and what it removes without any role in the markup."""

import math
import random
from collections import Counter, defaultdict

from orrery.llm import html_extraction as h
from orrery.llm.store import Scratch

WORDS = [f"word{k}" for k in range(300)]


def site(draw, host, n, neutral=True):
    """Pages whose menu, advert and footer change from page to page, and their articles."""
    nav, foot, main = ("div", "div", "div") if neutral else ("nav", "footer", "article")
    prose = lambda a, b: " ".join(draw.choice(WORDS) for _ in range(draw.randint(a, b)))
    for k in range(n):
        menu = "".join(f"<li><a href=/{k}>{draw.choice(WORDS)}</a></li>" for _ in range(draw.randint(4, 7)))
        body = [prose(3, 8)] + [prose(5, 60) for _ in range(draw.randint(1, 12))]
        article = f"<h1>{body[0]}</h1>" + "".join(f"<p>{'<b>' * draw.randint(0, 1)}{p}</p>" for p in body[1:])
        yield f"http://{host}/{k}", f"<html><body><{nav}><ul>{menu}</ul></{nav}><div>{prose(4, 9)}</div><{main}>{article}</{main}><{foot}>(c) {host} {prose(4, 8)}</{foot}></body></html>", "\n".join(body)


def frame(spark, pages):
    return spark.createDataFrame([(k, url, html, "x") for k, (url, html, *_) in enumerate(pages)], "page_id long, url string, html string, text string")


def test_the_tree_alone_finds_articles_in_plain_divs(spark):
    draw = random.Random(1)
    pages = [*site(draw, "a.org", 40), *site(draw, "b.org", 7), *site(draw, "c.org", 30, neutral=False)]
    for p in (h.Params(), h.Params(broadcast_rows=0)):
        for roles in (True, False):
            got = {r.page_id: r.text for r in h.extract(frame(spark, pages), p, roles=roles).collect()}
            assert got == {k: text for k, (_, _, text) in enumerate(pages)}


def test_hosts_of_few_pages_are_left_to_roles(spark):
    draw = random.Random(2)
    pages = [*site(draw, "a.org", 4), *site(draw, "b.org", 4, neutral=False)]
    got = {r.page_id: r.text for r in h.extract(frame(spark, pages)).collect()}
    for k, (_, _, text) in enumerate(pages):
        assert got[k] == text if k >= 4 else text in got[k] and len(got[k]) > len(text)


def test_what_the_tree_leaves(spark):
    """A linked list that is the page's own, a table with the same form on all pages, a title in a box of its own, equal boxes."""
    draw = random.Random(3)
    word = lambda: draw.choice(WORDS) + str(draw.random())
    pages = []
    for k in range(30):
        boxes = "".join(f"<div>{word()} {word()}</div>" for _ in range(30))
        table = "<table>" + "".join(f"<tr><td>{word()}<td>{word()}" for _ in range(12)) + "</table>"
        pages.append(("http://boxes.org/", f"<body>{boxes}</body>"))
        pages.append(("http://table.org/", f"<body><div><h1>{word()}</h1></div><div>{table}</div></body>"))
        pages.append(("http://links.org/", f"<body><p>{word()}</p><ul>{''.join(f'<li><a href=x>{word()}</a>' for _ in range(9))}</ul></body>"))
    got = {r.page_id: r.text for r in h.extract(frame(spark, pages)).collect()}
    for k, (_, html) in enumerate(pages):
        if k % 3 < 2:
            assert got[k] == h.parse(html).text()
        else:
            assert got[k] and got[k] == h.parse(html).blocks[0]  # a list of links, the same on every page, beside the page's own words


def test_entropies_equal_brute_force(spark):
    draw = random.Random(4)
    pages = [*site(draw, "a.org", 25), *site(draw, "b.org", 12, neutral=False)]
    pages += [(f"{url}?copy", html, text) for url, html, text in pages[:10]]  # copies count once
    p = h.Params()
    trees = {}
    for url, html, _ in pages:
        page = h.parse(html)
        trees[url.split("/")[2], page.text()] = page
    at = defaultdict(list)
    for (host, _), page in trees.items():
        for o in page.nodes:
            text = "\n".join(page.blocks[o.first : o.last])
            at[host, o.place].append((text, o.shape, tuple(o.children), sum(page.plain[o.first : o.last]), o))

    def share(values):
        m = len(values)
        return -sum(n / m * math.log(n / m) for n in Counter(values).values()) / math.log(m)

    want = {key: (len(v), sum(x[3] for x in v), share([x[0] for x in v])) for key, v in at.items() if len(v) >= p.least_pages}
    found = h.parsed(frame(spark, pages).selectExpr("page_id", "url", "split(url, '/')[2] as host", "html"))
    scratch = Scratch(spark, "tree-test")
    places, texts = h.tree(scratch.save(found), scratch, p)
    rows = {(r.host, r.place): r for r in places.collect()}
    assert set(rows) == set(want)
    for key, (m, plain, content) in want.items():
        assert (rows[key].m, rows[key].plain) == (m, plain) and math.isclose(rows[key].content, content, abs_tol=1e-9)
        if rows[key].presentation is not None:
            assert math.isclose(rows[key].presentation, share([x[1] for x in at[key]]), abs_tol=1e-9)
            assert math.isclose(rows[key].variety, share([x[2] for x in at[key]]), abs_tol=1e-9)

    weights = {}
    for (host, place), v in at.items():
        o = v[0][4]
        above = (host, o.parent.place) if o.parent else None
        if (host, place) not in want or above not in want or o.tag not in h.CONTAINERS or any(x[4].article or x[4].heads for x in v):
            continue
        top = at[above][0][4]
        if top.tag not in ("body", "html", "") and not (top.tag in h.LEVELS and share([x[2] for x in at[above]]) < p.most_variety):
            continue
        beside = [want[key][1] for key, w in at.items() if key in want and key[0] == host and w[0][4].parent and w[0][4].parent.place == o.parent.place and w[0][4].tag in h.CONTAINERS | h.LEVELS]
        weight = min(1, want[host, place][1] / max(1, max(beside), want[above][1] - sum(beside)))
        form = share([x[1] for x in v])
        weights[host, place] = want[host, place][2] * (1 - (1 - form) * (1 - weight))
    got = {(r.host, r.place): r.importance for r in h.branches(places, p).collect()}
    assert set(got) == set(weights) and len(got) > 4
    assert all(math.isclose(got[k], weights[k], abs_tol=1e-9) for k in got)
    assert {(r.host, r.place): r.n for r in texts.collect() if (r.host, r.place) in want} == {
        (*key,): n for key, v in at.items() if key in want for t, n in Counter(x[0] for x in v).items() if n > 1
    }


def test_a_very_long_page(spark):
    words = " ".join(f"w{k}" for k in range(200_000))
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = {r.page_id: r for r in h.extract(frame(spark, [("u", f"<article><p>{words}</p></article>"), ("u", deep), ("u", None)])).collect()}
    assert rows[0].text == words and rows[0].n_chars == len(words) and rows[1].text == "deep" and rows[2].text == ""
