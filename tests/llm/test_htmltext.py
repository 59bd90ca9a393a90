import random
import time

import pytest

from thalweg.llm import htmltext as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use <b>cookies</b><div>ok</div></div>
<div class="ad">Buy <p>now</div><article><header><h1>Title &amp; more</h1></header><p><b>First  line<br>goes\n on.<p>a &lt; b &#233; 3 < 4</p><aside>side</aside>
<form><input>Name</form><div class='content'>Kept <i>in</i>line.</div><!-- no --><p>All rights reserved.</p></article>
<section id="comments"><article class="comment"><p>I disagree</p></article></section><footer>&copy; me</footer></body></html>"""


def text(page):
    got = H.blocks(page)
    return H.main_texts([([b for b, _ in got], bytes(s for _, s in got))])[0]


def test_article_without_furniture():
    assert text(PAGE) == "Title & more\nFirst line goes on.\na < b é 3 < 4\nKept inline.\nAll rights reserved."


def test_odd_pages():
    assert [text(x) for x in (None, "", " \n", "<article>", "<p", "plain words", "<script>only")] == ["", "", "", "", "<p", "plain words", ""]
    assert text("<div class=ad>x<article><p>y<footer>z") == "y"
    assert text("<article><p>" + "long " * 100000 + "</article>").count("long") == 100000


def test_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(150):
        streams = [[r.choice("abcde") * r.choice([1, 12]) for _ in range(r.randint(0, 9))] for _ in range(r.randint(1, 5))]
        for p, (s, got) in enumerate(zip(streams, H.covered(streams), strict=True)):
            want = [False] * len(s)
            for i in range(len(s)):
                for n in range(1, len(s) - i + 1):
                    run = s[i:i + n]
                    if (n >= H.RUN_BLOCKS or sum(map(len, run)) >= H.RUN_CHARS) and any(q != p and any(o[j:j + n] == run for j in range(len(o))) for q, o in enumerate(streams)):
                        want[i:i + n] = [True] * n
            assert want == got.tolist()


def test_suffix_array_is_sorted():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (0, 1, 2, 50):
        t = r.integers(0, 3, n)
        order = H.suffix_array(t).tolist()
        assert order == sorted(range(n), key=lambda i: t[i:].tolist())


def test_unmarked_pages_lose_what_recurs(spark):
    page = lambda k: f"<div>Home</div><div>Products</div><div>About this site</div><p>Unique story number {k} with words {k * 7}.</p><p>Quoted by all of the pages at the bottom here</p>"
    rows = [(k, f"http://x.org/{k}", page(k)) for k in range(6)] + [(10, None, page(10)), (11, "http://y.org/", None), (12, "http://x.org/a", PAGE), (12, "http://x.org/a", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = H.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k in range(6):
        assert by[k].text == f"Unique story number {k} with words {k * 7}." and by[k].n_chars == len(by[k].text)
    assert by[10].text.startswith("Home\n") and by[11].text == "" and by[12].text.startswith("Title & more")
    assert H.extract(df.limit(0)).count() == 0


def test_copies_keep_their_text(spark):
    page = lambda k: f"<div>Home</div><div>Products</div><div>About this site</div><p>Unique story number {k} with words {k * 7}.</p>"
    df = spark.createDataFrame([(k, f"http://x.org/{k}", page(k % 3)) for k in range(9)] + [(0, "http://x.org/0", page(0))], "page_id long, url string, html string")
    got = H.extract(df).collect()
    assert len(got) == 10
    assert all(r.text == f"Unique story number {r.page_id % 3} with words {r.page_id % 3 * 7}." for r in got)


def test_groups_of_a_host_see_all_its_pages(spark, monkeypatch):
    r = random.Random(5)
    rows = []
    for k in range(60):
        parts = [f"Own line {k} of some length {i * k}" for i in range(3)] + r.choices(["Short", "Menu", "Tail", "More", "A notice that a few pages of the section share", "Half of a pair", "the other half of it"], k=6)
        r.shuffle(parts)
        body = "".join(f"<{t}>{x}</{t}>" for x in parts for t in [r.choice(["p", "p", "nav"])])
        rows += [(k, f"http://{r.choice('xxy')}.org/{k}", body if k % 7 else f"<article>{body}</article>{body}")] * r.choice([1, 1, 3])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(tuple, H.extract(df).collect()))
    monkeypatch.setattr(H, "GROUP_BYTES", 600)
    assert sorted(map(tuple, H.extract(df).collect())) == whole
    assert len(whole) == len(rows) and any("Short" in t for _, _, t, _ in whole)


def test_markup_is_a_hint():
    assert text('<form id="aspnetForm"><nav>Home</nav><main><p>Body text</p></main></form>') == "Body text"
    assert text("<form><article><p>Body text</p><form>Name</form></article></form>") == "Body text"
    assert text("<article><header><h1>T</h1><p>Lead</p><nav>Share</nav></header><p>Body</p><address>12 High Street</address></article>") == "T\nLead\nBody\n12 High Street"
    assert text('<div class="layout with-sidebar"><article>Body</article><div class="sidebar">side</div></div>') == "Body"
    assert text('<div class="widget"><article>Body</article></div>') == "Body"  # the only article there is
    assert text('<article>Body</article><div id="comments"><article>I disagree</article></div>') == "Body"
    assert text("<main><p>One</p></main><aside><article>Teaser</article></aside>") == "One"


def brute_words(streams, i, p):
    """Tokens of page p that lie in a string of RUN_WORDS tokens that another page has."""
    s, n = streams[p], H.RUN_WORDS
    return any(q != p and any(o[j:j + n] == s[a:a + n] for j in range(len(o) - n + 1)) for a in range(max(0, i - n + 1), min(i, len(s) - n) + 1) for q, o in enumerate(streams))


def test_strings_equal_brute_force(monkeypatch):
    monkeypatch.setattr(H, "RUN_WORDS", 4)
    r = random.Random(6)
    for _ in range(60):
        streams = [[r.choice("ab\n") for _ in range(r.randint(0, 14))] for _ in range(r.randint(1, 4))]
        for p, got in enumerate(H.covered_words(streams)):
            assert got.tolist() == [brute_words(streams, i, p) for i in range(len(streams[p]))]
        sums = [H.window_hashes("h", s).tolist() for s in streams]
        assert all(len(h) == max(0, len(s) - 3) for h, s in zip(sums, streams))
        assert all((a == b) == (streams[p][i:i + 4] == streams[q][j:j + 4]) for p, x in enumerate(sums) for i, a in enumerate(x) for q, y in enumerate(sums) for j, b in enumerate(y))


def brute_extract(pages):
    """page -> text, pages of one host given as lists of (block, state)."""
    distinct = list(dict.fromkeys(tuple(p) for p in pages))
    left = [[b for b, s in p if s != H.CONTENT] for p in distinct]
    tokens = [H.words_of(x) for x in left]

    def recurs(p, i, n):
        run = left[p][i:i + n]
        return (n >= H.RUN_BLOCKS or sum(map(len, run)) >= H.RUN_CHARS) and any(q != p and any(o[j:j + n] == run for j in range(len(o))) for q, o in enumerate(left))

    out = {}
    for p, page in enumerate(distinct):
        if any(s == H.CONTENT for _, s in page):
            out[page] = "\n".join(b for b, s in page if s == H.CONTENT)
            continue
        kept, at = [], 0
        for i, (b, s) in enumerate(page):
            ws = [w for k, w in enumerate(b.split(" ")) if not brute_words(tokens, at + k, p)]
            at += len(b.split(" ")) + 1
            if s == H.OPEN and ws and not any(recurs(p, a, n) for a in range(i + 1) for n in range(i - a + 1, len(page) - a + 1)):
                kept.append(" ".join(ws))
        out[page] = "\n".join(kept)
    return [out[tuple(p)] for p in pages]


def test_extract_equals_brute_force_whole_and_in_groups(spark, monkeypatch):
    r = random.Random(9)
    shared = "a string that stands in the middle of other text on several pages and goes on for quite a while".split() * 2
    rows = []
    for k in range(40):
        parts = [("p", " ".join(r.choices("red green blue", k=2) + (shared if r.random() < 0.4 else []) + [f"own{k}", "tail"])) for _ in range(2)]
        parts += [(r.choice(["p", "nav", "li"]), x) for x in r.choices(["Home", "News", "About us all", "A notice that some pages of the host share", f"only {k}"], k=5)]
        r.shuffle(parts)
        body = "".join(f"<{t}>{x}</{t}>" for t, x in parts)
        rows += [(len(rows) + i, f"{r.choice(['', 'http://'])}{r.choice('xxy')}.org/{k}", body if k % 6 else f"<main>{body}</main>{body}") for i in range(r.choice([1, 1, 2]))]
    want = {}
    for host in "xy":
        ids = [i for i, u, _ in rows if u.removeprefix("http://")[0] == host]
        want |= dict(zip(ids, brute_extract([H.blocks(rows[i][2]) for i in ids])))
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, body int")
    assert {x.page_id: x.text for x in H.extract(df).collect()} == want
    monkeypatch.setattr(H, "GROUP_BYTES", 700)
    assert {x.page_id: x.text for x in H.extract(df).collect()} == want
    assert any("own" in t and "middle" not in t for t in want.values())


@pytest.mark.parametrize("page, wanted", [
    ('<article><p>a</p><svg class="i"/><p>b</p></article>', ["a", "b"]),
    ("<article><!--><p>a</p><!-- <p>x --><!---><p>b</p><!-- y --!>c</article>", ["a", "b", "c"]),
    ("<article><button>x<p>b</p></article>", ["x", "b"]),
    ("<article><button>x<p>b</p><button>gone</button>c</article>", ["x", "b", "c"]),
    ("<article><p class=foo'>The dog doesn't bark</p></article>", ["The dog doesn't bark"]),
    ('<main><div class="article-body promo">text</div></main>', ["text"]),
    ('<main><div class="promo">no</div><p>yes</p></main>', ["yes"]),
    ('<article><p>t</p><p class="share">Share this</p><p class="comment-count">3</p><section class="header">h</section>u</article>', ["t", "u"]),
    ('<article><p class="share">Share<p>next</article>', ["next"]),
    ("<article>a < b <3 c</article>", ["a < b <3 c"]),
    ("<article><svg><svg></svg>no</svg>yes</article>", ["yes"]),
    ('<article>x<a href="foo>y</a>z</article>', ["xyz"]),
    ('<article>A<script>if (a < b) { "</p>" }</SCRIPT >B<title>T', ["A B"]),
    ("<article>A<svg>never closed<p>B</p></article>", ["A never closed", "B"]),
    ("<article>A</ bogus>B<?php x ?>C<!doctype html>D</article>", ["A B C D"]),
    ('<article data-x="a>b" title=\'c>d\'>t</article>', ["t"]),
    ("<article>t</article", ["t"]),
])
def test_markup_of_real_pages(page, wanted):
    assert [x for x, state in H.blocks(page) if state == H.CONTENT] == wanted


@pytest.mark.parametrize("part", ['<a "', "<script ", '<a x=">"', '<a x="', "<button>", "<svg>", "<!--", "<p class='", "<div>", "</div>", "<div><p>", "<", "</", "<svg></svg", "<button></button", "<article><p>", "&", "<main>"])
def test_hostile_pages_take_linear_time(part):
    def took(n):
        page, least = part * (n // len(part)), 99.0
        for _ in range(2):
            began = time.process_time()
            H.blocks(page)
            least = min(least, time.process_time() - began)
        return least

    assert took(400_000) < 8 * took(100_000) + 0.5


def test_very_long_pages_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>word{i} goes on</p>" for i in range(60_000)) + "</article>"
    rows = [(1, "http://h/1", long, 7, "x"), (2, "http://h/2", '<a "' * 100_000, 8, "y"), (3, None, None, 9, "z")]
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int, text string")).collect()}
    assert got[1].text == "\n".join(f"word{i} goes on" for i in range(60_000)) and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == ""
