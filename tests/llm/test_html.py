import pytest

from relaypack.llm import html_density as hd

P = "The quick brown fox jumps over the lazy dog while the committee was reading long reports about the weather. "


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}<style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = '<footer><p>All rights reserved, some company name and a long address line in a footer.</p></footer>'


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"{NAV}<article><h1>Title</h1><p>{P}</p><p>{P}</p></article>{FOOT}", f"Title {P.strip()} {P.strip()}"),
        (f"{NAV}<div class='post'><p>{P}</p><p>a&amp;b &lt;c&gt; &#233;&eacute; {P}</p></div>{FOOT}", f"{P.strip()} a&b <c> éé {P.strip()}"),
        (f"<article><p>{P}</p><div class='ad'>Buy now</div><form><label>Mail</label><input></form><p>{P}</p><section id='comments'><p>First! {P}</p></section></article>", f"{P.strip()} {P.strip()}"),
        (f"<article><p>one\n two\t three<br>four</p><ul><li>x<li>y</ul><p>{P}</article>", f"one two three four x y {P.strip()}"),
        (f"<main><p>{P}<b>bold</b>er<i> it</i></p><!-- no --><aside>side {P}</aside></main>", f"{P}bolder it"),
    ],
)
def test_main_text(body, want):
    assert hd.main_text(page(body)) == want


@pytest.mark.parametrize("odd", [None, "", "   ", "<p", "</div>", "<html><body></body></html>", "<!-- open", "<script>x"])
def test_odd_pages(odd):
    assert hd.main_text(odd) == ""


def test_deep_and_broken_markup():
    assert P.strip() in hd.main_text("<div>" * 20_000 + P)
    assert hd.main_text("plain text only") == "plain text only"


def test_generated_pages_keep_articles(spark, sf_dir):
    """No furniture of the driver's pages is left, and each page that has an article has text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = hd.extract(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.n_chars > 0 for r in rows) >= 0.9 * len(rows)
    assert not any("<p>" in r.text or "track(" in r.text or "margin:0" in r.text for r in rows)
    extra = spark.createDataFrame([(1, "u", page(f"<p>{P}</p>"), "c", "d"), (None, None, None, "c", None)], "page_id bigint, url string, html string, text string, n_chars string")
    assert sorted((r.page_id or 0, r.text) for r in hd.extract(extra).collect()) == [(0, ""), (1, P.strip())]
    assert hd.extract(pages.limit(0)).collect() == []


LONG = "".join(f"<p>{P}{i}</p>" for i in range(16))
WHOLE = " ".join(f"{P}{i}" for i in range(16))


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"{NAV}<div class='layout with-sidebar'><article>{LONG}</article><div class='sidebar'>side links <a href=x>more</a></div></div>{FOOT}", WHOLE),
        (f"{NAV}<main><div class='content no-comments'>{LONG}</div></main>{FOOT}", WHOLE),
        (f"<form id='aspnetForm' action=x>{NAV}<div id=c>{LONG}</div>{FOOT}<input type=submit></form>", WHOLE),
        (f"<article><p>{P * 5}</p><div class='alert'><p>Second part. {P * 5}</p></div></article>{FOOT}", f"{P * 5}Second part. {P * 5}".strip()),
        (f"<div class=post><h1>T</h1><p>{P * 2}</p></div><div id=comments><p>{P * 3}</p><p>{P * 3}</p></div>", f"T {P * 2}".strip()),
        (f"<div class=post><h1>T</h1><p>{P * 2}</p></div><ul class='comment-list'><li>{P}<li>Nice {P * 2}</ul>", f"T {P * 2}".strip()),
        (f"<div class=m><a href=1>One thing</a> <a href=2>Two things</a></div><div class=post><h1>T</h1>{LONG}</div><div class=copy>Copyright us</div>", f"T {WHOLE}"),
        (f"<div><h1>Title</h1><section><h2>A</h2>{LONG}</section><section><h2>B</h2>{LONG}</section></div>", f"Title A {WHOLE} B {WHOLE}"),
        (f"<table><tr><td><a href=1>x</a><br><a href=2>y</a></td><td>{LONG}</td></tr></table>", WHOLE),
    ],
)
def test_density_decides_and_names_take_no_larger_part(body, want):
    assert hd.main_text(page(body)) == want


def test_depth_and_stray_ends_take_no_square():
    import time

    began = time.process_time()
    assert hd.main_text("<div>" * 40_000 + P + "</i>" * 40_000 + "</div>" * 40_000) == P.strip()
    assert time.process_time() - began < 5


def _brute(p, kept):
    """Densities straight from their definition: descendants of each node by walking up from every node."""
    import math

    n = len(p.parent)
    under = [[] for _ in range(n)]
    for i in range(n):
        if kept[i]:
            k = i
            while k >= 0:
                under[k].append(i)
                k = p.parent[k]
    size = [0] * n
    for k, text in p.pieces:
        if k >= 0 and kept[k]:
            size[k] += len(" ".join(text.split()))
    numbers = []
    for i in range(n):
        below = [k for k in under[i] if k != i]
        numbers.append((sum(size[k] for k in under[i]), sum(size[k] for k in under[i] if p.links[k]), len(below) or 1, sum(p.name[k] == "a" for k in below) or 1))
    body = p.name.index("body") if "body" in p.name else 0
    ratio = numbers[body][1] / (numbers[body][0] or 1)
    out = []
    for (c, lc, t, lt), own in zip(numbers, kept, strict=True):
        if not c or not own:
            out.append(0.0)
            continue
        x, base = c / (lc or 1) * t / lt, c / ((c - lc) or 1) * lc + ratio * c + math.e
        ln = math.log(base)
        out.append(c / t * (0.0 if x <= 1 else math.log(x) / math.log(ln) if ln > 1.0000001 else math.log(x)))
    return out, [sum(out[k] for k in range(1, n) if p.parent[k] == i) for i in range(n)]


def test_densities_equal_their_definition_on_all_pages(spark, sf_dir):
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        p = hd.Page(row.html)
        kept = p.furnished()
        _, density, total, _, _ = p.densities(kept)
        want, sums = _brute(p, kept)
        assert density == pytest.approx(want) and total == pytest.approx(sums)
