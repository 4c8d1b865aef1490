"""Wrapper induction: alignment by brute force, what the wrapper decides, the contract, deep and odd pages."""

import itertools
import random
import re

import pytest

from stakeweave.llm import wrapper

SCHEMA = "page_id long, url string, html string"


def counts_of(induced, pages):
    """counts of decide() by plain sets."""
    aligner, seen = wrapper.Aligner(induced), {}
    for page in pages:
        found, slots, own = aligner.read(page)
        for b, s, o in zip(found, slots, own, strict=True):
            if o:
                seen.setdefault((s, b.text), []).append((wrapper.page_key(found), b.link))
    out = {}
    for (s, text), who in seen.items():
        n, chars = len({k for k, _ in who}), 0 if all(link for _, link in who) else len(text)
        old = out.get(s, (0, 0, 0, 0))
        out[s] = (old[0] + n, old[1] + n * (n > 1), old[2] + chars * (n == 1), old[3] + chars * n)
    return out


def reader(pages, priors=True):
    induced = wrapper.induce(pages[: wrapper.SAMPLE])
    return wrapper.Reader(induced, wrapper.decide(induced, counts_of(induced, pages), priors), priors)


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>News</ul></nav><div class="cookie-notice">We use cookies</div><!-- x -->
<article><h1>{title} &amp; more</h1><p>First  <b>bold</b>&nbsp;{body}<br>line<p>5 < 6 &#x41;<div class="ad">Buy</div><form><input>Send</form><div id="comments"><p>nice</div></article>
<aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_extraction(spark):
    rows = [(i, f"https://h{i % 2}.example.com/{i}", PAGE.format(title=f"T{i}", body=f"body {i}")) for i in range(12)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://one.example.org/", "plain text &lt;only&gt;"), (None, "http://h0.example.com/z", PAGE.format(title="N", body="n")), (23, "http://l.example.com", "<p>" + "w " * 50_000)]
    rows += [(3, "https://h1.example.com/3", PAGE.format(title="T3", body="body 3"))] * 4
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS host", "2 AS wrapper", "3 AS layout", "4 AS text", "5 AS counts")
    got = wrapper.extracted(frame).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i in range(12):
        assert by[i].text == f"T{i} & more\n\nFirst bold body {i} line\n\n5 < 6 A" and by[i].n_chars == len(by[i].text)
    assert (by[20].text, by[21].text, by[22].text) == ("", "", "plain text <only>") and by[None].text.startswith("N & more") and by[23].n_chars == 99_999
    assert len({r.text for r in got if r.page_id == 3}) == 1
    assert wrapper.extracted(frame.limit(0)).count() == 0


def test_the_wrapper_decides_where_no_name_does():
    page = "<html><body><div><div>Welcome to the site of all stories</div></div><div><div><p>{a}</p><p>{b}</p></div></div><div><div>All rights reserved by us</div></div></body></html>"
    pages = [page.format(a=f"first words of story {i} " * 5, b=f"and more {i * i} " * 9) for i in range(9)]
    want = [f"{('first words of story %d ' % i * 5).strip()}\n\n{('and more %d ' % (i * i) * 9).strip()}" for i in range(9)]
    assert [reader(pages).extract(p) for p in pages] == want == [reader(pages, priors=False).extract(p) for p in pages]
    assert all("Welcome" in wrapper.Reader(None, None).extract(p) for p in pages)


def test_the_wrapper_decides_within_and_against_article_elements():
    inside = "<body><article><h1>title {i}</h1><p>{body}</p><section>Paid links of our friends</section></article></body>"
    pages = [inside.format(i=i, body=f"story {i} goes on " * 9) for i in range(9)]
    assert [reader(pages).extract(p) for p in pages] == [f"title {i}\n\n{('story %d goes on ' % i * 9).strip()}" for i in range(9)]
    assert "Paid links" in wrapper.Reader(None, None).extract(pages[0]) and "Paid links" not in reader(pages).extract(pages[0])
    teasers = '<body><article class="teaser"><p>Read our magazine every day</p></article><div><h1>title {i}</h1><p>{body}</p></div></body>'
    pages = [teasers.format(i=i, body=f"the story {i} is long " * 9) for i in range(9)]
    assert [reader(pages).extract(p) for p in pages] == [f"title {i}\n\n{('the story %d is long ' % i * 9).strip()}" for i in range(9)]


def test_headline_and_lead_beside_the_body_stay():
    page = '<html><body><div class="top">Welcome</div><div class="wrap"><h1>title {i}</h1><p>lead {i}</p><div class="content"><p>{body}</p></div></div><ul><li><a href="/">other {i}</a></ul>{more}</body></html>'
    pages = [page.format(i=i, body=f"long body of {i} " * 40, more="") for i in range(5)]
    own = reader(pages)
    assert own.extract(pages[2]) == f"title 2\n\nlead 2\n\n{('long body of 2 ' * 40).strip()}"
    assert own.extract(page.format(i=9, body="b", more="<div>By someone</div>")) == "title 9\n\nlead 9\n\nb\n\nBy someone"


def test_only_the_contracts_kinds_are_dropped():
    page = '<article><p hidden>one</p><p aria-hidden="true">two</p><p style="display:none">three</p><div class="share-price"><p>four</p></div><div class="alert">five</div><div id="search">six</div><div class="related">seven</div><math><mi>eight</mi></math><noscript>nine</noscript><object>ten</object></article>'
    assert reader([page]).extract(page).split("\n\n") == "one two three four five six seven eight nine ten".split()
    for gone in ('<nav>x</nav>', '<aside>x</aside>', '<div class="ads">x</div>', '<form><textarea>x</textarea></form>', '<div class="comment-list">x</div>', "<style>x</style>", '<div role="navigation">x</div>', "<select><option>x</select>"):
        html = f"<article><p>a</p>{gone}<p>b</p></article>"
        assert reader([html]).extract(html) == "a\n\nb", gone


def test_copies_and_near_copies_are_no_template():
    shell = "<body><article><h1>the headline</h1>{}</article></body>"
    near = [shell.format("".join(f"<p>paragraph {j} of the text{' x%d' % i if j == i % 7 else ''}</p>" for j in range(7))) for i in range(30)]
    for pages in (near, [shell.format("<p>copied words</p>")] * 30):
        for p in pages:
            assert reader(pages).extract(p) == "\n\n".join(re.findall("<(?:h1|p)>(.*?)</", p))


def test_hosts_of_mixed_layout(spark):
    story = '<body><div class="top">Welcome</div><article><h1>title {i}</h1><p>story {i} goes on, as it went on yesterday</p><div class="note">Paid links</div></article></body>'
    bare = '<body><div class="top">Welcome</div><div class="c"><h1>title {i}</h1><p>bare {i} goes on, as it went on yesterday</p></div><div class="end">All rights ours</div></body>'
    rows = [(i, f"http://m.example.com/{i}", page.format(i=i)) for start, page in ((0, story), (100, bare)) for i in range(start, start + 30)]
    for r in wrapper.extracted(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.text == f"title {r.page_id}\n\n{'story' if r.page_id < 100 else 'bare'} {r.page_id} goes on, as it went on yesterday"


def random_tree(rng, size):
    nodes = [wrapper.Slot("a", False)]
    for _ in range(size - 1):
        child = wrapper.Slot(rng.choice("ab"), False)
        rng.choice(nodes).children.append(child)
        nodes.append(child)
    return nodes[0]


def largest_map(a, b):
    """Simple tree matching by trying every order-preserving choice of children."""
    if a.label != b.label:
        return 0
    top = 0
    for n in range(min(len(a.children), len(b.children)) + 1):
        for x in itertools.combinations(a.children, n):
            for y in itertools.combinations(b.children, n):
                own = [largest_map(p, q) for p, q in zip(x, y, strict=True)]
                top = max(top, sum(own) if all(own) else 0)
    return top + 1


@pytest.mark.parametrize("seed", range(60))
def test_simple_tree_matching_by_brute_force(seed):
    rng = random.Random(seed)
    a, b = random_tree(rng, 8), random_tree(rng, 8)
    size, pairs = wrapper.align(a, b)
    assert size == len(pairs) == largest_map(a, b)
    parent = {id(c): s for t in (a, b) for s in wrapper.numbered(t) for c in s.children}
    for x, y in pairs[1:]:
        assert x.label == y.label and (parent[id(x)], parent[id(y)]) in pairs
    for (x, y), (v, w) in itertools.combinations(pairs, 2):
        if parent.get(id(x)) is parent.get(id(v)) is not None:
            own, other = parent[id(x)].children, parent[id(y)].children
            assert (own.index(x) < own.index(v)) == (other.index(y) < other.index(w))


@pytest.mark.parametrize("tag", ["div", "b", "p", "li", "article", "nav"])
def test_deep_pages(tag):
    page = f"<{tag}>" * 10_000 + "deep text" + f"</{tag}>" * 10_000 + "<p>end</p>"
    other = f"<{tag}>" * 9_000 + "other text"
    assert reader([page, other]).extract(page).endswith("deep text" if tag == "article" else "end")
    assert (tag == "nav") == ("deep text" not in reader([page, other]).extract(page))


def test_many_siblings():
    page = "<body>" + "".join(f"<div>text {i}</div><p>and {i}</p><section>also {i}</section>" for i in range(3000))
    assert reader([page, page + "x"]).extract(page).count("\n\n") == 8999
    classes = "".join(f'<div class="{c}{d}{e}">x {c}{d}{e}</div>' for c in "abcdefghijkl" for d in "abcdefghijkl" for e in "abcdefghijkl")
    assert reader([classes]).extract(classes).count("\n\n") == 12**3 - 1


def test_the_alignment_alone_finds_the_articles_of_large_hosts(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").withColumn("h", wrapper.host_of(F.col("url")))
    pages = pages.join(pages.groupBy("h").count().filter("count >= 100"), "h", "left_semi")
    told = {r.page_id: r.text for r in wrapper.extracted(pages).collect()}
    alone = {r.page_id: r.text for r in wrapper.extracted(pages, priors=False).collect()}
    assert len(told) > 300 and sum(told[i] == alone[i] for i in told) >= 0.95 * len(told)


def test_every_page_takes_part_in_the_wrapper(spark):
    """One page of sixty has a slot of its own; a sample of eight hash buckets would most likely miss such slots."""
    page = "<html><body><div><p>{a}</p></div><section><{tag}>{b}</{tag}></section></body></html>"
    rows = [(i, "https://h.example.com/", page.format(a=f"story {i}", b=f"more {i}", tag=f"x-{chr(97 + i % 26)}{chr(97 + i // 26)}"), "h.example.com", "") for i in range(60)]
    frame = spark.createDataFrame(rows, f"{SCHEMA}, host string, layout string")
    found = [r.wrapper for n in (1, 5) for r in wrapper.wrappers(frame.repartition(n)).collect()]
    assert len(found) == 2 and found[0] == found[1]  # whatever the partitions
    labels = [label for label, _, _ in wrapper.json.loads(found[0])]
    assert {f"x-{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)} <= set(labels) and labels.count("section") == 1
    assert wrapper.united([found[0], found[0]]) == found[0]
