import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from statuta.llm.ball_tree import top_k
from statuta.llm.html_extract import Page, extract_text
from statuta.llm.url_filter import url_verdicts
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "html, blocks",
    [
        ("", []),
        ("a < b <p>c", ["a < b", "c"]),
        ("<nav>n</nav><article><h1>T &amp;\n x</h1><p>one<br>two<p><b>three</article><footer>f</footer>", ["T & x", "one two", "three"]),
        ('<main>m<div class="share-bar">s</div><ul><li>1<li>2</ul><form>f</form></main>out', ["m", "1", "2"]),
        ('<article>a</article><article class="comment">c</article><div id="cookie-notice">k</div>', ["a"]),
        ('<script>var t="</p>";</script>text <i>bold</i>er<!-- no --><style>p{}</style>', ["text bolder"]),
        ("<table><tr><td>x<td>y<tr><td>z</table>", ["x", "y", "z"]),
    ],
)
def test_page_blocks(html, blocks):
    assert [b[0] for b in Page(html).blocks] == blocks


def test_site_templates(spark):
    page = lambda k, host: (k, f"http://{host}/{k}", f"<body><div>Top links here</div><p>body of page {k}, longer than the rest of it</p><div>All the end</div>")
    rows = [page(k, "a.b") for k in range(12)] + [page(100, "c.d")] + [(200 + k, "http://copy.x/", "<p>one</p><p>same article</p>") for k in range(20)] + [(300, None, None), (None, "u", "<p>x</p>")]
    got = {r.page_id: r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "body of page 3, longer than the rest of it"  # recurring on the host
    assert got[100].text.startswith("Top links here\n")  # one page of its host
    assert got[205].text == "one\nsame article"  # copies count once
    assert got[300].text == "" and got[300].n_chars == 0 and got[None].text == "x"


def test_counts_decide_within_and_outside_articles(spark):
    page = lambda k, host: (k, f"http://{host}/{k}", f"<body>Site name<article><h2>Teaser</h2><p>Read this first.</p></article><div><p>main text {k}</p></div><article><p>own words {k}</p><p>All rights reserved.</p></article></body>")
    rows = [page(k, "small.x") for k in range(4)] + [page(k, "large.x") for k in range(10, 40)] + [page(100, "one.x")]
    rows += [(200 + k, f"http://mixed.x/{k}", f"<p>page {k}</p>" + "<p>seldom</p>" * (k < 14) + "<p>often</p>" * (k < 15)) for k in range(30)]
    rows += [(300 + k, f"http://near.x/{k}", f"<p>{'shared words ' * 20}</p><p>{k}</p>") for k in range(3)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"main text {k}\nown words {k}" for k in (*range(4), *range(10, 40)))
    assert got[100] == "Site name\nTeaser\nRead this first.\nmain text 100\nown words 100\nAll rights reserved."
    assert got[200] == "page 0\nseldom" and got[214] == "page 14" and got[302] == "2"


def test_templates_against_plain_counts(spark):
    """Generated hosts: blocks of every page against counts of element sources, by a stack of tags alone."""
    rng = random.Random(11)
    shared = {h: [f"<p>host {h} notice {k}</p>" for k in range(4)] for h in "ab"}

    def source(h, k):
        parts = [f"<p>text {k} {j} {rng.random()}</p>" for j in range(3)] + [x for x in shared[h] if rng.random() < 0.45] + [f"<div><h2>box {h}</h2><p>{rng.choice('xy')}</p></div>"]
        rng.shuffle(parts)
        return f"<body>{'<ul>' + ''.join(f'<li>menu {h} {j}</li>' for j in range(30)) + '</ul>'}<article>{''.join(parts)}</article></body>" if h == "a" else f"<body>{''.join(parts)}</body>"

    rows = [(100 * n + k, f"http://{h}.x/{k}", source(h, k)) for n, (h, size) in enumerate({"a": 24, "b": 7}.items()) for k in range(size)]
    rows += rows[:2] + [(900, "http://a.x/long", "<p>" + "very long " * 60_000 + "</p>")]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, hashes string")).collect()}
    on = {"a": 25, "b": 7}
    element = re.compile(r"<(p|li|h2)>(.*?)</\1>|<(/?)(div|ul)>")
    count = Counter()
    for host, unique in ((h, {r[2] for r in rows if f"//{h}." in r[1]}) for h in on):
        for page in unique:
            count.update((host, x) for x in set(re.findall(r"<ul>.*?</ul>|<div>.*?</div>|<(?:p|li|h2)>[^<]*</(?:p|li|h2)>", page)) | {m[0] for m in element.finditer(page) if m[2]})
    removed = 0
    for page_id, url, page in rows:
        host = url[7]
        often = lambda x: count[host, x] >= max(3, on[host] / 2)
        kept, box = [], ""
        for m in re.finditer(r"<ul>.*?</ul>|<div>.*?</div>|<(?:p|li|h2)>[^<]*</(?:p|li|h2)>", page):
            for block in re.findall(r"<(?:p|li|h2)>[^<]*</(?:p|li|h2)>", m[0]):
                if not often(m[0]) and not often(block):
                    kept.append(re.sub("<[^>]*>", "", block).strip())
                else:
                    removed += 1
        assert got[page_id] == "\n".join(kept), page_id
    assert removed > 100 and extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_rules(spark):
    cases = {
        "http://x.net/a": ("x.net", "/a", "net/", "block"),
        "http://A.Example.net/en/1?q": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://casino-win.example.com/en/1": ("casino-win.example.com", "/en/1", None, "block"),
        "http://ads-track.com/optout/": ("ads-track.com", "/optout/", None, "allow"),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
        "no scheme.net/": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(cases)], "page_id int, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_verdicts(pages.limit(0)).count() == 0
    # Repeated rows, a very long address, thousands of rules.
    long = "http://casino." + "x" * 100_000 + ".net/"
    pages = spark.createDataFrame([(1, long), (1, long), (2, "http://h77.org/p/1"), (3, "http://a.h78.org/q/")], "page_id int, url string")
    many = [("block" if k % 2 else "allow", f"h{k}.org", "/p/") for k in range(6000)] + [("allow", "org", "/")]
    patterns = [("block", [f"t{k}"], f"t{k}") for k in range(6000)] + [("block", ["casino"], "casino")]
    got = Counter((r.page_id, r.rule, r.verdict) for r in url_verdicts(pages, host_rules=many, pattern_rules=patterns).collect())
    assert got == {(1, None, "block"): 2, (2, "h77.org/p/", "block"): 1, (3, "org/", "allow"): 1}


def brute_top_k(rows, k):
    made = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            made[i] = [math.floor(256 * x) for x in v]
    out = []
    for q, v in made.items():
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in made.items() if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_is_exact(spark):
    rng = random.Random(1)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)]) for k in range(700)] + [(k, [0.5, -0.25, 0.125, 0.0, 1.0, -1.0]) for k in range(700, 1000)]
    rows += [(1000, [1e12, 1.0, 0.0, 0.0, 0.0, 0.0]), (1050, None), (1100, [float("nan")] * 6), (1150, [None] * 6), (1200, [1.0, 2.0]), (1250, []), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(frame, F.col("vec_id") % 50 == 0, shard_rows=150).collect())
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert got == [(q, r, i, clip(s)) for q, r, i, s in brute_top_k(rows, 5)]
    assert top_k(frame.limit(0), F.lit(True)).count() == 0


def test_top_k_leaves_shards_out(spark):
    """Far clusters and a third of equal rows: exact, with rows of one id as candidates each, whatever the partitioning."""
    from statuta.llm.ball_tree import Space

    rng = random.Random(4)
    rows = [(k, [rng.gauss(20 * (k % 4 == d), 1) for d in range(4)]) for k in range(1200)] + [(k, [30.0, 0.0, 0.0, 0.0]) for k in range(1200, 1800)]
    extra = [(50, [0.1, 0.2, 0.3, 0.4]), (77, [1.0, 2.0, 3.0, 4.0]), (77, [1.0, 2.0, 3.0, 4.0])]
    frame = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(map(tuple, top_k(frame, F.col("vec_id") % 50 == 0, k=7, shard_rows=100).collect()))
    made = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows + extra]
    asked = {q: min(v for i, v in made if i == q) for q in {i for i, _ in made if i % 50 == 0}}
    expected = []
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in made if i != q)[:7]
        expected += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(expected)
    sample = np.array([v for _, v in made])
    space = Space(sample, 16)
    assert 8 <= len(space.centres) <= 16 and set(space.ball(sample)) <= set(range(len(space.centres)))


def test_names_of_furniture_leave_articles_alone():
    blocks = lambda source: [b[0] for b in Page(source).blocks]
    assert blocks('<article><div class="related-work"><p>a</p></div><ul class="share-prices"><li>b</ul><section id="alert-levels">c</section><div class="share-bar">z</div></article>') == ["a", "b", "c"]
    assert blocks('<div class="post-comment-on-law"><p>law</p></div><div class="ad-slot top">x</div><div id="comments-2">y</div>') == ["law"]
    assert blocks("<article><p>press <button>Go</button> now</p></article><button>Menu</button>") == ["press Go now"]


def test_very_deep_markup_takes_linear_time():
    import time

    from statuta.llm.html_extract import Marked, without

    n = 60_000
    for source, text in (("<div>" * n + "x" + "</div>" * n, ["x"]), ("<b>x" * n + "<p>y" * n + "</i>" * n, None), ("<table>" + "<tr><td>z" * n, None), ("<ul><li>" * n, [])):
        began = time.time()
        made = Marked(source, "host")
        assert text is None or without(made.packed(), set()) == text
        assert time.time() - began < 30, source[:20]


def test_furniture_that_no_rule_knows_goes_by_its_counts(spark):
    """Generated hosts: menus and endings in plain elements, nested at random, against the hosts' own lists."""
    rng = random.Random(21)
    rows, want = [], {}
    for h in range(4):
        menu = "".join(f"<section><span>go to {h} {j}</span></section>" for j in range(6))
        end = f"<div><div>{''.join('<h5>all rights ' + str(h) + '</h5>' for _ in range(2))}</div></div>"
        for k in range(9):
            own = [f"text {h} {k} {j} {rng.random()}" for j in range(rng.randrange(1, 5))]
            wrap = rng.randrange(3)
            page = f"<body><div><div>{menu}</div></div>{'<div>' * wrap}{''.join(f'<p>{x}</p>' for x in own)}{'</div>' * wrap}<nav>here {k}</nav>{end}</body>"
            rows.append((100 * h + k, f"https://h{h}.example/{k}", page))
            want[100 * h + k] = "\n".join(own)
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
