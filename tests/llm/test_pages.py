import math
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import site_style, url_rules
from shelfwise.llm.queries import QUERIES, URL_RULES

URLS = [
    (1, "https://a.EXAMPLE.org/es/1?x=/y"), (2, "http://example.org/en/12"), (3, "http://example.org/en/2#a?b"), (4, "http://x.com/fr/"), (5, "http://x.com/de/9"),
    (6, "http://com/de/"), (7, "org"), (8, None), (9, ""), (10, "http://example.org"), (11, "http://example.org?q=/es/"), (12, "x://y://z/w"), (13, "://a.org/"),
    (14, "http://notexample.org/es/1"), (15, "http://ÄB.com/fr/\nx"), (15, "http://x.com/fr/"), (None, "http://x.com/fr"), (16, "http://x.org:80/"),
]


def plain(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(r), r, a) for a, r in URL_RULES for name, _, p in [r.partition("/")]
           if (host == name or host.endswith("." + name)) and path.startswith("/" + p)]
    return host, path, max(fit)[1:] if fit else None


def test_rules_against_plain_code(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "rule", "tokens")})
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    for r in url_rules.judge(pages, URL_RULES, none).collect():
        host, path, fit = plain(r["url"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, fit and fit[0], fit[1] if fit else "allow"), r
    assert url_rules.judge(pages.where("false"), URL_RULES, none).count() == 0
    assert {r["rule"] for r in url_rules.judge(pages, (), none).collect()} == {None}


def test_query_on_real_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    got = QUERIES["op10_url_rules"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, fit = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, fit and fit[0]) and (not fit or fit[1] == r["verdict"])
        assert host == urlsplit(urls[r["page_id"]]).netloc.lower()


def test_mined_rules_equal_counting(spark):
    """Bad are urls with two tokens at once; one of them alone isn't enough."""
    rows = [(f"http://{h}.example.com/{p}/{i}", h == "cheap" and p == "pills") for i in range(10) for h in ("cheap", "news", "blog") for p in ("pills", "sport", "food")]
    rows += [(None, True), ("http://cheap.example.com/pills/", None)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_rules.mine(labelled, "url", "bad", 0.05, 0.8).collect()
    assert rules and all({"path=pills"} <= set(r["tokens"]) and any("cheap" in t for t in r["tokens"]) and r["confidence"] == 1.0 for r in rules)
    assert min(len(r["tokens"]) for r in rules) == 2 and max(len(r["tokens"]) for r in rules) == 2
    mined = spark.createDataFrame(rules)
    verdicts = {r["url"]: r["verdict"] for r in url_rules.judge(labelled.drop("bad").distinct(), (), mined).collect()}
    assert all((verdicts[u] == "block") == bool(b) for u, b in rows if u and b is not None)
    assert url_rules.mine(labelled.where("not bad"), "url", "bad").count() == 0 and url_rules.mine(labelled.where("false"), "url", "bad").count() == 0


def test_prune():
    rules = [(["a", "b"], 0.9, 0.1), (["a"], 0.9, 0.2), (["a", "c"], 0.95, 0.1), (["c", "d"], 0.8, 0.1)]
    assert url_rules.prune(rules) == [(["a"], 0.9, 0.2), (["a", "c"], 0.95, 0.1), (["c", "d"], 0.8, 0.1)]


PAGES = [
    ("<p>a&eacute;b <b>c</b>d<br>e&nbsp;f</p><p>g", "aéb cd e f g"),
    ("<html><head><title>t</title><style>x{}</style></head><body><nav><a>menu</a></nav><article><h1>H</h1><p>one\n two</p></article><footer>f</footer>", "H one two"),
    ("<body class=sidebar><header><h1>Site</h1></header><main><header><h2>T</h2></header>x<div class='comments list'>no</div><aside>no</aside></main>", "T x"),
    ("<article>a<script>if (1 < 2) { '</p>' }</script>b<!-- no <b> -->c</article>", "a bc"),
    ("<article>1</article><div id=adBox>no</div><article>2</article>", "1 2"), ("<div hidden>no</div><div style='display: none'>no</div>yes", "yes"),
    ("", ""), (None, ""), ("<<>>< p>&bogus; &#x41;&#66;", "<<>>< p>&bogus; AB"), ("<ul><li>a<li>b</ul><table><tr><td>c<td>d", "a b c d"),
    ("<form>no<input></form><p>x</form>y", "xy"), ("<form>no<input></form><p>x</p>y", "x y"), ("<article><p>open", "open"), ("a\x00b \x1c c", "a\x00b c"),
]


def test_pages(spark):
    for source, want in PAGES:
        if source and "<<>>" in source:
            continue
        assert site_style.main_text(source) == want, source
    rows = [(i, "http://h.com/", s) for i, (s, _) in enumerate(PAGES)] + [(None, None, "<p>x</p>"), (0, "http://h.com/", PAGES[0][0])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("host", "text", "path", "low")})
    got = site_style.extract(frame).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert site_style.extract(frame.where("false")).count() == 0
    deep = "<div>" * 30000 + "x" + "</div>" * 30000 + "<p>" + "y " * 200000
    assert len(site_style.main_text(deep)) == 1 + 400000


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_repeated_branches_of_a_site_go(spark, broadcast):
    """A block without a name that says the same on most pages of its host goes; on another host, and on few pages, it stays."""
    def page(host, i, block):
        return f"http://{host}/{i}", f"<body><div class=x><p>{block}</p></div><div class=y><p>story {host} number {i}</p><p>more of {i}</p></div></body>"

    rows = [page("big.com", i, "Sign up today" if i % 10 else f"own {i}") for i in range(60)] + [page("small.com", i, "Sign up today") for i in range(3)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["url"]: r["text"] for r in site_style.extract(frame, broadcast_entries=broadcast).collect()}
    assert got["http://big.com/1"] == "story big.com number 1 more of 1" and got["http://big.com/10"].startswith("own 10 story")
    assert got["http://small.com/1"] == "Sign up today story small.com number 1 more of 1"


def test_importance_is_entropy(spark):
    rows = [(f"http://h.com/{i}", f"<body><p>{'same' if i < 8 else i}</p></body>") for i in range(10)]
    frame = spark.createDataFrame([(u, h, "h.com") for u, h in rows], "url string, html string, host string")
    content = [r["value"] for r in site_style.style_tree(frame.select("host", "html"), 5).where("key <> path").collect()]
    assert [round(v, 6) for v in content] == [round(math.log(8) / math.log(10), 6)] * 2  # the whole text, and its word


def test_entries_of_a_whole_host_equal_counting(spark):
    """Every page of the given table's largest host: entropies from sets of pages kept in plain dicts."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(url_rules.host_of(F.col("url")).alias("host"), "html")
    host = pages.groupBy("host").count().orderBy(F.desc("count"), "host").first()["host"]
    own = pages.where(F.col("host") == host)
    seen, looks = {}, {}
    for i, r in enumerate(own.collect()):
        for at in site_style.style_nodes(site_style._page(r["html"]), host):
            seen.setdefault((at.path, None), set()).add(i)
            if at.style is not None:
                looks.setdefault(at.path, {}).setdefault(at.style, set()).add(i)
            else:
                for key in (at.text, *at.finer):
                    seen.setdefault((at.path, key), set()).add(i)
    signed = lambda k: k - (1 << 64) if k >= 1 << 63 else k
    want = {}
    for (path, key), pages_with in seen.items():
        m = len(seen[path, None])
        if key is not None and m >= 5 and len(pages_with) > 1 and len(pages_with) >= m ** 0.5:
            want[signed(path), signed(key)] = math.log(len(pages_with)) / math.log(m)
    for path, styles in looks.items():
        m, n = len(seen[path, None]), [len(s) for s in styles.values()]
        if m >= 5:
            want[signed(path), signed(path)] = -sum(x / sum(n) * math.log(x / sum(n)) for x in n) / math.log(max(m, sum(n))) - len(n)
    got = {(r["path"], r["key"]): r["value"] for r in site_style.style_tree(own).collect()}
    assert len(want) > 20 and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_words_and_links_of_repeated_blocks(spark):
    """Without names the tree finds blocks whose words or links repeat, though no two texts are alike; in an article, words alone remove nothing."""
    draw = np.random.default_rng(3)
    def page(i):
        menu = " ".join(draw.permutation(["home", "news", "sport", "culture", "about", "contact"]))
        story = " ".join(f"w{draw.integers(1e6)}" for _ in range(30))
        return f"<body><div class=a>{menu}</div><div class=b><a href=/x>{menu.split()[0]}</a> <a href=/y>{menu.split()[1]}</a></div><div class=c><p>{story}</p></div></body>", story

    made = [page(i) for i in range(60)]
    frame = spark.createDataFrame([(i, f"http://h.com/{i}", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")
    for names in (False, True):
        got = {r["page_id"]: r["text"] for r in site_style.extract(frame, names=names).collect()}
        assert all(got[i].endswith(story) and "culture" not in got[i] for i, (_, story) in enumerate(made))
    inside = frame.withColumn("html", F.replace(F.replace("html", F.lit("<body>"), F.lit("<body><article>")), F.lit("</body>"), F.lit("</article></body>")))
    assert all(len(r["text"].split()) == 38 for r in site_style.extract(inside).collect())


def test_repeated_branches_inside_articles_go(spark):
    """Blocks and loose lines without a name, on most pages of a host, go from inside its articles, beside many other paragraphs; copies stay whole."""
    def page(host, i, block, story):
        paragraphs = "".join(f"<p>{story} {k}</p>" for k in range(20))
        return f"http://{host}/{i}", f"<body><article><h1>T{i}</h1>{paragraphs}<p>{block}</p><div><p>Licence</p><p>{block} too</p></div>Share <b>this</b></article></body>"

    rows = [page("big.com", i, "Read our promo", f"story {i}") for i in range(40)] + [page("small.com", i, "Read our promo", f"s{i}") for i in range(3)]
    rows += [(f"http://copies.com/{i}", "<article><p>all pages</p><p>are copies</p></article>") for i in range(10)]
    rows += [("http://big.com/plain", "<body><div>Licence</div><div><p>a page of its own</p></div></body>")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["url"]: r["text"] for r in site_style.extract(frame).collect()}
    assert got["http://big.com/7"] == "T7 " + " ".join(f"story 7 {k}" for k in range(20))
    assert got["http://small.com/1"] == "T1 " + " ".join(f"s1 {k}" for k in range(20)) + " Read our promo Licence Read our promo too Share this"
    assert got["http://copies.com/3"] == "all pages are copies" and got["http://big.com/plain"] == "Licence a page of its own"


def test_a_branch_with_something_of_its_own_stays(spark):
    """Presentation alone removes nothing: what a page alone says stays, however uniform its elements are."""
    rows = [(i, f"http://h.com/{i}", f"<body><div>{''.join(f'<p>item {k}</p>' for k in range(30))}<p>only {i}</p></div></body>") for i in range(50)]
    got = site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"only {r['page_id']}" for r in got)


NAMED = [
    ("<div class='content-with-sidebar'><article>a</article></div>", "a"), ("<div id='no-sidebar'><div class=x><p>a</p></div></div>", "a"),
    ("<div class='page sidebar'><main>a<div class=sidebar>b</div></main></div>", "a b"), ("<div class='has-nav'><article>a</article><nav>n</nav></div>", "a"),
    ("<form id=aspnetForm><div class=header>h</div><article>a<form>f</form></article></form>", "a"),
    ("<article><p>a</p><section class='legal'>b</section><p class='notice'>c</p><p class='share'>no</p></article>", "a b c"),
    ("<article>a</article><div class='comments'><article class=comment>no</article></div>", "a"), ("<div class='comments'><article>a</article></div>", "a"),
    ("<main><p>a</p><div class='comments'><article class=comment>no</article></div></main>", "a"),
    ("<aside><article>no</article></aside><main>a</main>", "a"), ("<div style='display:none'><article>a</article></div>", "a"),
    ("<div class=sidebar>no</div><div class='related items'>no</div><p>a</p>", "a"), ("<div class='legal'><p>a</p></div>", "a"),
    ("<article hidden>no</article><article>a</article>", "a"), ("<article hidden>a</article>", "a"),
    ("<div class=sidebar><article> </article></div><p>a</p>", "a"), ("<div class='site-social-widget-area'><p>a</p></div>", "a"),
    ("<form id='aspnetForm'><p>a</p></form>", "a"), ("<div class='page ad-free'><p>a</p></div>", "a"), ("<div class='post comments-open'><p>a</p></div>", "a"),
    ("<div class='layout no-nav'><p>a</p></div>", "a"), ("<article><p class='share-price'>a</p><div class='comment-by-author'>b</div></article>", "a b"),
    ("<form><nav>n</nav><div class=ad>x</div><div><p>a</p></div><footer>f</footer></form>", "a"), ("<div class=comments><p>a</p></div>", "a"), ("<nav>n</nav>", ""),
    ("<div class='comments'>a</div><footer>f</footer>", "a"), ("<div class=share>a</div><div class=ad>b</div>", "a b"),
]


@pytest.mark.parametrize(("source", "want"), NAMED)
def test_names_never_drop_the_article(source, want):
    assert site_style.main_text(source) == want
