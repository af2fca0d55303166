"""Pages as trees, against Python's own HTML parser; selectors against ancestor chains; searches of pages."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quarterlens import params as P
from quarterlens.operators import links, searches, textscan
from quarterlens.operators.pagetree import IMPLIED, VOID, elements, fitting, near_addresses, page_tree, select, step
from quarterlens.params import EngineParams

SCHEMA = "html string, page_id long, url string, text string, tag string"


class Second(HTMLParser):
    """Elements as (tag, attributes, parent, depth, text), by the same rules over another tokenizer."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED:
            ended, stops = IMPLIED[tag]
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.out[self.stack[k]][0]
                if name in ended:
                    del self.stack[k:]
                    break
                if name in stops:
                    break
        first = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        self.out.append([tag, first, self.stack[-1] if self.stack else -1, len(self.stack), ""])
        if tag not in VOID:
            self.stack.append(len(self.out) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.out[self.stack[k]][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        if not self.stack or self.out[self.stack[-1]][0] not in ("script", "style"):
            for e in self.stack:
                self.out[e][4] += data


def second(html):
    parser = Second()
    parser.feed(html)
    parser.close()
    return [tuple(x) for x in parser.out]


def first(html):
    found, text = elements(html)
    return [(tag, attributes, parent, depth, text[a:b]) for tag, attributes, parent, depth, _, a, b, _ in found]


PIECES = [
    "<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<i class='x y'>", "</i>", "<ul>", "</ul>", "<li>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<br>", "<br/>",
    '<a href="/x?a=1&amp;b=2" id=q>', "</a>", "<A HREF=plain>", "text &amp; more ", "R&D ", "&copy;", "<!-- <a href=no> -->", "<script>var x='<a href=1>';</script>", "\n  ",
    "<img alt='a > b' src=i>", "<section id=main>", "</section>", "<h1>", "</h1>", "<title>a &amp; c</title>", "<span onclick=\"f('x')\">", "</span>", "<option>", "</zz>", "é日 ",
]


@pytest.mark.parametrize("seed", range(60))
def test_tree_against_second_parser(seed):
    rng = random.Random(seed)
    html = "".join(rng.choices(PIECES, k=rng.randint(0, 60)))
    assert first(html) == second(html)
    found, _ = elements(html)
    for pre, e in enumerate(found):  # intervals nest, and are the ancestor relation
        inside = [k for k in range(pre + 1, len(found)) if pre in chain(found, k)]
        assert e[4] == (inside[-1] if inside else pre) and inside == list(range(pre + 1, e[4] + 1))


def chain(found, k):
    out = []
    while (k := found[k][2]) >= 0:
        out.append(k)
    return out


def test_odd_markup():
    assert elements("") == ([], "")
    assert [e[0] for e in elements("x < 3 <a")[0]] == ["a"] and elements("x < 3 <")[1] == "x < 3 <"
    assert elements("<!-- open <a>")[0] == [] and elements("<script><a>")[0][0][0] == "script"
    assert elements("<div a=1 A=2 b c='' =d>")[0][0][1]["a"] == "1"
    assert [(e[0], e[5], e[6]) for e in elements("<title>a <b></b&gt; c</TITLE >d")[0]] == [("title", 0, 11)]
    assert len(elements("<div>" * 5000 + "x")[0]) == 5000


def frame(spark, *pages):
    return spark.createDataFrame([(h, i, f"https://h{i}.com/ir/x", "", "") for i, h in enumerate(pages)], SCHEMA)


def test_links_of_odd_pages(spark):
    page = (
        '<a href="?a=1&amp;b=2">R&amp;D</a><!-- <a href="/c">c</a> --><script>"<a href=/s>"</script><a>bare</a><a href=\'\'>e</a><A HREF=/u>U<br>p</A>'
    )
    got = links.page_links(frame(spark, page, None, "")).orderBy("ord").collect()
    assert [(r.page_id, r.ord, r.href, r.text) for r in got] == [(0, 0, "?a=1&b=2", "R&D"), (0, 1, None, "bare"), (0, 2, None, "e"), (0, 3, "/u", "Up")]
    assert links.page_links(frame(spark)).count() == 0


def test_clickable_elements(spark):
    page = '<div onclick="o()"><div class="button x">in</div> out</div><p><img class="link"><p>next <a class="link"><b>t</b> more</a><i class=button>i</i>'
    got = {(r.selector, r.tag, r.text) for r in links.clickable(frame(spark, page)).collect()}
    assert got == {
        ("div[onclick]", "div", "in out"), ("[onclick]", "div", "in out"), ("[class*=button]", "div", "in"), ("[class*=link]", "img", ""), ("a", "a", "t more"),
        ("[class*=link]", "a", "t more"), ("[class*=button]", "i", "i"),
    }


@pytest.mark.parametrize("seed", range(3))
def test_selectors_against_chains(spark, seed):
    rng = random.Random(seed)
    pages = ["".join(rng.choices(PIECES, k=80)) for _ in range(6)]
    steps = {"x": [step("div"), step("p"), step("a")], "y": [step(cls="y"), step(has="href")], "z": [step("li")], "main": [step(id="main"), step("b")]}
    plain = {"div": lambda e: e[0] == "div", "p": lambda e: e[0] == "p", "a": lambda e: e[0] == "a", "cls": lambda e: "y" in e[1].get("class", "").split(),
             "href": lambda e: "href" in e[1], "li": lambda e: e[0] == "li", "id": lambda e: e[1].get("id") == "main", "b": lambda e: e[0] == "b"}
    chains = {"x": ["div", "p", "a"], "y": ["cls", "href"], "z": ["li"], "main": ["id", "b"]}
    want = set()
    for i, html in enumerate(pages):
        found, _ = elements(html)
        for k, e in enumerate(found):
            for name, parts in chains.items():
                if plain[parts[-1]](e):
                    rest = parts[:-1]
                    for a in chain(found, k):
                        if rest and plain[rest[-1]](found[a]):
                            rest = rest[:-1]
                    if not rest:
                        want.add((i, k, name))
    tree = page_tree(frame(spark, *pages))
    assert {(r.page_id, r.pre, r.selector) for r in fitting(tree, steps).collect()} == want
    flags = select(tree, steps)
    assert {(r.page_id, r.pre, n) for r in flags.collect() for n in steps if r[n]} == want


def test_areas(spark):
    page = (
        '<div class="main nav-menu"><p><a href=/1>1</a></div><nav><header><a href=/2>2</a></header></nav><div class="menus"><a href=/3>3</a></div>'
        "<footer><a href=/4>4</a></footer><footer><a href=/5>5</a></footer>"
    )
    got = {(r.href, r.area) for r in links.area_links(frame(spark, page)).collect()}
    assert got == {(f"/{i}", None) for i in range(1, 6)} | {("/1", "nav"), ("/2", "nav"), ("/4", "footer")}


def test_near_addresses(spark):
    page = '<a href="/a"><b><i>x</i></b></a><div onclick="d()"><a href=""><u>y</u></a></div><p>z</p>'
    tree = page_tree(frame(spark, page), own=True)
    got = {r.own: (r.address, r.above) for r in near_addresses(tree, 1).filter("own IS NOT NULL").collect()}
    assert got == {"x": (None, None), "y": (None, None), "z": (None, None)}
    far = {r.own: (r.address, r.above) for r in near_addresses(tree, 2).filter("own IS NOT NULL").collect()}
    assert far == {"x": ("/a", 2), "y": ("d()", 2), "z": (None, None)}


def test_words_in_one_pass(spark):
    words = [["Alpha"], ["pha be", "phabe"], ["beta"], [""], ["İx"], ["alpha"]]
    texts = ["ALPHA beta", "alphabeta", "", None, "none", "beta" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", textscan.words_in(F.col("t"), words).alias("w"))
    assert [r.w for r in df.collect()] == [[0, 1, 2, 5], [0, 1, 2, 5], [], [], [], [2]]


def test_first_hits_on_whole_texts(spark):
    url = "https://investors.example.com/q3.pdf"
    body = "x" * 100_000 + f" İ Q3 at {url} " + "y" * 300 + " report, report REPORT report report report " + url + " " + "no q5 " + "z" * 500 + "aaaa"
    words = [P.SPELLINGS["Q[1-4]"], ["report"], ["aa"]]
    got = textscan.first_hits(spark.createDataFrame([(1, body), (2, None)], "id long, body string"), "id", "body", words).collect()
    want = []
    for rank, pattern in enumerate(["Q[1-4]", "report", "aa"]):
        for m in list(re.finditer(pattern, body, re.IGNORECASE))[:5]:
            near = body[max(0, m.start() - 200) : m.end() + 200]
            want += [(1, rank, m.group(), m.start(), k, u.group()) for k, u in enumerate(re.finditer(r"https?://[^\s<>\"]{10,}", near))]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 6


# -- searches --

DEFAULTS = EngineParams()


def test_keyword_search_stops_and_opens_a_second_tier(spark):
    pdf, page = "https://x.com/2025/q2/a{}.pdf", "https://x.com/earnings/2025/b{}"
    rows = [("A", "ZZ", i, "Q2 2025 earnings report", pdf.format(i)) for i in range(5)]  # the keyword ends at the first score above 0.9
    rows += [("B", "GS", 0, "Quarterly results 2025", page.format(0)), ("B", "GS", 1, "Oil earnings 2025 report", page.format(1))]
    rows += [("B", "GS", 2, "Investment Banking Earnings 2025 report", page.format(2)), ("B", "GS", 3, "x", page.format(3))]
    rows += [("C", "ZZ", i, "Other quarterly report 2025", pdf.format(i)) for i in range(60)]  # no keyword: the second tier, over 30
    rows += [("D", "ZZ", 0, "", pdf.format(0)), ("D", "ZZ", 1, None, pdf.format(1)), ("D", "ZZ", 2, "Quarterly earnings 2025", None)]
    df = spark.createDataFrame(rows, "company_id string, ticker string, link_id long, text string, url string")
    got = {}
    for r in searches.keyword_search(df, DEFAULTS).collect():
        got.setdefault(r.company_id, []).append((r.link_id, r.tier, r.keyword, round(r.score, 6)))
    assert sorted(got["A"]) == [(0, 1, "q2 2025", 1.0)] + [(i, 2, "earnings", 0.4) for i in range(1, 5)]
    assert sorted(got["B"]) == [(0, 1, "quarterly results", 0.9), (2, 1, "investment banking earnings", 0.9)]
    assert len(got["C"]) == 30 and {x[1:] for x in got["C"]} == {(2, "quarterly", 0.4)}
    assert "D" not in got


def test_fixed_pages_take_the_first_that_has_any(spark):
    tried = searches.fixed_pages(spark.createDataFrame([(1, "AMZN"), (2, "KO"), (3, "V")], "company_id long, ticker string"))
    pages = {(r.company_id, r.page_ord): r.page for r in tried.collect()}
    assert set(pages) == {(1, 0), (1, 1), (3, 0), (3, 1)}
    shown = [
        (pages[1, 0], 0, "Report 2019", "https://a.com/old.pdf"), (pages[1, 0], 200, "2025", "https://a.com/late.pdf"), (pages[1, 1], 0, "Q1 2025", "https://a.com/1.pdf"),
        (pages[1, 1], 1, None, "https://a.com/2024.xlsx"), (pages[3, 0], 0, "2024", "https://v.com/a.pdf"), (pages[3, 1], 0, "2025", "https://v.com/b.pdf"),
        (pages[3, 0], 1, "2025", None),
    ]
    found = searches.first_page_with_reports(tried, spark.createDataFrame(shown, "page string, ord int, text string, url string"))
    assert sorted((r.company_id, r.page_ord, r.url) for r in found.collect()) == [(1, 1, "https://a.com/1.pdf"), (1, 1, "https://a.com/2024.xlsx"), (3, 0, "https://v.com/a.pdf")]


def test_page_scan_needs_the_body_to_have_the_indicator(spark):
    link = '<a href="/investor/2025/press-release-q3-earnings.pdf">Report</a>'
    got = searches.page_scan(frame(spark, f"<body>{link}</body>", f"<body>Press Release {link}</body>"), DEFAULTS).collect()
    assert [(r.page_id, r.matched) for r in got] == [(1, "press release")]
    link = '<a href="/investor/2025/quarterly-results-q3-earnings.pdf">Report</a>'
    got = searches.page_scan(frame(spark, f"<body>{link}</body>", f"<body>Quarterly Results {link}</body>", "<body><b>Q3 2025</b></body>"), DEFAULTS).collect()
    assert [(r.page_id, r["pass"], r.matched, r.url) for r in got] == [(1, 1, "quarterly results", "https://h1.com/investor/2025/quarterly-results-q3-earnings.pdf")]


def test_page_scan_finds_dates_beside_addresses(spark):
    page = '<a href="/financial/q3.pdf"><b>Q3 2025 report</b></a>' + '<p onclick="/x/earnings.pdf">July 31, 2025 earnings</p>' * 6
    got = searches.date_hits(frame(spark, page)).orderBy("pre").collect()
    assert [(r.tag, r.address, r.above) for r in got] == [("b", "/financial/q3.pdf", 1)] + [("p", "/x/earnings.pdf", 0)] * 6
    assert searches.date_hits(frame(spark, None, "")).count() == 0


def test_navigation_keeps_a_report_that_first_comes_as_something_else(spark):
    from quarterlens.operators import ranking

    bases = spark.createDataFrame([(1, "https://c.com/ir/")], "company_id long, url string")
    page = f"https://c.com/ir{P.NAVIGATION_PATHS[0]}"
    pages = spark.createDataFrame([(page, "Reports")], "url string, title string")
    url = "https://c.com/earnings/q3-2025.pdf"
    shown = spark.createDataFrame([(page, 0, "Webcast", url), (page, 1, "Q3 2025 earnings report", url)], "page string, ord int, text string, url string")
    found = ranking.navigation_links(bases, pages, shown).withColumn("link_id", F.col("ord"))
    assert [r.text for r in ranking.first_of_each(ranking._hits(found, DEFAULTS, ranking._on_other_pages)).collect()] == ["Q3 2025 earnings report"]
