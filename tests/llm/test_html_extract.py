import random
from collections import defaultdict

from rulespark.llm import html_extract as he

PAGES = "page_id long, url string, html string, text string, host int"


def test_article_without_its_surroundings():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a>Home</a></ul></nav><!-- ad --><div class="ad">Buy</div>
    <div id="cookieNotice">Cookies!</div><article><header><h1>One &amp; two</h1></header><p><b>Text&nbsp;of
    <i>i</i>talics.<br><p>Second &lt;p&gt; &#233;<div class="share-buttons">Share</div><form>Mail <input></form>
    <section class="comments"><p>First!</p></section></article><aside>Side</aside><footer>&copy; x</footer>"""
    assert he.main_text(html, set()) == "One & two Text of italics. Second <p> é"


def test_broken_pages():
    assert he.main_text(None, set()) == he.main_text("", set()) == ""
    assert he.main_text("plain &amp text", set()) == "plain & text"
    assert he.main_text("<p>a<p>b</div></span>c<", set()) == "a bc<"
    assert he.main_text("<article><p>a<!-- never closed", set()) == "a"
    assert he.main_text("<script>never closed <p>x</p>", set()) == ""
    assert he.main_text("<nav><ul><li>menu<article><p>kept</p></article>", set()) == "kept"
    assert he.main_text('<p title="a>b">x</p><p title=\'>\'>y</p>', set()) == "x y"
    assert he.main_text("a<b>b</b>c<div>d</div>e", set()) == "abc d e"
    assert he.main_text("<article></article><p>outside</p>", set()) == "outside"
    assert he.main_text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", set()) == "a b c d"


def test_long_broken_markup_is_linear():
    for html in ["<" * 300_000, "<p " * 100_000, "<a b='" * 50_000, "<!--" * 100_000, "<p>" * 100_000 + "x", "&" * 300_000, "</p>" * 100_000]:
        he.main_text(html, set())


def page(body):
    return f"<html><body>{body}</body></html>"


def site(n=40):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows, want = [], []
    for i in range(n):
        text = " ".join(word() for _ in range(30))
        host = "a.example" if i % 4 else f"b{i}.example"
        top = "<div><ul><li>Start</li><li>Shop</li></ul></div>"
        rows.append((i, f"http://{host}/{i}", page(f"{top}<div><p>{text}</p></div><div><p>All rights reserved</p></div>"), "t", 1))
        want.append(text if i % 4 else f"Start Shop {text} All rights reserved")
    return rows, want


def test_template_of_a_host_is_removed(spark):
    rows, want = site()
    got = sorted(he.extract(spark.createDataFrame(rows, PAGES)).collect())
    assert [r.text for r in got] == want and [r.n_chars for r in got] == [len(w) for w in want]


def test_copies_of_a_page_are_not_a_template(spark):
    body = page("<div><p>The same article, posted again.</p></div>")
    rows = [(i, f"http://a.example/{i}", body, "t", 1) for i in range(50)]
    assert {r.text for r in he.extract(spark.createDataFrame(rows, PAGES)).collect()} == {"The same article, posted again."}


def test_recurring_paragraphs_of_articles_stay(spark):
    rows = [(i, f"http://a.example/{i}", page(f"<article><p>A shared passage.</p><div>Tools</div><p>Own {i}</p></article>"), "t", 1) for i in range(30)]
    got = sorted(he.extract(spark.createDataFrame(rows, PAGES)).collect())
    assert [r.text for r in got] == [f"A shared passage. Own {i}" for i in range(30)]


def test_odd_rows(spark):
    rows, _ = site(12)
    odd = [(None, None, None, None, None), (5, "not a url", "<p>x</p>", "t", 1), (5, "not a url", "<p>x</p>", "t", 1), (6, "http://é.x", None, "t", 1)]
    df = spark.createDataFrame(rows + odd, PAGES)
    got = he.extract(df).collect()
    assert len(got) == 16 and sum(r.text == "x" for r in got) == 2
    assert sum(r.text == "" and r.n_chars == 0 for r in got) == 2
    assert he.extract(df.limit(0)).collect() == []


def test_template_of_a_part_of_a_large_host_is_removed(spark):
    """A section's notice on 2 % of the pages, in and outside articles; text on fewer pages stays."""
    rows = []
    for i in range(5000):
        notice = "<div>Section notice</div>" if i % 50 == 0 else "<div>Shared by few</div>" if i < 20 else ""
        text = f"<p>Own {i}</p>"
        rows.append((i, f"http://a.example/{i}", page(f"<article>{text}{notice}</article>" if i % 100 else f"{notice}<div>{text}</div>"), "t", 1))
    got = {r.page_id: r.text for r in he.extract(spark.createDataFrame(rows + rows[:3], PAGES)).collect()}
    assert got == {i: f"Own {i}" + " Shared by few" * (0 < i < 20) for i in range(5000)}


def test_words_that_only_contain_a_mark_are_article_text():
    html = '<article><p>a</p><p class="menu-history">the menu</p><section id="related-work"><p>b</p></section><div class="share-buttons">s</div><p>c</p></article>'
    assert he.main_text(html, set()) == "a the menu b c"


def varied(n=12):
    """Pages whose surroundings have the same shape and names, never the same text; the last has no article element."""
    rows, want = [], []
    for i in range(n):
        nav = "".join(f'<li><a href="/{i}{k}">link{i}{k}</a></li>' for k in range(1 + i % 3))
        around = f'<nav><ul>{nav}</ul></nav><div class="zz q{i}">offer {i}</div>'
        body = f"<article><p>Own {i}</p><div class='zz q{i}'>again {i}</div></article>" if i < n - 1 else f"<div><p>Own {i}</p></div>"
        rows.append((i, f"http://a.example/{i}", page(f"{around}{body}<div>Loose {i}</div>"), "t", 1))
        want.append(f"Own {i}" + f" Loose {i}" * (i == n - 1))
    return rows, want


def test_shapes_recur_where_texts_change(spark):
    rows, want = varied()
    got = sorted(he.extract(spark.createDataFrame(rows, PAGES)).collect())
    assert [r.text for r in got] == want
    assert all(r.template_chars for r in got) and got[-1].fallback_chars == 0


def test_templates_match_counting_by_hand(spark):
    rows = site()[0] + [(100 + i, u.replace("a.", "c."), h, t, 1) for i, u, h, t, _ in varied()[0]] + site(7)[0]
    pages = spark.createDataFrame([(u.split("/")[2], f"{u} {i}".encode(), h) for i, u, h, *_ in rows], "host string, page binary, html string")
    got = {bytes(r.page): set(r.template) for r in he.templates(pages).collect()}
    seen = defaultdict(dict)
    for host, _, html in pages.collect():
        outside, inside, _, whole = he.subtrees(html)
        seen[host][whole] = [(False, x) for x in outside] + [(True, x) for x in inside]
    want = {}
    for host, at, html in pages.collect():
        n, count = len(seen[host]), defaultdict(int)
        for own in seen[host].values():
            for x in own:
                count[x] += 1
        known = {x for (inner, x), m in count.items() if n >= 5 <= m and m >= min((0.5 if inner else 0.1) * n, 50)}
        outside, inside, others, _ = he.subtrees(html)
        if own := known & {*outside, *inside, *others}:
            want[bytes(at)] = own
    assert got == want and len(want) > 30


def test_pages_meet_their_templates_without_a_sort(spark):
    rows = [(i, f"http://a.example/{i}", page(f"<nav>menu</nav><article><p>text {i}</p></article>"), "", 0) for i in range(12)]
    found = he.extract(spark.createDataFrame(rows, PAGES))
    assert sorted((r.page_id, r.text, r.template_chars) for r in found.collect()) == [(i, f"text {i}", 4) for i in range(12)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan, plan
