import html
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import html_text


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain <b>x", "plain x"),
    ("<html><head><title>t</title></head><body><nav>n</nav><article><h1>H</h1><p>a&amp;b  <i>c</i>\n d<p>e</article><footer>f</footer>", "H\na&b c d\ne"),
    ("<p>a<script>if (x < 1) '</p>'</script>b</p><style>p{}</style><form><input>q</form>", "ab"),
    ("<main><p>x</p><div class='comments'><p>no</p></div><div id=ad-1>no</div><p>y</main><p>outside", "x\ny"),
    ("<div class=load><p>kept</div><aside>no</aside><div role=navigation>no</div>", "kept"),
    ("<div class='page no-sidebar'><article><p>in</article></div>", "in"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("a < b <!-- no --> & c &copy; &#233;&nbsp;<br>d", "a < b & c © é d"),
    ("<p>unclosed <b>bold<p>next</p>", "unclosed bold\nnext"), ("<div>" * 5000 + "deep", "deep"), ("<a href='x>y", "<a href='x>y"),
    ("<article><p>a <a class='related'>b</a> c</p><span class=ad>no</span></article>", "a b c"),
    ("<div class='page no-sidebar'><h1>T</h1><p>Body text</p></div>", "T\nBody text"), ("<div class='has-menu with-ads'><p>Body</div><div class=menu>no</div>", "Body"),
    ("<form><h1>T</h1><p>Body text</p><input></form><form>q <input></form>", "T\nBody text"), ("<form id=aspnet><div class=menu>m</div><article><p>in</p></article><p>out</p></form>", "in"),
    ("<div class=sidebar-layout><div class=sidebar>links</div><h1>T</h1><p>the text of the page</p></div>", "T\nthe text of the page"),
    ("<p>short</p><div class=comments><p>a much longer comment of a reader</p></div>", "short"), ("<div class=menu><a href=/>one</a> <a href=/>two</a></div><p>x</p>", "x"),
    ("<article><header class=header><h1>T</h1></header><p>x</p><footer>by</footer></article>", "T\nx"),
])
def test_text_of(page, text):
    assert html_text.text_of("h", page or "") == text


def site(spark):
    rows = [(i, f"http://a.org/{i}", f"<body><div><b>Site</b> head</div><p>Text {i} of its own</p><p>same line</p><section><p>subscribe now</p></section></body>", "x") for i in range(12)]
    rows += [(100 + i, f"http://b{i}.org/", "<body><div><b>Site</b> head</div><p>alone</p></body>", "x") for i in range(12)]
    return spark.createDataFrame([*rows, (200, None, None, "x"), (201, "bad", "<p>q", "x"), (201, "bad", "<p>q", "x")], "page_id long, url string, html string, text string")


def test_templates_go_per_host(spark):
    got = [tuple(r) for r in html_text.extract(site(spark)).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == 27
    assert by[3][2:] == ("Text 3 of its own\nsame line", len("Text 3 of its own\nsame line"))
    assert by[103][2] == "Site head\nalone"  # one page a host: no template
    assert by[200][1:] == (None, "", 0) and by[201][2] == "q"


def plain_site(seed=4):
    """A host whose pages have neither article tags nor class names, and what their articles say."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    menus = [f"<div><a href=/{i}>{line(2)}</a> <a href=/x>{line(1)}</a></div>" for i in range(3)]
    notice, foot = f"<section><p>{line(30)}</p></section>", f"<div><ul><li>{line(3)}<li>{line(2)}</ul> © {line(4)}</div>"
    rows, want = [], {}
    for i in range(60):
        parts = [line(rng.randint(5, 60)) for _ in range(rng.randint(1, 5))]
        rows.append((i, f"https://news.example/{i}", f"<html><body>{rng.choice(menus)}{notice}<div><h1>{parts[0]}</h1>{''.join(f'<p>{p}</p>' for p in parts[1:])}</div>{foot}</body></html>"))
        want[i] = "\n".join(parts)
    return rows, want


@pytest.mark.parametrize("marks", [True, False])
def test_recurrence_alone_decides(spark, marks):
    rows, want = plain_site()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(pages, marks=marks).collect()} == want
    kept = {r.page_id: r.text for r in html_text.extract(pages, marks=marks, least_pages=61).collect()}
    assert all(kept[i] != want[i] for i in want)  # without the method nothing else removes them


def test_repeated_articles_stay_whole(spark):
    rows, want = plain_site()
    body = "<div><h2>Same</h2><p>one story that many pages tell, longer than what stands around it</p><table><tr><td>a<td>b</table><section><p>its end</p></section></div>"
    story = "Same\none story that many pages tell, longer than what stands around it\na\nb\nits end"
    menu, foot = re.match(r".*?</section>", rows[0][2])[0], re.search(r"</div>(<div><ul>.*)", rows[0][2])[1]
    rows += [(100 + i, f"https://news.example/copy?{i}", f"{menu}{body}{foot}") for i in range(40)]
    rows += [(200 + i, f"https://other.example/{i}", f"<article><div><p>told {i % 2}</p><ul><li>yes<li>no</ul></div><p>end {i}</p></article>") for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[100 + i] == story for i in range(40)) and all(got[i] == want[i] for i in want)
    assert all(got[200 + i] == f"told {i % 2}\nyes\nno\nend {i}" for i in range(20))


def test_counts_match_brute_force(spark):
    rows, _ = plain_site(7)
    rows = rows[:25] + [(70 + i, f"http://x{i % 3}.example/{i}", h) for i, (_, _, h) in enumerate(rows[25:40])] + rows[:3]
    contexts = defaultdict(set)
    for _, u, h in rows:
        host = u.split("/")[2]
        top = html_text.parse(h)
        texts: list = []

        def gather(e, path):
            for c in e.children:
                if isinstance(c, str):
                    if c.strip():
                        texts.append((" ".join(c.split()), path))
                else:
                    gather(c, [*path, id(c)])

        def shape(e):
            return (e.tag, tuple(" ".join(c.split()) if isinstance(c, str) else shape(c) for c in e.children))

        def frames(e):
            for c in e.children:
                if not isinstance(c, str):
                    if c.tag in html_text._FRAME:
                        outside = [t for t, p in texts if id(c) not in p]
                        contexts[(host, shape(c))].add(tuple(sorted(outside, key=lambda t: -len(t.encode()))[:2]))
                    frames(c)

        gather(top, [])
        frames(top)
    want = sum(len(c) >= 5 for c in contexts.values())
    found = {(u, h): html_text.subtrees(html_text.host_of(u), h) for _, u, h in rows}
    df = spark.createDataFrame([(hash(u.split("/")[2]), hash(h), *r) for (u, h), rs in found.items() for r in rs], "host long, key long, hash long, context long")
    assert want > 2 and html_text.templates(df).count() == want


def test_many_copies_long_pages_and_other_columns(spark):
    long = "<div><p>" + "word " * 100_000 + "</p></div>"
    rows = [(i, "http://c.example/", "<div>menu</div><p>copy</p>", 1) for i in range(300)] + [(999, "http://c.example/long", long, 2), (None, "http://c.example/", html.escape("<p>"), 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key int").withColumn("salt", F.lit("x"))
    got = html_text.extract(df).collect()
    assert len(got) == 302 and {r.text for r in got if r.page_id and r.page_id < 300} == {"menu\ncopy"}
    assert [r.n_chars for r in got if r.page_id == 999] == [499_999] and [r.text for r in got if r.page_id is None] == ["<p>"]


def test_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
