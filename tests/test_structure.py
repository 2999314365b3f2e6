"""Enclosing nodes, sums over subtrees, tables on a grid, repeated items and pages that count."""

import random

import pytest
from pyspark.sql import functions as F

from docwatch.operators import extraction as X
from docwatch.operators import pages as P
from docwatch.operators import structure as S


def nodes(spark, *htmls, url="https://forum.example.com/thread/1"):
    return P.dom_nodes(spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string"))


def random_tree(rng, n):
    """(node_id, parent_id, last_desc, hit, value) of a random tree in order."""
    parent, last = [-1], list(range(n))
    for i in range(1, n):
        at = i - 1
        while at > 0 and rng.random() < 0.4:
            at = parent[at]
        parent.append(at)
    for i in range(n - 1, 0, -1):
        last[parent[i]] = max(last[parent[i]], last[i])
    return [(i, parent[i], last[i], rng.random() < 0.3, rng.randrange(5)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_enclosing_and_sums(spark, seed):
    """Equal to a walk up the parents, and to the join of intervals, over random trees."""
    rng = random.Random(seed)
    rows = [(page, *r) for page in range(4) for r in random_tree(rng, rng.randrange(1, 120))]
    df = spark.createDataFrame(rows, "page_id long, node_id int, parent_id int, last_desc int, hit boolean, value int")
    of = {(r[0], r[1]): r for r in rows}
    got = {(r.page_id, r.node_id): (r.box, r.total) for r in S.subtree_sums(S.enclosing(df, F.col("hit"), "box"), total=F.col("value")).collect()}
    assert len(got) == len(rows)
    for key, r in of.items():
        at = r
        while at is not None and not at[4]:
            at = of.get((key[0], at[2]))
        assert got[key] == (at and at[1], sum(x[5] for x in rows if x[0] == key[0] and r[1] <= x[1] <= r[3]))


def test_large_page(spark):
    """A page of 40,000 nodes with deep and wide containers."""
    n = 40_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("page_id"), F.col("id").cast("int").alias("node_id"), F.when(F.col("id") % 1000 == 0, F.col("id") + 999).when(F.col("id") % 1000 < 500, F.col("id") - F.col("id") % 1000 + 998 - F.col("id") % 1000).otherwise(F.col("id")).cast("int").alias("last_desc"), (F.col("id") % 1000 < 300).alias("hit"))
    r = S.enclosing(df, F.col("hit"), "box").agg(F.count("box"), F.sum("box")).first()
    want = 0
    for k in range(1000):
        box = k if k < 300 else max(j for j in range(300) if (999 if j == 0 else 998 - j if j else 999) >= k)
        want += box
    assert r[0] == n and r[1] == sum(1000 * 1000 * b + want for b in range(n // 1000))


def tables(spark, *htmls, **how):
    """Of each html its tables as (headers, rows, caption, header_rows)."""
    out = [[] for _ in htmls]
    for r in X.page_tables(nodes(spark, *htmls), **how).orderBy("page_id", "table_id").collect():
        out[r.page_id].append((r.headers, r.rows, r.caption, r.header_rows))
    return out


def test_tables(spark):
    full = "<table><caption>Status Report</caption><thead><tr><th>Name</th><th>Status</th></tr></thead><tbody><tr><td>A</td><td>on</td></tr><tr><td>B</td><td>off</td></tr></tbody></table>"
    no_body = "<table><thead><tr><th>Name</th><th>Status</th></tr></thead><tr><td>A</td><td>on</td></tr><tr><td>B</td><td>off</td></tr></table>"
    plain = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"
    layout, short = "<table><tr><td><img src=x></td><td>Site</td></tr></table>", "<table><thead><tr><th>A<th>B</thead><tbody><tr><td>1<td>2</tbody></table>"
    narrow = "<table><thead><tr><th>A</thead><tbody><tr><td>1<tr><td>2</tbody></table>"
    heads = "<table><thead><tr><th>City<th>People<th>Area</thead><tbody><tr><th scope=row>Jakarta<td>10,154,134<td>664<tr><th scope=row>Dhaka<td>10,295,407<td>338</tbody></table>"
    row = "<tr><td>1<td>2"
    residual = "<table><thead><tr><th>a<th>b</thead><tbody><tr><th>x<th>y" + row * 2 + "<tr><th>p<th>q</tbody></table>"
    inner = "<table><tr><th>k<th>v<tr><td>1<td><table><tr><th>m<th>n<tr><td>3<td>4<tr><td>5<td>6</table><tr><td>2<td>z</table>"
    five = "<table><thead>" + "".join(f"<tr><th>a{i}<th>b{i}" for i in range(6)) + "</thead>" + row * 2 + "</table>"
    got = tables(spark, full, no_body + plain, layout, short, narrow, heads, residual, inner, five, "", "<table></table><table><tr></tr></table>")
    assert got[0] == [(["Name", "Status"], [["A", "on"], ["B", "off"]], "Status Report", 1)]
    assert got[1] == [(["Name", "Status"], [["A", "on"], ["B", "off"]], None, 1), (["A", "B"], [["1", "2"], ["3", "4"]], None, 1)]
    assert got[2] == got[3] == got[4] == got[9] == got[10] == []
    assert got[5][0][1] == [["Jakarta", "10,154,134", "664"], ["Dhaka", "10,295,407", "338"]]
    assert got[6][0][1] == [["1", "2"], ["1", "2"], ["p", "q"]]
    assert [t[:2] for t in got[7]] == [(["k", "v"], [["1", ""], ["2", "z"]]), (["m", "n"], [["3", "4"], ["5", "6"]])]
    assert got[8][0][0] == ["a0 / a1 / a2 / a3", "b0 / b1 / b2 / b3"] and len(got[8][0][1]) == 2
    (bounded,) = tables(spark, ("<table><tr><th>a<th>b" + row * 9 + "</table>") * 5, tables=3, rows=4)
    assert [len(t[1]) for t in bounded] == [4, 4, 4]


def test_header_grid(spark):
    """Row and column spans: a label spans its columns, covered places are passed over, labels said twice in a row are said once."""
    html = (
        "<table><tr><th rowspan=3>City<th colspan=4>Size<th rowspan=x>Note<tr><th colspan=2>2020<th colspan=2>2021<th>Note<tr><th>km<th>mi<th>km<th>"
        "<tr><td>a<td>1<td>2<td>3<td>4<td>n<tr><td>b<td>1<td>2<td>3<td>4<tr><td>c<tr><td>d<td>1<td>2<td>3<td>4<td>5<td>6<td>7</table>"
    )
    low = "<table><tr><th colspan=2 rowspan=2>A<th>B<tr><th>C<tr><td>1<td>2<td>3<tr><td>4<td>5<td>6</table>"
    gap = "<table><thead><tr><th rowspan=2><th>B<tr><th>C</thead><tr><td>1<td>2<tr><td>4<td>5</table>"
    ((headers, rows, _, n),), of_low, of_gap = tables(spark, html, low, gap)
    assert headers == ["City", "Size / 2020 / km", "Size / 2020 / mi", "Size / 2021 / km", "Size / 2021", "Note"] and n == 3
    assert rows == [["a", "1", "2", "3", "4", "n"], ["b", "1", "2", "3", "4", ""], ["c"], ["d", "1", "2", "3", "4", "5"]]
    assert of_low[0][0] == ["A", "A", "B / C"] and of_gap[0][0] == ["col_1", "B / C"]


def follow(spark, cases):
    """Each case: ((html[, url]), what is found: method, next_url, page_size, current_offset, or None)."""
    rows = [(i, *c, *["https://forum.example.com/thread/1"][len(c) - 1 :]) for i, (c, _) in enumerate(cases)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string")
    got = {r.page_id: tuple(r)[1:] for r in X.pagination(P.dom_nodes(pages)).collect()}
    for i, (c, want) in enumerate(cases):
        assert got.get(i) == want, c


def test_next_pages(spark):
    base = "https://forum.example.com"
    follow(spark, [
        (('<link rel="next" href="/thread/1?page=2"><a href="/x">Older Posts</a>',), ("rel_next", f"{base}/thread/1?page=2", None, None)),
        (('<a href="/thread/1?page=2">Older Posts</a>',), ("link_text", f"{base}/thread/1?page=2", None, None)),
        (('<a href="/articles/5">Read more</a>',), None),
        (("<p>none</p>",), None),
    ])
    pages = "".join(f'<a href="/thread/1?page={i}">{i}</a>' for i in (3, 1, 2))
    follow(spark, [
        ((pages,), ("numbered", f"{base}/thread/1?page=2", None, None)),
        (('<a href="/p?page=2">2</a><a href="/p?page=3">3</a>',), None),
    ])


def test_offsets(spark):
    base = "https://forum.example.com/list"
    link = lambda *vs, p="offset": "".join(f'<a href="/list?{p}={v}&s=1">x</a>' for v in vs)
    follow(spark, [
        (("<p>x</p>", f"{base}?q=a&offset=25#top",), ("offset", f"{base}?q=a&offset=50#top", 25, 25)),
        (("<p>x</p>", f"{base}?offset=0",), None),
        ((link(0, 20, 40), f"{base}?offset=20",), ("offset", f"{base}?offset=40", 20, 20)),
        ((link(0, 20, 40), f"{base}?offset=40",), ("offset", f"{base}?offset=60", 20, 40)),
        ((link(0, 20, 50), f"{base}?offset=50",), ("offset", f"{base}?offset=100", 50, 50)),
        (("<p>x</p>", f"{base}?offset=9000",), None),
        ((link(60, 20, 40, p="start"),), ("start", f"{base}?start=40&s=1", 20, 20)),
        ((link(20, 30, 50, p="start"),), None),
        ((link(20, p="skip"),), None),
        (('<a href="?skip=30">next</a>', f"{base}?skip=10",), ("offset", f"{base}?skip=30", 20, 10)),
        ((link(25, 50) + "".join(f'<a href="/list?page={i}">{i}</a>' for i in (1, 2, 3)),), ("numbered", f"{base}?page=2", None, None)),
        ((link(25, 50) + "".join(f'<a href="/list?offset={i}">{i}</a>' for i in (25, 50, 75)),), ("offset", f"{base}?offset=50&s=1", 25, 25)),
    ])

def test_items(spark):
    item = lambda k, c="b a": f'<li class="{c}"><h3>H{k}</h3><a href="/i/{k}">T{k}</a><span class="price">{k}</span></li>'
    menu = '<ul class="main-menu">' + "".join(f"<li><a href=/m{k}>m</a></li>" for k in range(20)) + "</ul>"
    html = menu + "<ol>" + "".join(item(k, "b a" if k % 2 else "a b") for k in range(7)) + '<li class="a b">no link</li><li>other</li></ol>'
    n = nodes(spark, html, "<p>nothing</p>", "<div>" + "".join(f'<a class="x" href="/{k}">t{k}</a>' for k in range(6)) + "</div>")
    g = P.repeated_items(n)
    assert [(r.page_id, r.tag, r.signature, r["items"], r.truncated) for r in g.orderBy("page_id").collect()] == [(0, "li", "a.b", 7, False), (2, "a", "x", 6, False)]
    f = P.item_fields(n, g, most=5).orderBy("page_id", "n").collect()
    assert [(r.n, r.title, r.url, r.price) for r in f if r.page_id == 0] == [(k + 1, f"T{k}", f"https://forum.example.com/i/{k}", str(k)) for k in range(5)]
    assert [r.title for r in f if r.page_id == 2] == [f"t{k}" for k in range(5)] and f[0].description == "H0 T0 0"


def test_schema_blocks(spark):
    """Graphs in lists, types with their vocabulary, texts that strict JSON refuses, more than 1000 blocks, and items of microdata."""
    ld = lambda text, kind="application/ld+json": f'<script type="{kind}">{text}</script>'
    many = ld('{"@graph": [' + ", ".join(f'{{"@type": "T{k % 2}", "n": {k}}}' for k in range(2500)) + "]}") + ld('{"@type": "Last"}')
    pages = [
        ld('[{"@graph": [{"@type": "https://schema.org/MusicEvent"}, {"@type": ["NGO", "Person"]}]}, {"@type": "Person"}, {"@type": "WebPage", "@graph": {"@type": "http://schema.org/FAQPage"}}]', "application/LD+JSON; charset=utf-8"),
        ld('/* a "note" */ {"@type": "Event", "name": "no // comment, ]", /* b */ "x": [1, 2, ], "y": NaN, }') + ld('//<![CDATA[ {"@type": "Person", "name": "]]>"} //]]>') + ld('<!-- {"@type": "JobPosting"} -->') + ld('<!-- note --> {"@type": "Product"}'),
        ld('{"@type": "A", "@type": "B", "name": "x\x01y"}') + ld("{not valid json") + ld('{"name": "no type"}') + ld("null") + ld("") + ld('"Event"'),
        many,
        '<div itemscope itemtype="https://schema.org/Event"><p itemprop="location" itemscope itemtype="https://schema.org/Place">x</p></div><b itemscope>y</b><i itemscope itemtype=" http://schema.org/Person  http://schema.org/x">z</i>' + ld('{"@type": "Event"}'),
        "<p>none</p><script>var x</script>",
    ]
    n = nodes(spark, *pages)
    blocks = [[] for _ in pages]
    for r in X.json_ld(n).select("page_id", "ord", "schema_type", F.try_variant_get("block", "$.name", "string").alias("name"), F.try_variant_get("block", "$.n", "int").alias("n")).orderBy("page_id", "ord").collect():
        blocks[r.page_id].append((r.schema_type, r.name, r.n))
    types = lambda i: [b[0] for b in blocks[i] if b[0]]
    assert types(0) == ["MusicEvent", "NGO", "Person", "WebPage", "FAQPage"]
    assert [b[:2] for b in blocks[1]] == [("Event", "no // comment, ]"), ("Person", "]]>"), ("JobPosting", None), ("Product", None)]
    assert blocks[2][0][:2] == ("B", "x\x01y") and types(2) == ["B"]
    assert blocks[3] == [(f"T{k % 2}", None, k) for k in range(2500)] + [("Last", None, None)]
    assert types(4) == ["Event"] and blocks[5] == []
    seen = [[] for _ in pages]
    for r in X.schema_types(n).select("page_id", X.entity_type(F.col("schema_type")).alias("t")).collect():
        seen[r.page_id].append(r.t)
    assert sorted(seen[0]) == ["Event", "FAQPage", "Organization", "Person", "WebPage"] and sorted(seen[1]) == ["Event", "JobPosting", "Person", "Product"]
    assert seen[2] == ["B"] and len(seen[3]) == 2501 and sorted(seen[4]) == ["Event", "Event", "Person"] and seen[5] == []
