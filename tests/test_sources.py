"""Feeds, sitemaps and dumps written to a folder and read again."""

from pyspark.sql import functions as F

from docwatch.sources import files as A

ENTRY = """<entry><author><name>/u/{a}</name></author><category term="{s}"/><content type="html">{c}</content><id>{i}</id>{l}<title>{t}</title><updated>2024-01-0{d}T00:00:00+00:00</updated></entry>"""


def test_atom(spark, tmp_path):
    body = ENTRY.format(a="x", s="src", c="&lt;p&gt;hi&lt;/p&gt;", i="t3_abc", l='<link href="https://example.org/r/src/comments/zz9/t/"/>', t="One", d=1) + ENTRY.format(a="y", s="src", c="", i="t3_q1", l="", t="Two", d=2)
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom">{body}</feed>')
    rows = {r.title: r for r in A.read_posts(spark, str(tmp_path)).collect()}
    assert rows["One"].id == "zz9" and rows["One"].author == "x" and rows["One"].content == "<p>hi</p>"
    assert rows["Two"].id == "q1" and rows["Two"].published_at.day == 2


def test_sitemaps(spark, tmp_path):
    url = lambda n: "".join(f"<url><loc>https://e.org/{k}</loc><lastmod>2024-02-03</lastmod></url>" for k in range(n))
    (tmp_path / "index.xml").write_text("<sitemapindex><sitemap><loc>https://e.org/a.xml</loc></sitemap><sitemap><loc>https://e.org/b.xml</loc></sitemap></sitemapindex>")
    (tmp_path / "a.xml").write_text(f"<urlset>{url(4)}</urlset>")
    (tmp_path / "b.xml").write_text(f"<urlset>{url(6)}</urlset>")
    roots = spark.createDataFrame([("https://e.org/index.xml",)], "loc string")
    got = A.read_sitemaps(spark, str(tmp_path), roots, most=5).collect()
    assert sorted(r.loc[-1] for r in got) == list("01234") and all(r.truncated and r.lastmod.day == 3 for r in got)


def test_dump_reads_only_what_it_needs(spark, tmp_path):
    spark.range(20).select(F.when(F.col("id") % 2 == 0, "document").otherwise("story").alias("record_kind"), "id", F.lit("x").alias("wide")).write.parquet(f"{tmp_path}/d")
    df = A.read_kind(spark, f"{tmp_path}/d", "document", ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10 and "EqualTo(record_kind,document)" in plan and "wide" not in plan


def test_raw_evidence(spark, tmp_path):
    A.write_raw_evidence(spark.createDataFrame([(1, 2, "a")], "source_id long, message_id long, text string"), f"{tmp_path}/e")
    assert spark.read.json(f"{tmp_path}/e").where("source_id = 1").first().text == "a"
