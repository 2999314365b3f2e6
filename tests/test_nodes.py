"""Nodes of pages: what a task holds of them."""

import pyarrow as pa

from docwatch.operators import pages as P
from docwatch.plans.catalog import QUERIES


class _Pages:
    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        return f


def test_nodes_leave_a_task_in_small_batches():
    """However many pages a batch has, and however long their texts are."""
    run = P.dom_nodes(_Pages())
    html = ["<ul>" + "<li><a href=x>y</a>" * 20 + "</ul>"] * 1000 + [None, "<p>" + "z" * 3_000_000, "<b>t</b>"]
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(len(html))), "url": ["https://a.example.org/"] * len(html), "html": html})
    out = list(run(iter([pages, pages.slice(0, 0), pages.slice(1000)])))
    assert max(b.num_rows for b in out) <= 4096 and sum(b.num_rows for b in out) == 41_000 + 2 + 2
    ids = [i for b in out for i in b.column("page_id").to_pylist()]
    assert ids == [p for p in range(1000) for _ in range(41)] + [1001, 1002] * 2


def test_kept_nodes_are_dealt_out_once(spark, sf):
    """Texts of nodes meet the elements they are in without being moved again, joins being shuffled ones."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["assembled_documents"](spark, sf)
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.catalog.clearCache()
    assert "REPARTITION_BY_COL" in plan and "hashpartitioning(t_page" not in plan
