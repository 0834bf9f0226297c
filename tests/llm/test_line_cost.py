"""What line dedup need not do: follow links again, or send documents around that have nothing to meet."""

import numpy as np
from pyspark.sql import functions as F
from test_topk_near import _components

from linkfold.llm import linkage
from linkfold.llm.common import marked_only, written


def test_marked_rows_hold_all_that_are_wanted(spark):
    rows = spark.createDataFrame([(k if k % 50 else None, f"text {k % 997}") for k in range(1, 4001)] + [(7, "text 7")] * 3, "id long, text string")
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    wanted = spark.createDataFrame([(k, f"text {k % 997}") for k in range(3, 4000, 101)] + [(None, "text 50")], "i long, t string").select("i", F.xxhash64("t").alias("h"))
    for some, least in ((wanted, 42), (wanted.limit(0), 0)):
        near, rest = (marked_only(keyed, ["id", "hash"], some, ["i", "h"], how) for how in ("left_semi", "left_anti"))
        exact = keyed.join(some, (F.col("id") == F.col("i")) & (F.col("hash") == F.col("h")), "left_semi")
        assert near.columns == keyed.columns and exact.exceptAll(near).count() == 0
        assert near.unionAll(rest).exceptAll(keyed).count() == 0 and near.count() + rest.count() == 4003
        assert exact.count() <= near.count() <= least + 8


def test_links_between_merged_nodes_are_not_followed_again(spark, monkeypatch):
    """Each later round looks at the links between components only; every group is still one."""
    seen, whole = [], linkage.components
    monkeypatch.setattr(linkage, "components", lambda links: seen.append(links.count()) or whole(links))

    class Close:
        def __init__(self, texts):
            self.values = [int(t.as_py()) for t in texts]

        def links(self, x, others):
            return np.array([abs(self.values[x] - self.values[y]) <= 3 for y in others], bool)

    nodes = [n for n in range(400) if n % 40 < 30]
    buckets = spark.createDataFrame([(k, n, 0) for n in nodes for k in (n // 8, 1000 + (n + 4) // 8, 2000 + n // 40)], "key long, node long, info int")
    texts = spark.createDataFrame([(n, str(n)) for n in nodes], "node long, text string")
    found = linkage.linked_components(written(buckets), written(texts), lambda a, b: F.lit(True), Close)
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == _components(nodes, [(a, b) for a in nodes for b in nodes if a < b <= a + 3])
    assert len(seen) > 1 and all(n < seen[0] for n in seen[1:])
