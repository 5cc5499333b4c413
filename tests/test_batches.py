"""What Python and the driver hold at once is bounded."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lumenweir.operators import batches, matching, retrieval
from lumenweir.sources import tree


def test_slices_are_small_and_whole():
    b = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 20_000] * 1000)], ["i", "t"])
    out = list(batches.slices(iter([b, b.slice(0, 0)])))
    assert [i for s in out for i in s.column(0).to_pylist()] == list(range(1000))
    assert max(s.num_rows for s in out) * 20_000 <= batches.SLICE_BYTES


def test_page_trees_are_given_out_in_parts():
    page = "<h1>a</h1><p>" + "text " * 20_000 + "</p>"
    out = list(tree._page_trees(iter([pd.Series([page] * 25), pd.Series([None, "<h1>b</h1>"]), pd.Series([], dtype=object)])))
    assert sum(map(len, out)) == 27 and max(map(len, out)) <= tree.MOST_CHARS // len(page) + 1
    assert out[-2]["title"].tolist() == [tree.parsed(None)[0], tree.parsed("<h1>b</h1>")[0]]


def test_nearest_over_many_slices(spark):
    x = np.random.default_rng(1).integers(-3, 4, (4000, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").coalesce(1)
    asked = rows.where("id % 8 = 0").withColumnRenamed("id", "query")
    assert 4000 > 3 * (retrieval.CELLS // 500)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    score = np.round(unit[::8] @ unit.T, 9)
    want = {(8 * q, int(i), k) for q in range(500) for k, i in enumerate(np.lexsort((np.arange(4000), -score[q]))[:5], 1)}
    assert {(r.query, r.id, r["rank"]) for r in retrieval.dense_top_k(asked, rows, 5).collect()} == want


def test_forms_of_a_vocabulary_are_not_broadcast(spark):
    words = spark.createDataFrame([("kubernetes",), ("conflunce",)], "word string")
    pairs = matching.close_pairs(words, spark.createDataFrame([("kubernets",), ("confluence",)], "word string"), 0.89)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 2
    assert {(r.word, r.match) for r in pairs.select(F.col("word"), F.col("match")).collect()} == {("kubernetes", "kubernets"), ("conflunce", "confluence")}
