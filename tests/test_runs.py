"""Names, batches and splits."""

from pyspark.sql import functions as F

from quern.operators import runs


def test_names(spark):
    names = spark.createDataFrame([("20260526140632_epoch_7_loss_0.25.pt",), ("model_3.pt",), ("x",)], "name string")
    out = [tuple(r["x"]) for r in names.select(runs.checkpoint_fields(F.col("name")).alias("x")).collect()]
    assert out == [("20260526140632", 7, 0.25), (None, 3, None), (None, None, None)]
    assert runs.latest_run(names, "name").first()["run"] == "20260526140632"


def test_batches_split_union(spark):
    rows = spark.createDataFrame([("g", k, None if k % 3 else "bad") for k in range(10)], "g string, k long, rule string")
    assert [r["batch"] for r in runs.batches(rows, "g", "k", 4, skip=1).orderBy("k").collect()] == [0, 0, 0, 0, 1, 1, 1, 1, 2]
    kept, gone = runs.split(rows, "rule")
    assert kept.count() + gone.count() == 10 and gone.count() == 4
    assert runs.union([kept, gone.drop("rule")]).count() == 10
    assert runs.pending(rows.select("k"), gone, "k").count() == 6
