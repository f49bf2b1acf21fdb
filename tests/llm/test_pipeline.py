"""The pipeline on a planted table: what goes, what stays, and the token files."""

import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_planted_cases(spark, tmp_path):
    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(150)) + "."
    rows = {k: text() for k in range(200)}
    toxic = [k for k in range(0, 200, 5)]
    for k in toxic:
        rows[k] += f" you {rng.choice(['slur', 'insult'])}er"
    item = text()
    rows[301] = f"{text()} {item}"
    rows[302], rows[303] = rows[1], rows[2].replace(rows[2].split()[70], "swapped", 1)
    table = [(k, t, rng.choice(["en", "de", "fr", "es"]), "s", len(t)) for k, t in rows.items()]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(range(200)) - set(toxic)
    rows = sorted(out, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]


def test_stages_send_small_batches(spark):
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for _, stage in corpus_pipeline.STAGES[:-1]:
            spark.conf.set(name, "10000")
            stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
            assert max(r["n"] for r in spark.range(0, 5000, 1, 1).mapInArrow(rows, "n long").collect()) == 1000
        spark.conf.set(name, "10")
        corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
        assert spark.conf.get(name) == "10"
    finally:
        spark.conf.set(name, before)
