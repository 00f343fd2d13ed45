"""The stages end to end on synthetic records, the report, the stream, and the oracle comparison."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.plans import pipeline, registry, report
from tidemark.sources import readers, samples, sinks
from tidemark.streaming import ingest as stream


def test_all_stages(spark, tmp_path):
    made = samples.synthesize(spark, 400, 3)
    made.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{tmp_path}/sample.csv")
    config = C.Config()
    config.paths = C.Paths(sample_csv=f"{tmp_path}/sample.csv", processed_dir=f"{tmp_path}/p", reports_dir=f"{tmp_path}/r")
    config.report = C.Report(output_md=f"{tmp_path}/r/insight.md", output_html=f"{tmp_path}/r/insight.html", top_n_themes=3)
    config.embed.hashing_dim, config.themes.n_clusters, config.llm.max_records, config.predict.embedding_pca_components = 32, 3, 300, 4
    config.columns.company_column, config.columns.group_columns = "Company", ["State"]
    pipeline.run_ingest(spark, config)
    records = readers.read_parquet(spark, f"{tmp_path}/p/records.parquet")
    assert 0 < records.count() <= 400 and "State" in records.columns
    pipeline.run_embed(spark, config)
    found = pipeline.semantic_search(spark, config, "overdraft fee", 4)
    assert len(found) == 4 and [f["distance"] for f in found] == sorted(f["distance"] for f in found)
    pipeline.run_themes(spark, config)
    pipeline.run_extract(spark, config, dry_run=True)
    assert readers.done_ids(spark, f"{tmp_path}/p/extractions").count() > 0
    config.predict.boosting_iterations, config.predict.backend, config.predict.importance_repeats = 3, "xgboost", 1
    metrics = pipeline.run_predict(spark, config)
    assert metrics["n_train"] > metrics["n_test"] > 0 and 0 <= metrics["base_rate"] <= 1 and {"roc_auc", "pr_auc", "brier", "calibration"} <= set(metrics["boosting"])
    config.paths.gold_csv = f"{tmp_path}/gold.csv"
    pipeline.run_gold(spark, config, 20, auto=True, mapping={"Mortgage": "loan_servicing"})
    gold = readers.read_gold(spark, config.paths.gold_csv)
    assert gold.count() == 20 and gold.where("issue_category is null").count() == 0
    best = pipeline.run_evaluation(spark, config, dry_run=True)
    assert best["variant"] in ("v1", "v2", "v3") and 0 <= best["acc_issue_category"] <= 1
    payload = pipeline.run_stats(spark, config)
    assert payload["design_n"] == 1068 and {f["kind"] for f in payload["findings"]} >= {"sentiment"}
    text = pipeline.run_report(spark, config)
    assert "## Headlines" in text and "<h1>" in open(config.report.output_html).read()
    assert {"evaluation.md", "predictive_model.md", "data_quality.md", "themes.md", "run_summary.md", "statistics.md"} <= set(os.listdir(config.paths.reports_dir))


def test_sample_builder(spark, tmp_path):
    config = C.Config()
    config.paths = C.Paths(raw_csv=f"{tmp_path}/raw.csv", sample_csv=f"{tmp_path}/sample.csv")
    pipeline.run_sample(spark, config, 50)  # no full file: synthetic records
    assert readers.read_csv(spark, config.paths.sample_csv).count() == 50
    rows = [(i, None if i % 5 == 0 else " " if i % 7 == 0 else f"text\n{i}", "a" if i % 2 else "b") for i in range(700)]
    sinks.write_csv(spark.createDataFrame(rows, ["Complaint ID", "Consumer complaint narrative", "Product"]), config.paths.raw_csv)
    pipeline.run_sample(spark, config, 100)
    made = readers.read_csv(spark, config.paths.sample_csv)
    assert abs(made.count() - 100) <= 1 and made.where("trim(`Consumer complaint narrative`) = ''").count() == 0


def test_live_run_without_endpoint_is_an_error(spark, tmp_path):
    config = C.Config()
    config.paths = C.Paths(processed_dir=f"{tmp_path}/p", reports_dir=f"{tmp_path}/r")
    sinks.write_parquet(spark.createDataFrame([(1, "a fee", "x")], "record_id long, text string, category string"), f"{tmp_path}/p/records.parquet")
    with pytest.raises(pipeline.extract.PermanentError):
        pipeline.run_extract(spark, config, dry_run=False, yes=True)
    assert not readers.exists(spark, f"{tmp_path}/p/extractions")


def test_missing_inputs(spark, tmp_path):
    config = C.Config()
    config.paths = C.Paths(sample_csv=f"{tmp_path}/none.csv", processed_dir=f"{tmp_path}/p", reports_dir=f"{tmp_path}/r")
    for stage in (pipeline.run_ingest, pipeline.run_embed, pipeline.run_stats, pipeline.run_report):
        with pytest.raises(FileNotFoundError):
            stage(spark, config)
    assert readers.read_labels(spark, f"{tmp_path}/none").count() == 0


def test_html():
    out = report.to_html("# T\n\n- a **b**\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n![c](c.png)\n", "t")
    assert all(tag in out for tag in ("<h1>T</h1>", "<li>a <strong>b</strong></li>", "<td>1</td>", '<img alt="c" src="c.png">'))


def test_headlines():
    found = [{"kind": "prevalence", "label": "fees", "estimate": 0.3, "ci_low": 0.2, "ci_high": 0.4}, {"kind": "change", "label": "fees", "significant": True, "p_corrected": 0.01, "direction": "emerging"}, {"kind": "sentiment", "label": "sentiment: negative", "estimate": 0.8}]
    lines = "\n".join(report.headlines(found, {"boosting": {"roc_auc": 0.72}}))
    assert "fees" in lines and "📈" in lines and "0.720" in lines and "80.0% of analysed" in lines


def test_stratified_is_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    counts = {r["g"]: r["count"] for r in samples.stratified(df, "g", 0.1).groupBy("g").count().collect()}
    assert counts == {None: 10, "a": 30, "b": 60}


def test_csv_with_quotes_and_lines(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('record_id,text\n1,"two\nlines, ""quoted"""\n2,NA\n', encoding="utf-8")
    rows = readers.read_csv(spark, str(path)).orderBy("record_id").collect()
    assert rows[0]["text"] == 'two\nlines, "quoted"' and rows[1]["text"] is None


def test_stream(spark, tmp_path):
    rows = [(1, "one two three four five", "2021-01-01", "c"), (2, "ONE two three, four five", "2021-01-02", "c"), (3, "short", "2021-01-01", "c"), (4, "another record of five words", "2021-02-01", "c")]
    sinks.write_parquet(spark.createDataFrame(rows, "id long, txt string, day string, product string"), f"{tmp_path}/in")
    columns = C.Columns(text_column="txt", date_column="day", category_column="product", id_column="id", subcategory_column=None, outcome_column=None, timely_column=None)
    records = stream.stream_records(spark, f"{tmp_path}/in", "id long, txt string, day string, product string", columns, C.Ingest(min_tokens=5))
    stream.write_stream(records, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 2 and {r["year_month"] for r in out.collect()} == {"2021-01", "2021-02"}
    counted = stream.windowed_counts(spark.readStream.schema(out.schema).parquet(f"{tmp_path}/out").withColumn("date", F.col("date").cast("timestamp")))
    running = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    assert spark.table("counted").agg(F.sum("count")).first()[0] == 2


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "orders lineitem supplier part events documents embeddings labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def plain(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted((str(tuple(plain(r[c]) for c in names)) for r in df.collect())) == sorted(str(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
