"""The seven stages and their command line: python -m tidemark.plans.pipeline run --config C --dry-run."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config, load_config, load_dotenv
from tidemark.functions import statistics as S
from tidemark.operators import embed, extract, findings, ingest, predict, themes
from tidemark.plans import report
from tidemark.sources import readers, samples, sinks


def session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _at(config: Config, name: str) -> str:
    return f"{config.paths.processed_dir}/{name}"


def run_ingest(spark: SparkSession, config: Config, full: bool = False) -> None:
    # Written first: the order of arrival is then the same each time, and no file is parsed twice.
    sinks.write_parquet(ingest.standardize(readers.read_source(spark, config, full), config.columns, config.ingest.strip_company), _at(config, "standardized.parquet"))
    raw = readers.read_parquet(spark, _at(config, "standardized.parquet"))
    clean = ingest.clean_records(raw, config.ingest)
    sinks.write_parquet(clean.drop("_ord"), _at(config, "records.parquet"))
    records = readers.read_parquet(spark, _at(config, "records.parquet"))
    funnel = ingest.quality_funnel(raw, config.ingest, ingest.D.parse_date(F.col("_raw_date").cast("string")).isNotNull())
    text = report.quality_report(funnel, ingest.null_rates(records, records.columns), ingest.distribution(records, "category"), ingest.coverage(records), config.paths.raw_csv if full else config.paths.sample_csv)
    sinks.write_text(f"{config.paths.reports_dir}/data_quality.md", text)


def _embedded(spark: SparkSession, config: Config) -> DataFrame:
    records = readers.read_parquet(spark, _at(config, "records.parquet"))
    cache = _at(config, "embedding_cache") if config.embed.cache else None
    return embed.embed_records(spark, records, embed.get_embedder(config.embed), cache, "text_clean")


def run_embed(spark: SparkSession, config: Config) -> None:
    embed.write_index(_embedded(spark, config), _at(config, "index.parquet"))


def semantic_search(spark: SparkSession, config: Config, query: str, k: int = 5) -> list[dict]:
    """The k records nearest to a text; ids as strings, nearest first."""
    vector = embed.get_embedder(config.embed).encode([query])[0]
    found = embed.nearest(readers.read_parquet(spark, _at(config, "index.parquet")), vector, k)
    return [r.asDict() | {"record_id": str(r["record_id"])} for r in found.orderBy("distance", "record_id").collect()]


def cluster(df: DataFrame, config: Config) -> DataFrame:
    """(record_id, theme_id, probability) by the configured algorithm."""
    t = config.themes
    if t.algorithm in ("bertopic", "density"):
        return themes.density(df, t.min_cluster_size, t.min_samples, "record_id", components=t.n_components)
    if t.algorithm != "kmeans":
        raise ValueError(f"unknown clustering {t.algorithm!r}")
    return themes.outliers(themes.kmeans(df, t.n_clusters, config.seed), t.outlier_quantile).select("record_id", "theme_id", F.col("probability").cast("float").alias("probability"))


def run_themes(spark: SparkSession, config: Config) -> None:
    data = _embedded(spark, config)
    sinks.write_parquet(cluster(data, config), _at(config, "theme_assignments.parquet"))
    assigned = readers.read_parquet(spark, _at(config, "theme_assignments.parquet"))
    joined = data.join(assigned, "record_id")
    words = themes.ctfidf(joined, F.col("theme_id"), F.col("text_clean"), config.themes.top_n_keywords)
    near = themes.representatives(joined, config.themes.n_representative_docs, "record_id").join(data.select("record_id", "text"), "record_id")
    examples = near.groupBy("theme_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("examples"))
    summary = themes.summary(assigned, words, examples)
    sinks.write_parquet(summary, _at(config, "theme_summary.parquet"))
    sinks.write_parquet(themes.prevalence(joined), _at(config, "theme_prevalence.parquet"))
    sinks.write_text(f"{config.paths.reports_dir}/themes.md", report.themes_report(readers.read_parquet(spark, _at(config, "theme_summary.parquet")).orderBy(F.desc("n_docs"), "theme_id")))


def run_extract(spark: SparkSession, config: Config, dry_run: bool = False, yes: bool = False, url: str = "", ask=input) -> float:
    records = readers.read_parquet(spark, _at(config, "records.parquet"))
    settings, log = config.llm, _at(config, "extractions")
    client, prompts = extract.get_client(settings, dry_run, url), extract.load_prompts(config.paths.prompts_dir)
    sample = extract.sample_records(records, settings.max_records, config.seed)
    todo = extract.remaining(sample, extract.read_checkpoint(spark, log))
    filled = todo.withColumn("prompt", extract.T.fill_prompt(prompts[settings.prompt_version], settings.controlled_vocab, F.col("text")))
    n = todo.count()
    estimate = extract.estimate_cost(filled, n, settings, order_col=extract.sample_order(F.col("record_id"), config.seed)).first()["estimate_usd"]
    if not (dry_run or yes) and ask(f"{n} records, about ${estimate:.2f}. Go on? [y/N] ").strip().lower() not in ("y", "yes"):
        return 0.0
    spent = extract.run_batch(spark, todo, client, settings, log, prompts=prompts)
    sinks.write_text(f"{config.paths.reports_dir}/run_summary.md", report.run_report(extract.run_summary(extract.read_checkpoint(spark, log)), dry_run))
    return spent


def run_evaluation(spark: SparkSession, config: Config, dry_run: bool = True, gold_path: str | None = None, url: str = "") -> dict:
    gold = readers.read_gold(spark, gold_path or config.paths.gold_csv)
    client, prompts = extract.get_client(config.llm, dry_run, url), extract.load_prompts(config.paths.prompts_dir)
    rows = None
    for variant in sorted(prompts):
        made = extract.extract_rows(gold, client, config.llm, variant, prompts)
        rows = made if rows is None else rows.unionByName(made)
    predicted = rows.withColumn("record_id", F.col("record_id").cast(gold.schema["record_id"].dataType)).cache()
    evaluated = extract.evaluate(predicted, gold)
    cost = predicted.groupBy("variant").agg(F.avg("latency_s").alias("mean_latency_s"), (F.avg("cost_usd") * 1000).alias("cost_per_1k"))
    best = extract.winner(evaluated).join(cost, "variant").first().asDict()
    sinks.write_text(f"{config.paths.reports_dir}/evaluation.md", report.evaluation_report(evaluated, best["variant"], gold.count(), dry_run))
    predicted.unpersist()
    return best


def run_predict(spark: SparkSession, config: Config) -> dict:
    data = _embedded(spark, config)
    log = _at(config, "extractions")
    labelled = readers.read_extractions(spark, log) if readers.exists(spark, log) else None
    if labelled is not None:
        labelled = labelled.withColumn("ok", F.lit(True))
    built = predict.assemble_features(data, readers.read_parquet(spark, _at(config, "theme_assignments.parquet")), labelled, data, config.predict.target)
    split = predict.time_split(built, config.predict.test_fraction).cache()
    train = split.where("split = 'train'")
    if train.isEmpty() or split.where("split = 'test'").isEmpty():
        raise ValueError("the time split leaves no training or no test rows")
    reduced = predict.pca_features(train, split, config.predict.embedding_pca_components).cache()
    k = len(reduced.first()["pca"])
    wide = reduced.withColumns({f"emb_{i}": F.get("pca", F.lit(i)) for i in range(k)}).drop("pca", "embedding")
    for c in list(wide.columns):
        wide = wide.withColumnRenamed(c, c.replace("-", "m").replace(" ", "_").replace(".", "_"))
    kinds = dict(wide.dtypes)
    features = [c for c in wide.columns if kinds[c] in ("double", "int") and c not in ("_y", "theme_id")]
    sinks.write_parquet(wide, _at(config, "features.parquet"))
    train, test = wide.where("split = 'train'"), wide.where("split = 'test'")
    metrics: dict = {"target": config.predict.target, "base_rate": wide.agg(F.avg("_y")).first()[0], "n_train": train.count(), "n_test": test.count()}
    models = {"logistic": predict.fit_logistic(train, features), "boosting": predict.booster(config.predict.backend)(train, features, config.predict.boosting_iterations)}
    for name, model in models.items():
        scored = predict.scores(model, test, features).cache()
        metrics[name] = {**predict.roc_auc(scored).first().asDict(), **predict.average_precision(scored).first().asDict(), **predict.brier_confusion(scored, config.predict.threshold).first().asDict(), "calibration": [r.asDict() for r in predict.calibration(scored).orderBy("bin").collect()]}
        scored.unpersist()
    metrics["importance"] = [r.asDict() for r in predict.permutation_importance(models["boosting"], test, features, config.predict.importance_repeats, config.seed).collect()]
    sinks.write_json(_at(config, "predict_metrics.json"), metrics)
    sinks.write_text(f"{config.paths.reports_dir}/predictive_model.md", report.model_report(metrics))
    return metrics


def run_stats(spark: SparkSession, config: Config) -> dict:
    summary, prevalence = readers.read_parquet(spark, _at(config, "theme_summary.parquet")), readers.read_parquet(spark, _at(config, "theme_prevalence.parquet"))
    total = F.lit(summary.agg(F.sum("n_docs")).first()[0] or 0)
    labels = readers.read_labels(spark, _at(config, "extractions"))
    every = findings.prevalence_findings(summary, total, config.stats).unionByName(findings.change_findings(prevalence, summary, config.stats)).unionByName(findings.sentiment_findings(labels, config.stats))
    rows = [json.loads(r[0]) for r in every.select(F.to_json(F.struct(*every.columns), {"ignoreNullFields": "false"})).collect()]  # a few a theme
    payload = {"findings": rows, "design_n": S.sample_size(config.stats.margin_of_error, config.stats.confidence_level), "margin": config.stats.margin_of_error, "confidence": config.stats.confidence_level}
    sinks.write_json(_at(config, "findings.json"), payload)
    sinks.write_text(f"{config.paths.reports_dir}/statistics.md", report.statistics_report(payload))
    return payload


def run_report(spark: SparkSession, config: Config) -> str:
    payload = readers.read_json(spark, _at(config, "findings.json"))
    metrics = readers.read_json(spark, _at(config, "predict_metrics.json"), required=False)
    band = findings.chart_band(readers.read_parquet(spark, _at(config, "theme_prevalence.parquet")), config.stats, config.report.top_n_themes)
    moods = [{"label": f["label"], "value": f["estimate"], "error": (f["ci_high"] - f["ci_low"]) / 2} for f in payload["findings"] if f["kind"] == "sentiment"]
    ranked = [{"label": f["feature"], "value": f["importance"]} for f in (metrics or {}).get("importance", [])[:12]]
    folder = config.paths.reports_dir
    Path(folder).mkdir(parents=True, exist_ok=True)
    charts = {"prevalence": report.draw(f"{folder}/prevalence.png", "prevalence", [r.asDict() for r in band.collect()]), "sentiment": report.draw(f"{folder}/sentiment.png", "bars", moods), "importance": report.draw(f"{folder}/importance.png", "bars", ranked)}
    text = report.insight_report(payload, metrics, charts)
    sinks.write_text(config.report.output_md, text)
    if config.report.output_html:
        sinks.write_text(config.report.output_html, report.to_html(text, "Insight Report"))
    return text


def run_sample(spark: SparkSession, config: Config, rows: int = 3000) -> None:
    """Write a stratified sample of the full file as the sample file; where there is no full file, synthetic records."""
    c = config.columns
    if readers.exists(spark, config.paths.raw_csv):
        made = samples.build_sample(readers.read_csv(spark, config.paths.raw_csv), c.text_column, c.category_column, c.id_column, rows, config.seed)
    else:
        made = samples.synthesize(spark, rows, config.seed)
    sinks.write_csv(made, config.paths.sample_csv)


def run_gold(spark: SparkSession, config: Config, n: int = 80, auto: bool = False, mapping: dict[str, str] | None = None) -> None:
    """Write n records as a gold file, to be labelled by a person or, with ``auto``, by rule."""
    records = readers.read_parquet(spark, _at(config, "records.parquet"))
    sinks.write_csv(samples.build_gold(records, n, mapping or {}, auto, config.seed), config.paths.gold_csv)


def run_all(spark: SparkSession, config: Config, dry_run: bool = False, full: bool = False, url: str = "") -> None:
    run_ingest(spark, config, full)
    run_embed(spark, config)
    run_themes(spark, config)
    run_extract(spark, config, dry_run, yes=True, url=url)
    run_predict(spark, config)
    run_stats(spark, config)
    run_report(spark, config)


COMMANDS = {
    "ingest": lambda s, c, a: run_ingest(s, c, a.full), "embed": lambda s, c, a: run_embed(s, c), "themes": lambda s, c, a: run_themes(s, c),
    "extract": lambda s, c, a: run_extract(s, c, a.dry_run, a.yes, a.url), "evaluate": lambda s, c, a: run_evaluation(s, c, a.dry_run, url=a.url), "predict": lambda s, c, a: run_predict(s, c),
    "stats": lambda s, c, a: run_stats(s, c), "report": lambda s, c, a: run_report(s, c), "run": lambda s, c, a: run_all(s, c, a.dry_run, a.full, a.url),
    "sample": lambda s, c, a: run_sample(s, c, a.rows), "gold": lambda s, c, a: run_gold(s, c, a.rows, a.auto),
}


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark", description="Customer feedback analytics on Spark")
    parser.add_argument("command", choices=list(COMMANDS))
    parser.add_argument("--config", default="config/config.yaml")
    parser.add_argument("--url", default="", help="endpoint of a live extraction or evaluation")
    parser.add_argument("--rows", type=int, default=3000, help="rows of a sample or gold file")
    for flag in ("--dry-run", "--full", "--yes", "--auto"):
        parser.add_argument(flag, action="store_true")
    return parser


def main(argv: Sequence[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    load_dotenv(Path(args.config).resolve().parent.parent / ".env")
    load_dotenv(".env")
    COMMANDS[args.command](session(), load_config(args.config), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
