"""Structured extraction: prompts, offline classifier, response parsing, cost, resumable capped batches, evaluation."""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.checkpoints import delete
from tidemark.config import Llm
from tidemark.functions import statistics as S
from tidemark.functions import text as T

# Keywords by category, in order of priority; words that mark escalation; label sets.
CATEGORY_KEYWORDS = [
    ("unauthorized_activity", ("unauthorized", "fraud", "fraudulent", "identity", "stolen")),
    ("credit_reporting_error", ("credit report", "bureau", "inquiry", "inaccurate", "score")),
    ("debt_collection_harassment", ("collector", "collection", "garnish", "harass", "validation")),
    ("loan_servicing", ("mortgage", "escrow", "servicer", "modification", "forbearance", "loan")),
    ("account_access", ("frozen", "access", "closed my account", "locked", "withdrawn", "closure")),
    ("rewards_and_offers", ("rewards", "points", "bonus", "miles", "cashback", "cash back")),
    ("fees_and_charges", ("fee", "overdraft", "charged", "charge", "interest", "apr")),
    ("billing_dispute", ("dispute", "billing", "statement")),
]
ESCALATION_WORDS = ("legal action", "attorney", "third complaint", "lawsuit", "foreclosure", "garnish")
DEGRADE_PERCENT = {"v1": 40, "v2": 20, "v3": 0}
SENTIMENTS = ("negative", "neutral", "positive")
SEVERITIES = ("low", "medium", "high")
TRUE, FALSE = ("true", "1", "yes", "on", "t", "y"), ("false", "0", "no", "off", "f", "n")
EST_OUTPUT_TOKENS = 80

SYSTEM_PROMPT = "Read one customer narrative and answer with exactly one JSON object holding the requested fields; no other text, no code fences."
_FIELDS = """Fill these fields as one JSON object:
- "sentiment_label": "negative", "neutral" or "positive"
- "sentiment_score": number between -1.0 and 1.0
- "issue_category": one of [{{CATEGORIES}}]
- "severity": "low", "medium" or "high"
- "is_actionable": true or false
"""
_SHOTS = """
Example: "They keep ringing about a debt that I settled last year."
{"sentiment_label": "negative", "sentiment_score": -0.7, "issue_category": "debt_collection_harassment", "severity": "high", "is_actionable": true}
"""
_RUBRIC = """
Score below -0.6 only for anger, loss or legal threats. Choose the single category of the main problem, "other" if none fits.
Severity is high for fraud, lost access or legal escalation, low for minor matters. Actionable means a concrete problem is named.
"""
PROMPTS = {v: _FIELDS + extra + "\nRECORD:\n{{NARRATIVE}}\n" for v, extra in (("v1", ""), ("v2", _SHOTS), ("v3", _RUBRIC + _SHOTS))}

RESULT_SCHEMA = "record_id string, ok boolean, sentiment_label string, sentiment_score double, issue_category string, severity string, is_actionable boolean, input_tokens long, output_tokens long, cost_usd double, latency_s double, attempts int, variant string, error string"
FIELDS = ("sentiment_label", "issue_category", "severity", "is_actionable")


# Columns: the offline classifier, its cost, and the parser of responses.


def contains_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def classify(narrative: Column, vocabulary: list[str], keywords=CATEGORY_KEYWORDS, escalation=ESCALATION_WORDS) -> Column:
    """Struct of the five fields by keyword rules: substrings, first category that matches, within the vocabulary."""
    lowered = F.lower(narrative)
    category = F.lit("other")
    for name, words in reversed(list(keywords)):
        if name in vocabulary:
            category = F.when(contains_any(lowered, words), F.lit(name)).otherwise(category)
    escalated = contains_any(lowered, escalation)
    return F.struct(F.lit("negative").alias("sentiment_label"), F.when(escalated, -0.9).otherwise(-0.6).alias("sentiment_score"), category.alias("issue_category"), F.when(escalated, "high").otherwise("medium").alias("severity"), F.lit(True).alias("is_actionable"))


def degraded(narrative: str, variant: str) -> bool:
    """Whether a prompt variant's simulated quality loses this narrative's category."""
    digest = hashlib.blake2b((narrative + variant).encode(), digest_size=4).hexdigest()
    return int(digest, 16) % 100 < DEGRADE_PERCENT.get(variant, 0)


def degraded_columns(narrative: Column, variants: list[str]) -> Column:
    """Array of ``degraded`` for each variant; a narrative is digested once for all of them. BLAKE2b is not among the engine's functions, hence an Arrow UDF."""

    def one(text: bytes | None) -> list[bool]:
        state = hashlib.blake2b(text or b"", digest_size=4)
        out = []
        for v in variants:
            (own := state.copy()).update(v.encode())
            out.append(int(own.hexdigest(), 16) % 100 < DEGRADE_PERCENT.get(v, 0))
        return out

    @F.arrow_udf("array<boolean>")
    def lost(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.bool_()))

    return lost(narrative)


def mock_extract(df: DataFrame, vocabulary: list[str], variant: str, text_col: str = "text") -> DataFrame:
    """``df`` with the offline classifier's five fields for a prompt variant."""
    return mock_variants(df, vocabulary, [variant], text_col).drop("variant")


def mock_variants(df: DataFrame, vocabulary: list[str], variants: list[str], text_col: str = "text") -> DataFrame:
    """``df`` once for each prompt variant, with the offline classifier's five fields and ``variant``; the input is read once.

    A narrative is what follows the last RECORD: of a prompt, so templates that end alike have it in common: it is
    found, classified and digested once for all of them.
    """
    ends: dict[str, list[str]] = {}
    for v in variants:
        head, mark, end = PROMPTS[v].rpartition("RECORD:")
        ends.setdefault(mark + end if "{{NARRATIVE}}" not in head else PROMPTS[v], []).append(v)
    parts = [_mock_variants(df, vocabulary, end, alike, text_col) for end, alike in ends.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _mock_variants(df: DataFrame, vocabulary: list[str], template: str, variants: list[str], text_col: str) -> DataFrame:
    out = df.withColumn("_n", T.narrative_of(T.fill_prompt(template, vocabulary, F.col(text_col))))
    lost = degraded_columns(F.col("_n"), variants) if any(DEGRADE_PERCENT.get(v) for v in variants) else F.array(*[F.lit(False)] * len(variants))
    out = out.withColumn("_c", classify(F.col("_n"), vocabulary)).withColumn("_lost", lost)
    out = out.select("*", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col("_lost")[i].alias("lost")) for i, v in enumerate(variants)])).alias("_v"))
    category = F.when(F.col("_v.lost"), "other").otherwise(F.col("_c.issue_category"))
    rest = [c for c in df.columns if c not in (*FIELDS, "sentiment_score", "variant")]
    return out.select(*rest, "_c.sentiment_label", "_c.sentiment_score", category.alias("issue_category"), "_c.severity", "_c.is_actionable", "_v.variant")


def token_count(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def response_cost(input_tokens: Column, output_tokens: Column, settings: Llm) -> Column:
    return input_tokens / 1000.0 * settings.input_cost_per_1k + output_tokens / 1000.0 * settings.output_cost_per_1k


def estimate_cost(prompts: DataFrame, n: Column | int, settings: Llm, prompt_col: str = "prompt", order_col: Column | str = "record_id", head: int = 50) -> DataFrame:
    """One row (avg_input_tokens, estimate_usd) from the first ``head`` prompts in an order, which may be a Column."""
    first = prompts.orderBy(order_col).limit(head)
    mean = first.agg(F.coalesce(F.avg(F.length(prompt_col) / 4), F.lit(0.0)).alias("avg_input_tokens"))
    rate = F.col("avg_input_tokens") / 1000.0 * settings.input_cost_per_1k + EST_OUTPUT_TOKENS / 1000.0 * settings.output_cost_per_1k
    return mean.withColumn("estimate_usd", (F.lit(n) if isinstance(n, int) else n) * rate)


def parse_response(raw: Column, vocabulary: list[str] | None = None) -> Column:
    """Struct (valid, five fields) of a raw response: fences off, outermost braces, all fields needed and checked.

    Labels are trimmed and lower-cased and must be known, the score is clamped to [-1, 1], a category
    outside the vocabulary becomes "other" if the vocabulary has it. JSON that is no object is invalid.
    """
    cleaned = T.strip_fences(raw)
    body = F.when(T.json_object(cleaned) != "", T.json_object(cleaned)).otherwise(cleaned)
    parsed = F.from_json(body, "sentiment_label string, sentiment_score string, issue_category string, severity string, is_actionable string")
    sentiment, severity = F.lower(F.trim(parsed["sentiment_label"])), F.lower(F.trim(parsed["severity"]))
    score = parsed["sentiment_score"].try_cast("double")
    flag = F.lower(F.trim(parsed["is_actionable"]))
    actionable = F.when(flag.isin(*TRUE), True).when(flag.isin(*FALSE), False)
    category = parsed["issue_category"]
    if vocabulary and "other" in vocabulary:
        category = F.when(category.isin(vocabulary), category).when(category.isNotNull(), F.lit("other"))
    valid = sentiment.isin(*SENTIMENTS) & severity.isin(*SEVERITIES) & score.isNotNull() & ~F.isnan(score) & actionable.isNotNull() & category.isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    keep = lambda c: F.when(valid, c)
    return F.struct(valid.alias("valid"), keep(sentiment).alias("sentiment_label"), keep(F.greatest(F.least(score, F.lit(1.0)), F.lit(-1.0))).alias("sentiment_score"), keep(category).alias("issue_category"), keep(severity).alias("severity"), keep(actionable).alias("is_actionable"))


# Planning: sample, resume, spend.


def sample_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_records(df: DataFrame, n: int, seed: int = 42, id_col: str = "record_id") -> DataFrame:
    """n rows in the order of a seeded hash: the same rows on every run and engine; all if there are fewer."""
    return df.orderBy(sample_order(F.col(id_col), seed), id_col).limit(n)


def remaining(df: DataFrame, done: DataFrame, id_col: str = "record_id", retry_failed: bool = False) -> DataFrame:
    """Rows whose id is not in the checkpoint. Failed rows count as done unless ``retry_failed``."""
    seen = (done.where("ok") if retry_failed else done).select(F.col("record_id").cast("string").alias("_id")).distinct()
    return df.join(seen, F.col(id_col).cast("string") == F.col("_id"), "left_anti")


def within_cap(planned: DataFrame, cost_col: str, order_col: str, cap: float, buckets: int = 1024) -> DataFrame:
    """The planned rows that start before the spend reaches the cap.

    A running sum over a total order, in two levels: sums by ranges of the order, whose prefix is a window over
    at most ``buckets`` rows, then a window inside each range. No task sees all rows.
    """
    cuts = planned.agg(S.range_cuts(F.col(order_col), buckets).alias("cuts"))
    ranged = planned.crossJoin(F.broadcast(cuts)).withColumn("_b", S.range_of(F.col(order_col), F.col("cuts"), buckets)).drop("cuts")
    sums = ranged.groupBy("_b").agg(F.sum(cost_col).alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_s")
    inner = Window.partitionBy("_b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("_before") + F.coalesce(F.sum(cost_col).over(inner), F.lit(0.0))
    return ranged.join(F.broadcast(before), "_b").withColumn("spent_before", F.round(spent, 9)).where(F.col("spent_before") < cap).drop("_b", "_before")


# Clients and the batch runner.


@dataclass
class Response:
    text: str
    input_tokens: int
    output_tokens: int


class RetryableError(Exception):
    """Rate limits, time-outs, server errors."""


class PermanentError(Exception):
    """Errors that another attempt will not mend."""


class Client(Protocol):
    def complete(self, system: str, user: str, *, variant: str | None = None) -> Response: ...


class MockClient:
    """The rules of ``classify`` outside the engine, for the batch runner's offline mode."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.vocabulary = vocabulary

    def complete(self, system: str, user: str, *, variant: str | None = None) -> Response:
        narrative = user.rpartition("RECORD:")[2].strip()
        lowered = narrative.lower()
        hits = (name for name, words in CATEGORY_KEYWORDS if name in self.vocabulary and any(w in lowered for w in words))
        category = "other" if variant and degraded(narrative, variant) else next(hits, "other")
        high = any(w in lowered for w in ESCALATION_WORDS)
        body = json.dumps({"sentiment_label": "negative", "sentiment_score": -0.9 if high else -0.6, "issue_category": category, "severity": "high" if high else "medium", "is_actionable": True})
        return Response(body, len(user) // 4, len(body) // 4)


class HttpClient:
    """A chat endpoint over HTTP (JSON in, JSON out); 429, 5xx and time-outs are retryable."""

    def __init__(self, settings: Llm, url: str, key: str, send: Callable[[str, dict, dict], tuple[int, dict]] | None = None) -> None:
        self.settings, self.url, self.key, self.send = settings, url, key, send or self._post

    @staticmethod
    def _post(url: str, headers: dict, body: dict) -> tuple[int, dict]:
        import urllib.error
        import urllib.request

        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(request, timeout=60) as reply:
                return reply.status, json.loads(reply.read())
        except urllib.error.HTTPError as e:
            return e.code, {}
        except (TimeoutError, urllib.error.URLError) as e:
            raise RetryableError(str(e)) from e

    def complete(self, system: str, user: str, *, variant: str | None = None) -> Response:
        status, reply = self.send(self.url, {"Authorization": f"Bearer {self.key}"}, {"model": self.settings.model, "system": system, "prompt": user, "temperature": 0.0})
        if status == 429 or status >= 500:
            raise RetryableError(f"status {status}")
        if status >= 400:
            raise PermanentError(f"status {status}")
        return Response(reply["text"], int(reply["input_tokens"]), int(reply["output_tokens"]))


def get_client(settings: Llm, dry_run: bool, url: str = "") -> Client:
    """The offline client for a dry run, else the live one; without an endpoint or a key a live run is an error.

    Made on the driver, where the key is read, and sent to the tasks.
    """
    if dry_run:
        return MockClient(settings.controlled_vocab)
    if not (url or settings.url):
        raise PermanentError("a live run needs an endpoint: give --url or llm.url, or run with --dry-run")
    key = os.environ.get(settings.api_key_env)
    if not key:
        raise PermanentError(f"a live run needs a key in {settings.api_key_env}")
    return HttpClient(settings, url or settings.url, key)


def load_prompts(folder: str | None = None) -> dict[str, str]:
    """Templates by version: those of ``PROMPTS``, and what the files extract_<version>.txt of a folder say instead."""
    found = dict(PROMPTS)
    for path in sorted(Path(folder).glob("extract_*.txt")) if folder else []:
        text = path.read_text(encoding="utf-8")
        if "{{NARRATIVE}}" not in text:
            raise ValueError(f"{path} has no {{{{NARRATIVE}}}}")
        found[path.stem.removeprefix("extract_")] = text
    return found


def backoff_seconds(attempt: int, base: float, cap: float) -> float:
    return min(cap, base * 2 ** (attempt - 1)) + random.uniform(0, base)


def parse_text(raw: str, vocabulary: list[str]) -> dict:
    """The rules of ``parse_response`` for one response, in Python; ValueError if it is invalid."""
    import re

    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", raw, flags=re.MULTILINE).strip()
    body = re.search(r"\{.*\}", text, re.DOTALL)
    try:
        data = json.loads(body[0] if body else text)
    except json.JSONDecodeError as e:
        raise ValueError(f"no JSON: {raw[:120]}") from e
    if not isinstance(data, dict):
        raise ValueError("not an object")
    try:
        sentiment, severity = str(data["sentiment_label"]).strip().lower(), str(data["severity"]).strip().lower()
        score, category, flag = float(data["sentiment_score"]), data["issue_category"], str(data["is_actionable"]).strip().lower()
    except (KeyError, TypeError) as e:
        raise ValueError(f"missing field {e}") from e
    if sentiment not in SENTIMENTS or severity not in SEVERITIES or flag not in (*TRUE, *FALSE) or not isinstance(category, str) or score != score:
        raise ValueError("invalid field")
    if category not in vocabulary and "other" in vocabulary:
        category = "other"
    return {"sentiment_label": sentiment, "sentiment_score": max(-1.0, min(1.0, score)), "issue_category": category, "severity": severity, "is_actionable": flag in TRUE}


def extract_one(client: Client, template: str, record_id, narrative: str, settings: Llm, variant: str, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One record with retries on retryable and parse errors; never raises for those. Tokens of all attempts are counted."""
    categories = ", ".join(f'"{c}"' for c in settings.controlled_vocab)
    user = template.replace("{{CATEGORIES}}", categories).replace("{{NARRATIVE}}", narrative)
    row = {"record_id": str(record_id), "ok": False, "variant": variant, "input_tokens": 0, "output_tokens": 0, "cost_usd": 0.0, "error": None}
    began = time.time()
    for attempt in range(1, settings.max_attempts + 1):
        row["attempts"] = attempt
        try:
            reply = client.complete(SYSTEM_PROMPT, user, variant=variant)
            row["input_tokens"] += reply.input_tokens
            row["output_tokens"] += reply.output_tokens
            row |= parse_text(reply.text, settings.controlled_vocab) | {"ok": True, "error": None}
            break
        except PermanentError as e:
            row["error"] = f"permanent: {e}"
            break
        except (RetryableError, ValueError) as e:
            row["error"] = f"{type(e).__name__}: {e}"
            if attempt < settings.max_attempts:
                sleep(backoff_seconds(attempt, settings.backoff_base_seconds, settings.backoff_max_seconds))
    row["cost_usd"] = row["input_tokens"] / 1000 * settings.input_cost_per_1k + row["output_tokens"] / 1000 * settings.output_cost_per_1k
    row["latency_s"] = time.time() - began
    return row


def extract_rows(todo: DataFrame, client: Client, settings: Llm, variant: str, prompts: dict[str, str] | None = None) -> DataFrame:
    """(record_id, text) to result rows: a thread pool in each task keeps a bounded number of calls in flight."""
    from concurrent.futures import ThreadPoolExecutor

    names = [part.strip().split()[0] for part in RESULT_SCHEMA.split(",")]
    template = (prompts or PROMPTS)[variant]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(settings.max_concurrency) as pool:
            for frame in frames:
                rows = list(pool.map(lambda r: extract_one(client, template, r[0], r[1], settings, variant), zip(frame["record_id"], frame["text"])))
                yield pd.DataFrame(rows, columns=names)

    return todo.select("record_id", "text").mapInPandas(run, RESULT_SCHEMA)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The append-only result log; empty where there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], RESULT_SCHEMA)
    return spark.read.schema(RESULT_SCHEMA).json(path)


#: Batches that share a folder of the written plan; a batch reads its folder only.
WAVE_BATCHES = 64


def run_batch(spark: SparkSession, todo: DataFrame, client: Client, settings: Llm, path: str, variant: str | None = None, batch: int = 200, prior_spend: bool = False, prompts: dict[str, str] | None = None) -> float:
    """Micro-batches appended to the log until all rows are done or the spend reaches the cap; returns the spend.

    The cap is looked at between batches: it is overshot by one batch at most. ``batch`` bounds that, so
    small caps want small batches. Rows are bucketed by a hash of their id and written beside the log once, a
    folder for so many batches, so that no batch reads the input again; nothing is collected but the sums.
    """
    variant = variant or settings.prompt_version
    spent = (read_checkpoint(spark, path).agg(F.sum("cost_usd")).first()[0] or 0.0) if prior_spend else 0.0
    n = todo.count()
    parts = max(1, -(-n // batch))
    part = F.pmod(F.xxhash64(F.col("record_id").cast("string")), F.lit(parts))
    plan = f"{path.rstrip('/')}_plan_{uuid.uuid4().hex}"
    marked = todo.select("record_id", "text", part.alias("_part"), F.floor(part / WAVE_BATCHES).alias("_wave"))
    try:
        marked.repartition("_wave", F.pmod("_part", F.lit(8))).write.partitionBy("_wave").parquet(plan)
        for number in range(parts if n else 0):
            if spent >= settings.max_spend_usd:
                break
            mine = spark.read.schema(f"record_id {dict(todo.dtypes)['record_id']}, text string, _part long, _wave long").parquet(plan).where((F.col("_wave") == number // WAVE_BATCHES) & (F.col("_part") == number))
            rows = extract_rows(mine, client, settings, variant, prompts).persist()
            try:
                rows.write.mode("append").json(path)
                spent += rows.agg(F.sum("cost_usd")).first()[0] or 0.0
            finally:
                rows.unpersist()
    finally:
        delete(spark, plan)
    return spent


# Summaries and evaluation.


def run_summary(results: DataFrame) -> DataFrame:
    """One row of totals over a result log. The median is exact, by ranges where the log is long."""
    median = F.lit(S.quantiles(results, F.col("latency_s"), [0.5])[0]).cast("double")
    return results.agg(
        F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 9).alias("spend_usd"), F.round(F.avg("latency_s"), 9).alias("mean_latency_s"), F.round(F.max(median), 9).alias("median_latency_s"),
        F.coalesce(F.sum(F.greatest(F.lit(0), F.col("attempts") - 1)), F.lit(0)).cast("long").alias("retries"),
        F.round(F.try_divide(F.sum("cost_usd") * 1000, F.count("*")), 9).alias("usd_per_1k"),
    )


def evaluate(predicted: DataFrame, gold: DataFrame, by: str = "variant", id_col: str = "record_id") -> DataFrame:
    """Accuracy of each field and the score's mean absolute error, by variant."""
    names = [*FIELDS, "sentiment_score"]
    g = gold.select(id_col, *[F.col(c).alias(f"_g_{c}") for c in names])
    joined = predicted.join(g, id_col)
    accuracies = [F.round(F.avg(F.col(c).eqNullSafe(F.col(f"_g_{c}")).cast("double")), 9).alias(f"acc_{c}") for c in FIELDS]
    return joined.groupBy(by).agg(F.count("*").alias("n"), *accuracies, F.round(F.avg(F.abs(F.col("sentiment_score") - F.col("_g_sentiment_score"))), 9).alias("mae_sentiment_score"))


def winner(evaluated: DataFrame, by: str = "variant") -> DataFrame:
    """The variant with the best category accuracy, then the best mean accuracy, then the first name."""
    mean = sum((F.col(f"acc_{c}") for c in FIELDS), F.lit(0.0)) / len(FIELDS)
    return evaluated.withColumn("mean_accuracy", F.round(mean, 9)).orderBy(F.desc("acc_issue_category"), F.desc("mean_accuracy"), by).limit(1)
