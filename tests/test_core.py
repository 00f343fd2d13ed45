"""Literal expectations of the core operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import dates as D
from tidemark.functions import statistics as S
from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import embed, extract, findings, ingest, predict, themes
from tidemark.plans import views


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()] or ["id"])
    return row.select(column.alias("v")).first()["v"]


def test_text(spark):
    rows = spark.createDataFrame([("  hello   world \n\t ",), ("bad\x00text\x07here",), (None,), ("a b c",)], "t string")
    assert [r[0] for r in rows.select(T.display_text(F.col("t"))).collect()] == ["hello world", "bad text here", "", "a b c"]
    assert [r[0] for r in rows.select(T.count_tokens(F.col("t"))).collect()] == [2, 3, 0, 3]
    assert value(spark, T.clustering_text(F.lit("My name is XXXX on XX/XX/XXXX"))) == "my name is on"
    assert value(spark, T.canonical_form(F.lit("Hello, WORLD!!!"))) == "hello world" == value(spark, T.canonical_form(F.lit("hello world")))
    assert value(spark, T.canonical_form(F.lit("Straße"))) == "strasse"
    stripped = value(spark, T.strip_company(F.lit("chase charged me an unauthorized fee on my card"), F.lit("JPMORGAN CHASE & CO.")))
    assert stripped == "charged me an unauthorized fee on my card"
    assert value(spark, T.strip_company(F.lit("bank of america is slow"), F.lit("BANK OF AMERICA, N.A."))) == "bank of is slow"
    assert value(spark, T.strip_company(F.lit("as it was"), F.lit(None).cast("string"))) == "as it was"
    assert value(spark, T.with_pairs(T.embed_words(F.lit("One two, three")))) == ["one", "two", "three", "one_two", "two_three"]
    assert value(spark, T.with_pairs(T.embed_words(F.lit("One")))) == ["one"] and value(spark, T.with_pairs(T.embed_words(F.lit("")))) == []
    assert value(spark, T.narrative_of(F.lit("RECORD: x\nRECORD:\n it is \n"))) == "it is"


def test_texts_on_bytes_agree_with_columns(spark):
    chars = [chr(c) for c in [*range(0x3100), *range(0xA640, 0xABC0), *range(0xF900, 0xFB50), 0x10FFFF, *range(0x10400, 0x10450)]]
    texts = ["a" + "b".join(chars[i : i + 50]) + "c  d" for i in range(0, len(chars), 50)] + [c * n + "x" + c * n for c in T.SPACES for n in (1, 2, 7)] + ["", " ", "Straße  ﬃ K İ ẞ ŉ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    slow = F.coalesce("t", F.lit(""))
    canonical = F.trim(F.regexp_replace(T.casefold(slow), "[^a-z0-9]+", " "))
    out = rows.select("t", T.display_text(F.col("t")).alias("shown"), T.normalize_whitespace(slow).alias("shown2"), T.canonical_form(F.col("t")).alias("form"), canonical.alias("form2"), T.canonical_digest(F.col("t")).alias("key"), F.unhex(F.sha2(canonical, 256)).alias("key2")).collect()
    for r in out:
        assert r["shown"] == r["shown2"] and r["form"] == r["form2"] and r["key"] == r["key2"], ascii(r["t"])


def test_records_go_by_bytes_and_once(spark, tmp_path):
    spark.createDataFrame([(1, "One\ttwo  xx  Straße", "de", "web"), (2, None, "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    made = views.records(spark, str(tmp_path))
    assert sorted((r["_ord"], r["text"], r["text_clean"]) for r in made.collect()) == [(2, "One two xx Straße", "one two straße"), (3, "ONE TWO XX STRAßE", "one two straße"), (4, "", ""), (5, "", "")]
    plan = made.groupBy("_ord").agg(F.max(F.hash("text", "text_clean")))._jdf.queryExecution().executedPlan().toString()
    assert views.UPPER not in plan and plan.count("Scan parquet") == 1


def test_min_tokens_counts_once(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, " a\u3000b "), (3, None), (4, "a  b c\x00d")], "id long, t string").withColumn("text_clean", T.clustering_text(F.col("t")))
    out = ingest.filter_min_tokens(df, 3)
    assert out.columns == df.columns and sorted(r["id"] for r in out.collect()) == [1, 4]
    filters = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter " in x]
    assert filters and not any("lower" in x or "replace" in x for x in filters)


def test_variants_read_the_input_once(spark):
    texts = ["An overdraft fee", " a fraudulent charge \n", "RECORD: a billing dispute {{NARRATIVE}}", "nothing", ""] + [f"an overdraft fee {i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    vocab = C.Llm().controlled_vocab
    made = extract.mock_variants(df, vocab, ["v1", "v2", "v3"])
    client = extract.MockClient(vocab)
    want = {(i, v): extract.parse_text(client.complete("", T_FILL(v, t), variant=v).text, vocab)["issue_category"] for i, t in enumerate(texts) for v in ("v1", "v2", "v3")}
    assert {(r["i"], r["variant"]): r["issue_category"] for r in made.collect()} == want
    assert len({tuple(want[i, v] for i in range(len(texts))) for v in ("v1", "v2", "v3")}) == 3
    assert made._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1


def T_FILL(variant, text):
    return extract.PROMPTS[variant].replace("{{NARRATIVE}}", text)


def test_dates(spark):
    rows = spark.createDataFrame([("2021-03-15",), ("2022-01-03",), ("2021-01-01",), ("not a date",)], "d string").select(D.parse_date(F.col("d")).alias("d"))
    out = rows.select("d", D.year_month(F.col("d")).alias("m"), D.iso_week(F.col("d")).alias("w")).collect()
    assert [(r["m"], r["w"]) for r in out] == [("2021-03", "2021-W11"), ("2022-01", "2022-W01"), ("2021-01", "2020-W53"), (None, None)]


RAW = "id long, txt string, day string, product string, Company string"


def raw(spark):
    rows = [(1, "The bank charged me a fee", "2021-05-01", "Card", None), (2, "The bank charged me a fee", "2021-05-02", "Card", None), (3, "THE BANK, charged me a fee!", "2021-05-03", "Card", None), (4, "too short", "2021-05-04", "Card", None), (5, "this one has no usable date at all", "not a date", "Card", "Acme")]
    return spark.createDataFrame(rows, RAW)


COLUMNS = C.Columns(text_column="txt", date_column="day", category_column="product", id_column="id", company_column="Company", group_columns=["Company"], subcategory_column=None, outcome_column=None, timely_column=None)


def test_clean_chain_and_funnel(spark):
    std = ingest.standardize(raw(spark), COLUMNS, order=F.col("id"))
    out = ingest.clean_records(std, C.Ingest(min_tokens=5)).collect()
    assert [(r["record_id"], r["text"], r["year_month"]) for r in out] == [(1, "The bank charged me a fee", "2021-05")]
    ok = D.parse_date(F.col("_raw_date")).isNotNull()
    funnel = ingest.quality_funnel(std, C.Ingest(min_tokens=5), ok).orderBy("step").collect()
    assert [(r["before"], r["after"]) for r in funnel] == [(5, 4), (4, 3), (3, 2), (2, 1)]
    assert ingest.filter_min_tokens(std, 6).count() == 4


def test_bad_date_can_shadow_a_good_duplicate(spark):
    df = spark.createDataFrame([(1, "same text of five words", "nope"), (2, "same text of five words", "2021-01-01")], "_ord long, text string, _raw_date string").withColumn("text_clean", F.col("text"))
    assert ingest.clean_records(df, C.Ingest(min_tokens=1)).count() == 0


def test_statistics(spark):
    def wilson(x, n):
        r = spark.range(1).select(S.wilson(F.lit(x), F.lit(n)).alias("c")).first()["c"]
        return r["low"], r["high"]

    low, high = wilson(10, 100)
    assert abs(low - 0.0552) < 2e-4 and abs(high - 0.1744) < 2e-4
    assert wilson(0, 0) == (0, 0) and wilson(0, 50)[0] == 0 and wilson(50, 50)[1] == 1
    z = spark.range(1).select(S.two_proportion(F.lit(30), F.lit(100), F.lit(20), F.lit(100)).alias("t")).first()["t"]
    assert abs(z["z"] - 1.6330) < 1e-4 and abs(z["p"] - 0.1025) < 1e-4 and abs(z["diff"] - 0.1) < 1e-12
    empty = spark.range(1).select(S.two_proportion(F.lit(0), F.lit(0), F.lit(1), F.lit(2)).alias("t")).first()["t"]
    assert tuple(empty) == (0, 1, 0)
    xs = [0.0, 0.3, 1.0, 1.49, 1.5, 2.0, 5.0, 9.0]
    for x, got in zip(xs, [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(S.erfc(F.col("x"))).collect()]):
        assert abs(got - math.erfc(x)) < 1e-12 and abs(got / math.erfc(x) - 1) < 1e-6
    tests = spark.createDataFrame([(0, 0.001), (1, 0.5), (2, 0.04), (3, 0.6)], "i int, p double")
    bh = {r["i"]: r for r in S.benjamini_hochberg(tests, "p").collect()}
    assert [bh[i]["reject"] for i in range(4)] == [True, False, False, False] and abs(bh[0]["q"] - 0.004) < 1e-12 and abs(bh[2]["q"] - 0.08) < 1e-12
    assert S.sample_size(0.03) == 1068 and S.sample_size(0.03, population=2000) < 1068
    low, high = S.bootstrap_interval(30, 100)
    assert low < 0.3 < high and S.bootstrap_interval(0, 0) == (0.0, 0.0)


def test_change_direction(spark):
    rows = [(f"2021-0{m}", t, n) for m in (1, 2, 3, 4) for t, n in ((0, 100 if m < 3 else 300), (1, 900 if m < 3 else 700))]
    tests = {r["theme_id"]: r for r in findings.change_tests(spark.createDataFrame(rows, "year_month string, theme_id int, n_docs long"), C.Stats()).collect()}
    assert tests[0]["significant"] and tests[0]["direction"] == "emerging" and tests[1]["direction"] == "fading"
    three = spark.createDataFrame([("2021-01", 0, 1), ("2021-02", 0, 1), ("2021-03", 0, 1)], "year_month string, theme_id int, n_docs long")
    assert {r["year_month"]: r["late"] for r in findings.halves(three).collect()} == {"2021-01": False, "2021-02": True, "2021-03": True}


def test_themes(spark):
    docs = spark.createDataFrame([("overdraft fee overdraft", 0), ("overdraft charge", 0), ("mortgage escrow mortgage", 1), ("mortgage loan", 1), ("noise words", -1)], "doc string, theme_id int")
    words = themes.ctfidf(docs, F.col("theme_id"), F.col("doc"), 3).collect()
    assert {r["term"] for r in words if r["theme_id"] == 0 and r["rank"] == 1} == {"overdraft"} and {r["term"] for r in words if r["theme_id"] == 1 and r["rank"] == 1} == {"mortgage"}
    assert -1 not in {r["theme_id"] for r in words}
    prev = themes.prevalence(spark.createDataFrame([(0, "2021-01"), (0, "2021-01"), (1, "2021-01"), (1, "2021-02"), (-1, "2021-02")], "theme_id int, year_month string"))
    shares = {(r["year_month"], r["theme_id"]): r["share"] for r in prev.collect()}
    assert abs(shares["2021-01", 0] - 2 / 3) < 1e-6 and shares["2021-02", 1] == 1.0
    rng = np.random.default_rng(0)
    blobs = [(i, (rng.normal(0, 0.1, 8) + 6 * np.eye(8)[i % 2]).tolist()) for i in range(50)]
    df = spark.createDataFrame(blobs, "record_id long, embedding array<double>")
    placed = themes.outliers(themes.kmeans(df, 2, restarts=2), 0.1).collect()
    groups = [{r["theme_id"] for r in placed if r["record_id"] % 2 == p and r["theme_id"] != -1} for p in (0, 1)]
    assert len(groups[0]) == len(groups[1]) == 1 and groups[0] != groups[1] and 1 <= sum(r["theme_id"] == -1 for r in placed) <= 8
    dense = {r["record_id"]: r["theme_id"] for r in themes.density(df, 10, 3).collect()}
    assert len({dense[i] for i in range(0, 50, 2)} - {-1}) == 1 and {dense[i] for i in range(0, 50, 2)} - {-1} != {dense[i] for i in range(1, 50, 2)} - {-1}


def test_embeddings(spark, tmp_path):
    e = embed.HashingEmbedder(64)
    v = np.array(e.encode(["one two", "one two three", "quite different", ""]))
    assert np.allclose(np.linalg.norm(v[:3], axis=1), 1, atol=1e-5) and not v[3].any() and v[0] @ v[1] > v[0] @ v[2]

    df = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, "z")], "record_id long, text string")
    cache = str(tmp_path / "cache")
    assert embed.misses(df, embed.read_cache(spark, cache), e.tag).count() == 2
    assert embed.embed_records(spark, df, e, cache).where("embedding is not null").count() == 3
    assert embed.misses(df, embed.read_cache(spark, cache), e.tag).count() == 0
    assert value(spark, V.content_hash("tag", F.lit("é"))) == __import__("hashlib").sha1(b"tag\x00" + "é".encode()).hexdigest()
    with pytest.raises(ValueError):
        embed.get_embedder(C.Embed(backend="none"))


def test_predict(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("yes",), ("NO",), (None,)], "timely string")
    assert [r["_y"] for r in predict.build_target(df, "timely_response").collect()] == [0, 1, 0, 1, 0]
    with pytest.raises(ValueError):
        predict.build_target(df, "weather")
    months = spark.createDataFrame([(dt.datetime(2021, m, 1),) for m in range(1, 13)], "date timestamp")
    split = [r["split"] for r in predict.time_split(months).orderBy("date").collect()]
    assert split == ["train"] * 9 + ["test"] * 3
    scored = spark.createDataFrame([(i % 2, 0.9 if i % 2 else 0.1) for i in range(40)], "_y int, p double")
    assert predict.roc_auc(scored).first()[0] == 1.0 and sum(predict.brier_confusion(scored).first()[1:]) == 40
    assert predict.roc_auc(scored.where("_y = 1")).first()[0] is None
    ties = spark.createDataFrame([(1, 0.8), (0, 0.8), (1, 0.4), (0, 0.3), (0, 0.8)], "_y int, p double")
    assert predict.roc_auc(ties).first()[0] == 0.5 and abs(predict.average_precision(ties).first()[0] - 5 / 12) < 1e-8


VOCAB = ["billing_dispute", "fees_and_charges", "other"]


def test_parse_response(spark):
    good = '{"sentiment_label": "Negative ", "sentiment_score": -5, "issue_category": "%s", "severity": "HIGH", "is_actionable": "true"}'
    raws = ["```json\n" + good % "fees_and_charges" + "\n```", "text " + good % "unknown" + " more", good.replace("Negative ", "furious") % "other", "no json", "[1]", None]
    out = [r["r"] for r in spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").orderBy("i").select(extract.parse_response(F.col("raw"), VOCAB).alias("r")).collect()]
    assert [r["valid"] for r in out] == [True, True, False, False, False, False]
    assert out[0]["sentiment_score"] == -1.0 and out[0]["issue_category"] == "fees_and_charges" and out[1]["issue_category"] == "other"
    for raw_text, ok in zip(raws[:5], [True, True, False, False, False]):
        if ok:
            extract.parse_text(raw_text, VOCAB)
        else:
            with pytest.raises(ValueError):
                extract.parse_text(raw_text, VOCAB)


class Flaky:
    def __init__(self, failures, error=extract.RetryableError):
        self.left, self.error, self.calls = failures, error, 0

    def complete(self, system, user, *, variant=None):
        self.calls += 1
        if self.left:
            self.left -= 1
            raise self.error("x")
        return extract.MockClient(VOCAB).complete(system, user, variant=variant)


def test_extract_one_retries():
    quick = C.Llm(backoff_base_seconds=0.0, controlled_vocab=VOCAB)
    one = lambda client: extract.extract_one(client, extract.PROMPTS["v3"], 1, "an overdraft fee", quick, "v3", sleep=lambda s: None)
    row = one(Flaky(2))
    assert row["ok"] and row["attempts"] == 3 and row["issue_category"] == "fees_and_charges"
    row = one(Flaky(9, extract.PermanentError))
    assert not row["ok"] and row["attempts"] == 1
    assert one(Flaky(99))["attempts"] == quick.max_attempts
    assert extract.backoff_seconds(1, 1, 30) <= 2 and extract.backoff_seconds(10, 1, 30) <= 31


def test_batches_resume_and_cap(spark, tmp_path):
    settings = C.Llm(controlled_vocab=VOCAB)
    todo = spark.createDataFrame([(i, f"narrative {i} about a fee") for i in range(8)], "record_id long, text string")
    log = str(tmp_path / "log")
    extract.run_batch(spark, todo, extract.MockClient(VOCAB), settings, log)
    done = extract.read_checkpoint(spark, log)
    assert done.count() == 8 and extract.remaining(todo, done).count() == 0
    many = spark.createDataFrame([(i, f"narrative {i} " * 20) for i in range(50)], "record_id long, text string")
    capped = str(tmp_path / "capped")
    extract.run_batch(spark, many, extract.MockClient(VOCAB), C.Llm(controlled_vocab=VOCAB, max_spend_usd=0.001), capped, batch=2)
    assert 1 <= extract.read_checkpoint(spark, capped).where("ok").count() < 50


def test_classifier_agrees_with_the_client(spark):
    texts = ["An overdraft fee", "a fraudulent charge and my attorney", "coffee", "nothing", "a billing dispute"]
    vocab = C.Llm().controlled_vocab
    rows = extract.mock_extract(spark.createDataFrame([(t,) for t in texts], "text string"), vocab, "v1").collect()
    for t, r in zip(texts, rows):
        prompt = extract.PROMPTS["v1"].replace("{{NARRATIVE}}", t)
        made = extract.parse_text(extract.MockClient(vocab).complete("", prompt, variant="v1").text, vocab)
        assert {k: r[k] for k in made} == made


def test_sample_is_reproducible(spark):
    df = spark.range(100).withColumnRenamed("id", "record_id")
    a, b = ([r[0] for r in extract.sample_records(df, 10).collect()] for _ in range(2))
    assert a == b and len(a) == 10 and extract.sample_records(df, 1000).count() == 100


def test_config_and_dotenv(tmp_path, monkeypatch):
    folder = tmp_path / "config"
    folder.mkdir()
    (folder / "c.yaml").write_text("project: {seed: 7}\npaths: {processed_dir: data/p}\nthemes: {algorithm: kmeans, kmeans: {n_clusters: 3}}\nstats: {fdr_alpha: 0.1}\n")
    c = C.load_config(folder / "c.yaml")
    assert c.seed == 7 and c.themes.n_clusters == 3 and c.stats.fdr_alpha == 0.1 and c.paths.processed_dir == str(tmp_path / "data/p")
    with pytest.raises(FileNotFoundError):
        C.load_config(folder / "none.yaml")
    env = tmp_path / ".env"
    env.write_text("# c\nexport TIDE_A='x y'\nTIDE_B=2\n")
    monkeypatch.setenv("TIDE_B", "kept")
    monkeypatch.delenv("TIDE_A", raising=False)
    assert C.load_dotenv(env) == {"TIDE_A": "x y"}
    monkeypatch.delenv("TIDE_A")


def test_nearest_many_in_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 6))
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    asked = index.where("id % 2 = 0").withColumnRenamed("id", "query_id")
    rows = lambda n: sorted(map(tuple, embed.nearest_many(index, asked, 3, "id", query_rows=n).collect()))
    whole = rows(10_000)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert {(q, i) for q, i, _, _ in whole} == {(q, int(i)) for q in range(0, 60, 2) for i in np.argsort(-(unit[q] @ unit.T))[:3]}
    assert len(whole) == 90 and rows(7) == whole and rows(30) == whole and rows(29) == whole
    assert embed.nearest_many(index, asked.where("false"), 3, "id").count() == 0


def test_zero_vectors_are_near_nothing(spark):
    index = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, embedding array<double>")
    asked = index.withColumnRenamed("id", "query_id")
    found = {(r["query_id"], r["id"]) for r in embed.nearest_many(index, asked, 3, "id").collect()}
    assert found == {(q, i) for q in (1, 2) for i in (1, 2)}
    assert {r["id"] for r in embed.nearest(index, [1.0, 0.0], 3, "id").collect()} == {1, 2}


def test_nearest_many_works_in_tiles(spark, monkeypatch):
    shapes, merge = [], embed._merge
    monkeypatch.setattr(embed, "TILE_QUERIES", 5)
    monkeypatch.setattr(embed, "TILE_ROWS", 7)
    # Ties by the dozen: four directions, ids out of order.
    x = np.tile(np.eye(4), (20, 1))[np.random.default_rng(3).permutation(80)]
    far, names = np.full((4, 3), embed.FAR), np.empty((4, 3), dtype=np.int64)
    for start in range(0, 80, 7):
        shapes.append((tile := np.eye(4) @ x[start : start + 7].T).shape)
        merge(tile, np.arange(start, min(start + 7, 80)), far, names)
    assert max(shapes) <= (5, 7) and names.tolist() == [np.flatnonzero(x[:, q])[:3].tolist() for q in range(4)] and (far == 0).all()
    for kind in ("long", "string"):
        index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").select(F.col("id").cast(kind), "embedding").repartition(2)
        asked = index.where("cast(id as long) < 23").withColumnRenamed("id", "query_id")
        got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in embed.nearest_many(index, asked, 3, "id").collect()}
        own = (lambda i: i) if kind == "long" else str
        for q in range(23):
            near = sorted(own(int(i)) for i in np.flatnonzero((x == x[q]).all(axis=1)))[:3]
            assert [got[own(q), n] for n in (1, 2, 3)] == [(i, 0.0) for i in near]


def test_live_runs_need_an_endpoint_and_a_key(monkeypatch, tmp_path):
    settings = C.Llm(api_key_env="TIDE_KEY")
    monkeypatch.delenv("TIDE_KEY", raising=False)
    assert isinstance(extract.get_client(settings, True), extract.MockClient)
    with pytest.raises(extract.PermanentError, match="endpoint"):
        extract.get_client(settings, False)
    with pytest.raises(extract.PermanentError, match="TIDE_KEY"):
        extract.get_client(settings, False, "http://localhost/x")
    monkeypatch.setenv("TIDE_KEY", "k")
    client = extract.get_client(C.Llm(api_key_env="TIDE_KEY", url="http://localhost/x"), False)
    client.send = lambda url, headers, body: (200, {"text": headers["Authorization"], "input_tokens": 1, "output_tokens": 2})
    assert client.complete("s", "u").text == "Bearer k"
    for status, error in ((429, extract.RetryableError), (503, extract.RetryableError), (400, extract.PermanentError)):
        client.send = lambda url, headers, body, status=status: (status, {})
        with pytest.raises(error):
            client.complete("s", "u")
    (tmp_path / "extract_v2.txt").write_text("Mine: {{NARRATIVE}}")
    assert extract.load_prompts(str(tmp_path))["v2"] == "Mine: {{NARRATIVE}}" and extract.load_prompts(str(tmp_path))["v1"] == extract.PROMPTS["v1"]
    (tmp_path / "extract_v9.txt").write_text("no place")
    with pytest.raises(ValueError):
        extract.load_prompts(str(tmp_path))


def test_quantiles_by_ranges(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.integers(0, 5, 500)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    shares = [0.0, 0.1, 0.333, 0.5, 0.75, 0.95, 1.0]
    want = np.quantile(x, shares)
    for rows, ranges in ((10**6, 1024), (50, 16), (400, 64)):
        assert np.allclose(S.quantiles(df, F.col("x"), shares, rows, ranges), want)
    assert S.quantiles(df.where("false"), F.col("x"), [0.5]) == [None]


def test_range_of(spark):
    cuts = [1.0, 2.0, 2.5, 7.0, 9.0]
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1.5, 2, 2.6, 7, 8, 9, 10)], "x double")
    got = [tuple(r) for r in df.select("x", S.range_of(F.col("x"), F.lit(cuts), 8)).collect()]
    assert all(n == sum(c < x for c in cuts) for x, n in got)
    assert value(spark, S.range_of(F.lit(1.0), F.array().cast("array<double>"), 8)) == 0


def test_benjamini_hochberg_of_many(spark, monkeypatch):
    rng = np.random.default_rng(5)
    p = np.round(np.concatenate([rng.uniform(0, 0.01, 300), rng.uniform(0, 1, 3000), np.full(200, 0.5)]), 5)
    got = {r["i"]: r for r in S.benjamini_hochberg(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double"), "p").collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    want = np.empty(len(p))
    want[order] = np.minimum(q, 1)
    assert all(abs(got[i]["q"] - want[i]) < 1e-12 and got[i]["reject"] == (want[i] <= 0.05) for i in range(len(p)))


def test_keep_first_and_cleaning(spark):
    rows = [(i, t, t.lower(), "2021-01-01" if i % 5 else "none") for i, t in enumerate(["one two three four five", "One two three four five", "one two three four five", "few words", "ONE TWO, three four five!", "a b c d e", "a b c d e", "six words are in this text"])]
    df = spark.createDataFrame(rows, "_ord long, text string, text_clean string, _raw_date string")
    assert sorted(r["_ord"] for r in ingest.dedup_exact(df).collect()) == [0, 1, 3, 4, 5, 7]
    assert sorted(r["_ord"] for r in ingest.dedup_near(df).collect()) == [0, 3, 5, 7]
    for settings, want in ((C.Ingest(min_tokens=5), [7]), (C.Ingest(min_tokens=5, dedup_near=False), [1, 4, 7]), (C.Ingest(min_tokens=5, dedup_near=False, dedup_exact=False), [1, 2, 4, 6, 7])):
        assert sorted(r["_ord"] for r in ingest.clean_records(df, settings).collect()) == want
    funnel = [(r["label"], r["before"], r["after"]) for r in ingest.quality_funnel(df, C.Ingest(min_tokens=5), D.parse_date(F.col("_raw_date")).isNotNull()).orderBy("step").collect()]
    assert funnel == [("min tokens", 8, 7), ("exact duplicates", 7, 5), ("near duplicates", 5, 3), ("invalid dates", 3, 1)]


def test_cleaning_plan_sorts_no_text(spark):
    df = spark.range(10).select(F.col("id").alias("_ord"), F.col("id").cast("string").alias("text"), F.col("id").cast("string").alias("text_clean"), F.lit("2021-01-01").alias("_raw_date"))
    plan = ingest.clean_records(df, C.Ingest(min_tokens=1)).select("date")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_density_of_more_rows_than_are_fitted(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = np.array([[5.0, 0, 0], [0, 5.0, 0], [0, 0, 5.0]])
    x = np.concatenate([c + rng.normal(scale=0.2, size=(150, 3)) for c in centres] + [rng.uniform(20, 60, size=(20, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "record_id long, embedding array<double>")
    monkeypatch.setattr(themes, "DENSITY_ROWS", 200)
    got = {r["record_id"]: r["theme_id"] for r in themes.density(df, 15, 5, components=2).collect()}
    assert len(got) == len(x)
    for k in range(3):
        labels = [got[i] for i in range(150 * k, 150 * (k + 1))]
        top = max(set(labels), key=labels.count)
        assert top >= 0 and labels.count(top) > 120
    assert sum(got[i] == -1 for i in range(450, 470)) >= 15
