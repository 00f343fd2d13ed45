"""The pipeline on a small folder of tables."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    from tidemark.llm.queries import tokenizer

    clean = [f"plain text number {i} about rivers, stones and the weather of day {i * 7}" for i in range(40)]
    item = "what is the capital of the country that lies between the two long rivers"
    texts = [*clean, clean[3], clean[5].upper(), f"they ask {item} often", 'my token = "abcdef123456" stays', None, ""]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "byte_bpe" or docs.columns == columns
    assert set(range(40)) <= set(seen["toxicity"])
    kept = set(seen["simhash_near_dedup"])
    assert 40 not in kept and 41 not in kept and len(kept & {44, 45}) == 1
    assert 42 not in seen["benchmark_decontamination"]
    assert seen["secret_scan"][43]["text"] == 'my token = "[SECRET]" stays' and seen["secret_scan"][43]["n_chars"] == 27
    import tiktoken

    from tidemark.llm import bpe

    path, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.encoder(path, pattern).ranks, special_tokens={})
    for i, r in seen["byte_bpe"].items():
        assert r["ids"] == library.encode_ordinary(seen["secret_scan"][i]["text"] or "")
    assert {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()} == set(seen["byte_bpe"])


def test_stages_take_empty_tables_nulls_repeats_and_extra_columns(spark, tmp_path):
    extra = ["random", "tested", "score", "ids", "_spans", "row", "fp"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a plain text of some words", "en", "s", 26), (2, "a plain text of some words", "en", "s", 26), (3, "word " * 20_000, None, None, None)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for made, want in ((rows, 3), ([], 0)):
        docs = spark.createDataFrame([(*r, *extra) for r in made], schema)
        columns = docs.columns
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            out = f"{tmp_path}/{want}/{name}"
            docs.write.parquet(out)
            docs = spark.read.parquet(out)
            assert name == "byte_bpe" or docs.columns == columns
        assert docs.count() == want
