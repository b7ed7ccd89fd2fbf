from collections import Counter

import corpus_pipeline as cp
from quillstone.llm import decontaminate, mixing, simhash, toxicity

D = "/root/testdata/sf0.01"


def test_stages_follow_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {"documents": docs}
    for name, stage in cp.STAGES:
        stage(spark, docs, D).write.parquet(f"{tmp_path}/{name}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {k: Counter(r.doc_id for r in v.select("doc_id").collect()) for k, v in kept.items()}
    for name in list(kept)[:-1]:
        assert kept[name].columns == cp.COLUMNS
    assert all(not ids[b] - ids[a] for a, b in (("documents", "toxicity"), ("toxicity", "simhash"), ("simhash", "decontamination")))

    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(kept["toxicity"]).collect()}
    assert set(ids["simhash"]) == set(groups.values()) and max(ids["simhash"].values()) == 1

    benchmark = spark.read.parquet(f"{D}/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate.contamination(kept["simhash"], benchmark).collect()}
    assert leaks and set(ids["decontamination"]) == set(ids["simhash"]) - leaks

    copies = {r.doc_id: r.copies for r in mixing.mix_sources(kept["decontamination"]).collect()}
    assert ids["mixing"] == Counter({k: n for k, n in copies.items() if n})
    assert ids["tokens"] == ids["mixing"]


def test_toxic_documents_go_and_clean_ones_stay(spark):
    d = "/root/testdata/sf0.1"
    kept = {r.doc_id for r in cp.reject_toxic(spark, spark.read.parquet(f"{d}/documents.parquet"), d).select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for toxic, least, most in ((0, 0.97, 1.0), (1, 0.0, 0.12)):
        own = [k in kept for k, t in labels.items() if t == toxic]
        assert least * len(own) <= sum(own) <= most * len(own)


def test_run_returns_the_last_stage(spark):
    rows = cp.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_stages_take_nulls_and_nothing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, "en", "s", 0), (2, "a b c d e", "en", "s", 9)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in cp.STAGES:
            assert stage(spark, docs, "/root/testdata/sf0.001").count() >= 0, name


def test_the_operators_are_the_dealt_ones():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "tokens"]
    assert toxicity.GRAMMAR.move
