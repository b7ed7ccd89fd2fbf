import re

from quillstone.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def places(text) -> list[tuple[int, str]]:
    w = words(text)
    return sorted((i, t.label) for t in licenses.BASE for i in range(len(w)) if w[i : i + len(t.words.split())] == t.words.split())


def test_query_against_plain_python(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in licenses.op8_licenses(spark, d).collect()}
    assert set(got) == set(texts)
    hits = 0
    for k, text in texts.items():
        r, want = got[k], places(text)
        hits += len(want)
        assert r.n_words == len(words(text)) and r.n_base == len(want)
        assert (r.first_word, r.last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in want}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert hits


def spans(spark, *texts) -> list[set]:
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    out = [set() for _ in texts]
    for r in licenses.license_spans(docs).collect():
        out[r.doc_id].add((r.label, r.start, r.n_words, round(r.share, 3)))
    return out


def test_whole_changed_and_repeated_sentences(spark):
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    dropped = mit.replace(" free", "")
    changed = mit.replace("person", "one")
    far = "permission is granted to copy any software of this person"
    got = spans(spark, f"x y {mit}", dropped, changed, far, f"{mit} and then {mit}", "CC-BY cc by; All Rights. Reserved", None, "", "cc")
    assert ("mit", 2, 16, 1.0) in got[0]
    assert any(x[0] == "mit" and x[3] >= 0.6 for x in got[1]) and any(x[0] == "mit" and x[3] >= 0.6 for x in got[2])
    assert not any(x[0] == "mit" for x in got[3])
    assert {x[1] for x in got[4] if x[0] == "mit"} == {0, 18}
    assert {("cc-by", 0, 2, 1.0), ("cc-by", 2, 2, 1.0), ("reserved", 4, 3, 1.0)} <= got[5]
    assert got[6] == got[7] == got[8] == set()


def test_base_needs_whole_words_in_a_row(spark):
    got = spans(spark, "general public notlicense general public license", "all rights all rights reserved", "acc by cc bys")
    assert [x[1] for x in got[0] if x[0] == "gpl" and x[3] == 1.0] == [3]
    assert [x[1] for x in got[1]] == [2]
    assert got[2] == set()


def test_repeated_rows_and_long_texts(spark, tmp_path):
    long = "word " * 30_000 + "all rights reserved " * 3
    rows = [(None, "all rights reserved"), (None, "all rights reserved"), (1, long), (1, None), (1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.n_words, r.n_base, r.first_word, r.last_word) for r in licenses.op8_licenses(spark, str(tmp_path)).collect() if r.n_base)
    assert got == [(3, 1, 0, 0), (3, 1, 0, 0), (30_009, 3, 30_000, 30_006)]
    assert licenses.op8_licenses(spark, str(tmp_path)).count() == 5
    assert licenses.license_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_text_of_very_many_places(spark):
    text = " ".join("Ünder CC-BY 😀 terms" for _ in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "all rights reserved")], "doc_id long, text string")
    got = licenses.license_spans(docs).where("template < 3").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 100_000, 2: 1}
