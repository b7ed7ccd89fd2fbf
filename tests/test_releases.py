import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.operators import releases as log
from quillstone.operators import rules as R
from quillstone.shared import scratch
from quillstone.sources import archives, pins, releases, variants


def test_log_folds_to_states_with_reasons(spark):
    events = [
        ("a", "readback", "p", True, 5, 5), ("a", "stage", "p", None, None, None), ("a", "publish", "p", None, None, None), ("a", "readback", "p", True, 4, 5),
        ("a", "readback", "q", True, 5, 5), ("a", "readback", "p", True, 5, 5), ("a", "publish", "q", None, None, None), ("a", "publish", "p", None, None, None),
        ("a", "publish", "p", None, None, None), ("a", "stage", "p", None, None, None), ("b", "stage", None, None, None, None), ("b", "other", "p", None, None, None), (None, "publish", "p", True, 1, 1),
    ]
    rows = [(r, k, k, *e) for k, (r, *e) in enumerate(events)]
    df = spark.createDataFrame(rows, "release string, logged_at long, id long, event string, payload_sha string, matched boolean, compared long, saved_rows long")
    got = {r.id: (r.reason, r.status) for r in log.judged_events(df).collect()}
    assert [got[k] for k in range(13)] == [
        ("not_staged", "none"), (None, "staged"), ("not_verified", "staged"), ("partial_readback", "staged"), ("payload_changed", "staged"), (None, "verified"),
        ("payload_changed", "verified"), (None, "published"), ("already_published", "published"), ("already_exists", "published"), (None, "staged"), ("unknown_event", "staged"), ("not_staged", "none"),
    ]
    assert {r.release: (r.status, r.refused) for r in log.current(df).collect()} == {"a": ("published", 7), "b": ("staged", 1), None: ("none", 1)}
    assert log.judged_events(df.limit(0)).count() == 0


def _staged(spark, name="r"):
    path = scratch(spark, "releases") + f"/{name}"
    releases.stage({"x": spark.range(30), "y": spark.range(5)}, path, name)
    return path


def test_release_is_published_after_a_whole_readback(spark):
    path = _staged(spark)
    with pytest.raises(releases.ReleaseError, match="exists"):
        releases.stage({"x": spark.range(1)}, path, "r")
    for compared, matched in ((34, True), (35, False)):
        with pytest.raises(releases.ReleaseError, match="partial"):
            releases.publish(spark, path, compared, matched)
    assert releases.publish(spark, path, 35, True)["publishable"] is True
    assert releases.record(spark, path)["status"] == "published"
    with pytest.raises(releases.ReleaseError, match="published"):
        releases.publish(spark, path, 35, True)


def test_crash_between_the_phases_is_set_right(spark):
    def crash():
        raise RuntimeError("lost")

    path = _staged(spark, "half")
    parent = path.rsplit("/", 1)[0]
    with pytest.raises(RuntimeError):
        releases.publish(spark, path, 35, True, crash)
    assert releases.record(spark, path)["status"] == "staged"
    releases.stage({"x": spark.range(3)}, f"{parent}/other", "other")
    releases.write_once(spark, f"{parent}/other/{releases.READBACK}", json.dumps({"compared": 2, "matched": True, "payload_sha256": "x"}).encode())
    spark.range(2).write.parquet(f"{parent}/new.incoming-1/payload/x")
    assert releases.recover(spark, parent) == {"half": "published", "other": "staged", "new.incoming-1": "removed"}
    assert releases.record(spark, path)["status"] == "published" and releases.record(spark, f"{parent}/other")["status"] == "staged"
    assert releases.recover(spark, parent) == {}


def test_changed_payload_is_refused(spark):
    path = _staged(spark)
    spark.range(1).write.mode("append").parquet(f"{path}/payload/x")
    with pytest.raises(releases.ReleaseError, match="differs"):
        releases.publish(spark, path, 35, True)


def test_file_changed_during_the_build_is_found(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n in "abc":
        (source / n).write_text(n)
    inputs, out = {"src": str(source)}, str(tmp_path / "out")
    good = lambda to: spark.range(3).write.parquet(to)

    def bad(to):
        good(to)
        (source / "a").write_text("other")
        (source / "b").unlink()
        (source / "d").write_text("new")

    with pytest.raises(pins.PinError) as e:
        pins.guarded(spark, inputs, out, bad)
    assert e.value.causes == ["src/a: changed_during_build", "src/b: gone_during_build", "src/d: added_during_build"] and not os.path.exists(out)
    expected = spark.createDataFrame([("src", "c", "0" * 64), ("src", "z", "1")], "label string, name string, sha256 string")
    with pytest.raises(pins.PinError, match="c: not_as_expected; src/z: missing"):
        pins.guarded(spark, inputs, out, good, expected)
    assert pins.guarded(spark, inputs, out, good, keep=str(tmp_path / "pins")).count() == 3
    assert spark.read.json(str(tmp_path / "pins")).count() == 3
    with pytest.raises(pins.PinError, match="exists"):
        pins.guarded(spark, inputs, out, good)
    assert pins.output_problems(spark, inputs, str(source / "x"), ["x"]) == ["frozen_name", "overlaps_input:src"]
    assert pins.output_problems(spark, inputs, str(tmp_path)) == ["exists", "overlaps_input:src"]


def test_archive_members_and_refusals(spark, tmp_path):
    def add(t, name, kind=tarfile.REGTYPE, link="", data=b""):
        m = tarfile.TarInfo(name)
        m.type, m.linkname, m.size = kind, link, len(data)
        t.addfile(m, io.BytesIO(data))

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        add(t, "wav/x.wav", data=b"12345")
        add(t, "../up")
        add(t, "/etc/passwd")
        add(t, "wav/../../up")
        add(t, "wav/../in")
        add(t, "l", tarfile.SYMTYPE, "x")
        add(t, "h", tarfile.LNKTYPE, "wav/x.wav")
        add(t, "dir/", tarfile.DIRTYPE)
        add(t, "pipe", tarfile.FIFOTYPE)
    with tarfile.open(tmp_path / "ok.tar", "w") as t:
        add(t, "one", data=b"1")
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "b.zip", "w") as z:
        z.writestr("c:/x", b"1")
        z.writestr("good/é.txt", b"123")
        z.writestr("..\\up", b"1")
    (tmp_path / "broken.tgz").write_bytes((tmp_path / "a.tar.gz").read_bytes()[:60])
    (tmp_path / "note.txt").write_text("no archive")
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        df = archives.read_members(spark, folder)
        assert df.rdd.getNumPartitions() == 4
        got = {(r.archive.rsplit("/", 1)[-1], r.member): (r.kind, r.size, r.reason) for r in df.collect()}
        assert [got["a.tar.gz", n] for n in ("wav/x.wav", "../up", "/etc/passwd", "wav/../../up", "wav/../in", "l", "h", "dir", "pipe")] == [
            ("file", 5, None), ("file", 0, "traversal"), ("file", 0, "absolute"), ("file", 0, "traversal"), ("file", 0, None), ("symlink", 0, "link"), ("hardlink", 0, "link"), ("directory", 0, None), ("special", 0, "special"),
        ]
        assert [got["b.zip", n] for n in ("c:/x", "good/é.txt", "..\\up")] == [("file", 1, "absolute"), ("file", 3, None), ("file", 1, "traversal")]
        assert got["broken.tgz", None][2].startswith("unreadable")
    safe = {r.archive.rsplit("/", 1)[-1]: (r.members, r.refused) for r in archives.safe_archives(df).collect()}
    assert safe == {"a.tar.gz": (9, 6), "ok.tar": (1, 0), "b.zip": (3, 2), "broken.tgz": (1, 1)}


def test_configurations_as_rows(spark):
    docs = [(1, '{"a":{"b":[1,{"c":2}],"d":null,"e":{}},"f":1e-05,"g":"x","h":true}'), (2, "nonsense{"), (3, None), (4, "[1]"), (5, "{}")]
    rows = variants.leaves(spark.createDataFrame(docs, "id long, doc string"), "id", "doc").collect()
    got = {(r.id, r.path): (r.kind, r.value, r.number) for r in rows}
    assert got == {
        (1, "$"): ("object", None, None), (1, "a"): ("object", None, None), (1, "a.b"): ("array", '[1,{"c":2}]', None), (1, "a.d"): ("null", None, None), (1, "a.e"): ("object", None, None),
        (1, "f"): ("number", got[1, "f"][1], 1e-5), (1, "g"): ("string", "x", None), (1, "h"): ("boolean", "true", None),
        (2, "$"): ("malformed", None, None), (3, "$"): ("malformed", None, None), (4, "$"): ("array", "[1]", None), (5, "$"): ("object", None, None),
    }


INFER = {
    "schema_version": "v", "seed": 1, "model": {"name": "m", "revision": None}, "scoring": {"normalization": "zh-cer-v1", "wer_tokenizer": None},
    "decode": {"eval": {"do_sample": False, "num_beams": 1, "max_new_tokens": 9, "repetition_penalty": 1, "no_repeat_ngram_size": 0, "context": "", "language": "zh", "eos_policy": "tokenizer_eos_only"}},
}


def test_closed_schema(spark):
    def changed(**at):
        doc = json.loads(json.dumps(INFER))
        for path, value in at.items():
            *head, last = path.split("__")
            inner = doc
            for h in head:
                inner = inner[h]
            if value is ...:
                del inner[last]
            else:
                inner[last] = value
        return json.dumps(doc)

    docs = [changed(), changed(seed=-1), changed(seed=True), changed(decode__eval__num_beams=2), changed(decode__eval__context=...), changed(decode=...), changed(extra=1), changed(model__x=1), changed(model=5), changed(decode__eval__do_sample=True), "{", changed(seed=1.0)]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, doc string")
    got = sorted((r.id, r.path, r.problem) for r in variants.schema_problems(variants.leaves(df, "id", "doc"), "id", R.INFER_SCHEMA).collect())
    assert got == [
        (1, "seed", "range"), (2, "seed", "kind"), (3, "decode.eval.num_beams", "range"), (4, "decode.eval.context", "missing"), (5, "decode", "missing"), (6, "extra", "unknown"), (7, "model.x", "unknown"),
        (8, "model", "kind"), (9, "decode.eval.do_sample", "choice"), (10, "$", "malformed"),
    ]


def test_rules_between_fields(spark):
    rules = R.RuleSet((R.Rule("one", "a.b", ("1", "2"), ("big",)), R.Rule("no", "x", (R.NULL,), (), ("big",)), R.Rule("differ", "p", other="q")), {"big": {"size": "10", "kind": "k"}}, {"kind": "k"})
    docs = ['{"size":10.0,"a":{"b":2}}', '{"size":1e1,"a":{"b":3},"x":1}', '{"size":9,"x":null}', '{"size":9,"x":"","p":"s","q":"s"}', '{"p":"s","q":"t"}', "{}", "bad"]
    got = sorted((r.id, r.rule) for r in R.violations(variants.leaves(spark.createDataFrame(list(enumerate(docs)), "id long, doc string"), "id", "doc"), "id", rules).collect())
    assert got == [(1, "one"), (3, "differ"), (3, "no")]


def test_documents_are_judged_in_their_own_rows(spark, tmp_path):
    rules = R.RuleSet((R.Rule("one", "a.b", ("1", "2"), ("big",)), R.Rule("no", "x", (R.NULL,), (), ("big",)), R.Rule("differ", "p", other="q")), {"big": {"size": "10", "kind": "k"}}, {"kind": "k"})
    docs = [
        '{"size":10.0,"a":{"b":2}}', '{"size":1e1,"a":{"b":3},"x":1}', '{"size":9,"x":null}', '{"size":9,"x":"","p":"s","q":"s"}', '{"p":"s","q":"t"}', "{}", "bad", None, '["{"]', ' \n{"x":{"y":1}}', '{"x":"{"}',
        '{"p":{"q":1},"q":{"q":1}}', '{"p":"{1","q":"{1"}',
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, doc string")
    made = R.violations_in(df, "id", "doc", rules)
    assert sorted((r.id, r.rule) for r in made.collect()) == sorted((r.id, r.rule) for r in R.violations(variants.leaves(df, "id", "doc"), "id", rules).collect()) == [(1, "one"), (3, "differ"), (3, "no"), (10, "no"), (12, "differ")]
    deep = '{"{":"}{\\"{","a":' * 6 + "[{}]" + "}" * 6
    df = spark.createDataFrame([(0, deep), (1, "{" * 50)], "id long, doc string")
    assert sorted((r.id, r.path) for r in variants.leaves(df, "id", "doc").collect()) == sorted([(0, "$"), (1, "$")] + [(0, "a." * k + m) for k in range(6) for m in ("{", "a")])
    for plan in (made, variants.folded(df, "id", "doc"), variants.schema_problems_in(variants.folded(df, "id", "doc"), "id", R.INFER_SCHEMA)):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
