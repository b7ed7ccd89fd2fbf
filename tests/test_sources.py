import io
import json
import tarfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from quillstone.sources import configs, jsonl, sinks, textgrid, wav
from quillstone.streaming import logs

SCHEMA = StructType().add("id", StringType()).add("n", LongType()).add("split", StringType())


def wav_bytes(samples, rate=16000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def test_jsonl(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id": "a", "n": 1, "split": "val"}\n\n{"id": "b", "split": "train", "more": null}\n')
    bad.write_text('{"id": "a"}\n[1]\n{"id": \n')
    rows = jsonl.read_strict(spark, str(good), SCHEMA)
    assert {(r.id, r.n, r._line) for r in rows.collect()} == {("a", 1, 1), ("b", None, 3)}
    assert [(r._line, r.fields) for r in jsonl.unknown_fields(rows, SCHEMA.names).collect()] == [(3, ["more"])]
    _, problems = jsonl.read_lenient(spark, str(good), SCHEMA, split="val")
    assert [(r._line, r.problem) for r in problems.collect()] == [(3, "split_mismatch")]
    with pytest.raises(jsonl.SourceError, match="not_object"):
        jsonl.read_strict(spark, str(bad), SCHEMA)


def test_transcript_index_and_lock(spark, tmp_path):
    (tmp_path / "t.txt").write_text("u1 你 好\nu2 天\t地\nu1 再　见\nu3\n")
    got = {r.utterance_id: r.text for r in jsonl.read_transcript(spark, str(tmp_path / "t.txt")).collect()}
    assert got == {"u1": "再见", "u2": "天地", "u3": ""}
    (tmp_path / "a.json").write_text(json.dumps({"files": [{"name": "x", "sha256": "1"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"files": {"y": "2"}}))
    assert [tuple(r) for n in "ab" for r in jsonl.read_sha_index(spark, str(tmp_path / f"{n}.json")).collect()] == [("x", "1"), ("y", "2")]
    (tmp_path / "lock").write_text("# schema: s\n# verify: torch==2\n# note\nnumpy==1.0\n")
    pins = jsonl.read_lock(spark, str(tmp_path / "lock"), "s")
    got = jsonl.compare_pins(pins, spark.createDataFrame([("numpy", "1.0")], "name string, version string"))
    assert {(r.kind, r.name, r.match) for r in got.collect()} == {("verify", "torch", False), ("install", "numpy", True)}
    with pytest.raises(ValueError):
        jsonl.read_lock(spark, str(tmp_path / "lock"), "other")


LONG = """File type = "ooTextFile"
Object class = "TextGrid"

xmin = 0
xmax = 3
tiers? <exists>
size = 2
item []:
    item [1]:
        class = "IntervalTier"
        name = "SPK1 "
        xmin = 0
        xmax = 3
        intervals: size = 2
        intervals [1]:
            xmin = 0
            xmax = 1.5
            text = "你""好"
        intervals [2]:
            xmin = 1.5
            xmax = 3
            text = ""
    item [2]:
        class = "TextTier"
        name = "p"
        xmin = 0
        xmax = 3
        points: size = 1
        points [1]:
            number = 1
            mark = "x"
"""
SHORT = '"ooTextFile"\n"TextGrid"\n0\n3\n<exists>\n2\n"IntervalTier"\n"SPK1 "\n0\n3\n2\n0\n1.5\n"你""好"\n1.5\n3\n""\n"TextTier"\n"p"\n0\n3\n1\n1\n"x"\n'


def test_textgrid(spark, tmp_path):
    want = [(0, "SPK1", 0, 0.0, 1.5, '你"好'), (0, "SPK1", 1, 1.5, 3.0, "")]
    for text in (LONG, SHORT):
        for name in ("utf-8", "utf-8-sig", "utf-16", "gb18030"):
            assert textgrid.intervals_of(text.encode(name)) == want
    (tmp_path / "a.TextGrid").write_bytes(SHORT.encode())
    (tmp_path / "b.TextGrid").write_bytes(SHORT.encode()[:60])
    rows = textgrid.read_textgrids(spark, str(tmp_path)).collect()
    assert sum(r.problem is None for r in rows) == 2 and sum(r.problem is not None for r in rows) == 1


def test_wav(spark, tmp_path):
    assert wav.stats_of(wav_bytes([0, 32767, -32768, 5])) | {"duration_seconds": 0} == {"format_ok": True, "format_problem": None, "channels": 1, "sample_width": 2, "sample_rate": 16000, "duration_seconds": 0, "clipped_samples": 2}
    assert wav.stats_of(b"junk")["format_problem"] == "bad_wav" and wav.stats_of(wav_bytes([0], 8000))["format_problem"] == "bad_format"
    (tmp_path / "a.wav").write_bytes(wav_bytes([16384] * 16))
    (tmp_path / "b.wav").write_bytes(b"x" * 60)
    (tmp_path / "c.wav").write_bytes(b"RIFF")
    rows = wav.wavs(spark, str(tmp_path)).select(F.substring_index("path", "/", -1).alias("p"), wav.wav_problem(F.col("length"), F.col("content")).alias("w"), wav.pcm_samples("content").alias("x")).collect()
    assert {r.p: r.w for r in rows} == {"a.wav": None, "b.wav": "header", "c.wav": "short"}
    assert {r.p: r.x for r in rows}["a.wav"] == [0.5] * 16


def test_archive_catalog(spark, tmp_path):
    def tar(files, mode="w:gz"):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=mode) as t:
            for name, body in files.items():
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
        return out.getvalue()

    inner = tar({"train/S0002/BAC009S0002W0001.wav": wav_bytes([1] * 1600), "train/S0002/BAC009S0002W0002.wav": b"bad"})
    (tmp_path / "all.tar.gz").write_bytes(tar({"data/wav/S0002.tar.gz": inner}))
    got = wav.catalog(spark, str(tmp_path))
    assert {(r.utterance_id, r.speaker_id, r.official_split, r.format_ok) for r in got.collect()} == {("BAC009S0002W0001", "S0002", "train", True), ("BAC009S0002W0002", "S0002", "train", False)}
    assert {(r.what, r.name, r.n) for r in wav.catalog_summary(got).collect()} == {("split", "train", 2), ("problem", "bad_wav", 1)}


def test_configs():
    spec = {"seed": configs.Field(int, 0, 10), "rate": configs.Field(float, 0), "sub": {"mode": configs.Field(str, choices=("a", "b"))}}
    ok = {"seed": 1, "rate": 0.5, "sub": {"mode": "a"}}
    assert configs.validate(ok, spec) == ok and len(configs.load(json.dumps(ok), spec)[1]) == 64
    for bad in ({**ok, "x": 1}, {**ok, "seed": True}, {**ok, "seed": 11}, {**ok, "rate": float("nan")}, {**ok, "sub": {"mode": "c"}}, {"rate": 1}):
        with pytest.raises(ValueError):
            configs.validate(bad, spec)
    assert configs.semantic_hash({**ok, "paths": "a"}) == configs.semantic_hash({**ok, "resume": True})


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", "val", None), ("a", "train", "你")], "sample_id string, split string, text string")
    sinks.publish({"rows": rows}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 2 and not (tmp_path / "out.staging").exists()
    with pytest.raises(FileExistsError):
        sinks.publish({"rows": rows}, str(tmp_path / "out"))
    with pytest.raises(Exception):
        sinks.publish({"rows": rows, "bad": rows.select(F.raise_error(F.lit("no")))}, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() and not (tmp_path / "none.staging").exists()
    sinks.write_splits(rows, str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits")).where("split = 'val'").count() == 1
    sinks.write_jsonl(rows.coalesce(1), str(tmp_path / "j"))
    assert any('"text":null' in p.read_text() for p in (tmp_path / "j").glob("part-*"))
    (tmp_path / "x").mkdir(), (tmp_path / "y").mkdir()
    (tmp_path / "x/f").write_text("1"), (tmp_path / "y/f").write_text("2"), (tmp_path / "y/g").write_text("3")
    assert {(r.name, r.problem) for r in sinks.copy_problems(spark, str(tmp_path / "x"), str(tmp_path / "y")).collect()} == {("f", "sha256"), ("g", "extra")}
    made = []
    build = lambda: made.append(1) or rows
    assert [sinks.cached(spark, str(tmp_path / "c"), "k", 1, build).count() for _ in range(2)] == [2, 2] and made == [1]
    assert "| a |" in sinks.markdown(rows.select("sample_id"), "t", ["sample_id"])


def test_resume(spark):
    wanted = spark.createDataFrame([(i, f"s{i}") for i in range(1, 6)], "_line long, k string")
    assert {r._line for r in logs.remaining(wanted, wanted.where("_line <= 2"), "k").collect()} == {3, 4, 5}
    assert logs.remaining(wanted, wanted.where("_line < 0"), "k").count() == 5
    for done in (wanted.where("_line = 2"), wanted.where("_line = 1").withColumn("k", F.lit("x"))):
        with pytest.raises(logs.ResumeError):
            logs.remaining(wanted, done, "k")
    got = logs.isolate(wanted, "_line", "k", lambda x: str(10 // (int(x[1:]) - 3))).orderBy("_line").collect()
    assert [r.error_type for r in got] == [None, None, "ZeroDivisionError", None, None]


def test_stream_reaches_the_batch_result(spark, tmp_path):
    rows = [(i, f"2024-01-01T0{i % 5}:10:00") for i in range(40)]
    df = spark.createDataFrame(rows, "n long, at string").withColumn("ts", F.col("at").cast("timestamp")).drop("at")
    for k in range(3):
        logs.append(df.where(F.col("n") % 3 == k).coalesce(1), str(tmp_path / "in"))
    stream = logs.watch(spark, str(tmp_path / "in"), df.schema, per_trigger=1)
    out = logs.windowed(stream, "ts", "1 hour", [], F.count("*").alias("n"), late="2 days")
    q = out.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.window.start, r.n) for r in logs.windowed(df, "ts", "1 hour", [], F.count("*").alias("n")).collect()}
    assert {(r.window.start, r.n) for r in spark.table("hours").collect()} == want
    sync = logs.sync_every(logs.watch(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "synced"), str(tmp_path / "cp2")).trigger(availableNow=True).start()
    sync.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "synced")).count() == 40


def test_one_file_is_written_whole(spark, tmp_path):
    path = tmp_path / "latest.json"
    for data in (b'{"step": 1}', b'{"step": 20}'):
        sinks.write_once(spark, str(path), data)
        assert path.read_bytes() == data
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["latest.json"]
