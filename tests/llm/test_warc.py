import gzip
import hashlib

import pytest

from quillstone.llm import warc
from quillstone.llm.common import scratch

LONG = "x" * 1000


def _written(spark, rows, schema="page_id long, url string, html string"):
    path = scratch(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, schema), path)
    return path


def _captures(spark, path):
    return warc.resolve_revisits(warc.assemble(warc.read_warc(spark, path)))


def _brief(spark, path):
    got = []
    for c in _captures(spark, path).collect():
        page = lambda m: int(m[0]["fields"]["page_id"]) if m and "page_id" in m[0]["fields"] else None
        got.append((page(c["metadata"]), c["payload_bytes"], c["payload_sha1"], c["kind"], page(c["referred"])))
    return sorted(got, key=str)


def _expect(rows):
    """What the contract says, row by row."""
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        owner = max((p if p is not None else -1) for p, _, h in rows if (h or "") == (html or ""))
        owner = None if owner < 0 else owner
        again = len(raw) >= 1000 and page != owner
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [
        (1, "http://a/x?q=1", LONG), (2, "http://b/", LONG), (7, "http://c", LONG), (3, "http://a/x", LONG + "é"), (4, "u", "short"), (5, "u", "short"),
        (6, None, None), (8, "http://a b\r\nX: 1", ""), (None, "http://n", LONG), (9, "not a url %%", "é" * 500), (10, "http://d", "é" * 500),
        (11, "http://long", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 3000), (12, "http://e", "\0\x01\r\n\r\n"), (13, "http://e", "\r\n\r\nWARC/1."),
    ]
    assert _brief(spark, _written(spark, rows)) == _expect(rows)


def test_shuffled_owners(spark):
    rows = [(k, f"http://h/{k}", LONG if k % 3 else LONG + str(k % 4)) for k in range(60)]
    path = scratch(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, few=0)
    assert _brief(spark, path) == _expect(rows)


def test_repeated_and_tied_rows(spark):
    # rows that tie for the largest page_id are all responses; each row gives a row
    rows = [(5, "http://a", LONG)] * 3 + [(5, "http://b", LONG), (1, "http://a", LONG), (None, None, LONG)]
    got = _brief(spark, _written(spark, rows))
    assert [g[3] for g in got if g[0] == 5] == ["response"] * 4
    assert [(g[3], g[4]) for g in got if g[0] != 5] == [("revisit", 5)] * 2 and {g[1] for g in got} == {1000}


def test_empty_and_extra_columns(spark):
    assert _brief(spark, _written(spark, [])) == []
    rows = [(1, "http://a", LONG, "s", 3), (2, "http://b", LONG, "t", 4)]
    got = _brief(spark, _written(spark, rows, "page_id long, url string, html string, sha256 string, owner int"))
    assert got == _expect([r[:3] for r in rows])


def _raw(kind, name, block, **fields):
    lines = [f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}"] + [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()]
    return ("\r\n".join(lines) + f"\r\ncontent-length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_archive(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n" + b"WARC/1.0\r\n\r\nWARC/1.1 \xff\xfe\r\n\r\n"
    whole = [
        _raw("warcinfo", "<i>", b"software: x\r\n"),
        _raw("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<r>", Content_Type="application/http;msgtype=request"),
        _raw("response", "<r>", http, Content_Type="application/http", WARC_Target_URI="http://x/"),
        _raw("metadata", "<m>", b"a: 1\r\nb: two\r\n", warc_concurrent_to="<q>", Content_Type="application/warc-fields"),  # hangs on the request
        _raw("resource", "<s>", b"plain", WARC_Concurrent_To="<n>"),  # the capture names its part
        _raw("metadata", "<n>", b"", Content_Type="application/warc-fields"),
        _raw("request", "<lost>", b"", WARC_Concurrent_To="<absent>"),
        _raw("revisit", "<v>", b"", WARC_Refers_To="<gone>"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, whole)))
    rows = {r["capture_id"]: r for r in _captures(spark, str(tmp_path)).collect()}
    assert set(rows) == {"<r>", "<s>", "<lost>", "<v>"}
    names = lambda c, k: [p["record_id"] for p in rows[c][k]]
    assert (names("<r>", "requests"), names("<r>", "metadata"), names("<s>", "metadata")) == (["<q>"], ["<m>"], ["<n>"])
    assert rows["<r>"]["metadata"][0]["fields"] == {"a": "1", "b": "two"}
    body = http.partition(b"\r\n\r\n")[2]
    assert (rows["<r>"]["payload_bytes"], rows["<r>"]["payload_sha1"]) == (len(body), hashlib.sha1(body).hexdigest())
    assert rows["<lost>"]["kind"] is None and names("<lost>", "requests") == ["<lost>"]
    assert rows["<v>"]["payload_bytes"] is None and rows["<v>"]["requests"] == []
    blocks = {r["record_id"]: bytes(r["block"]) for r in warc.read_warc(spark, str(tmp_path), keep_block=True).collect()}
    assert blocks["<r>"] == http and blocks["<s>"] == b"plain" and len(blocks) == 8


@pytest.mark.parametrize("damage", ["digest", "short"])
def test_damaged_archive_is_an_error(spark, tmp_path, damage):
    wrong = "sha1:" + "0" * 40
    raw = _raw("resource", "<r>", b"body", WARC_Payload_Digest=wrong) if damage == "digest" else _raw("resource", "<r>", b"body")[:-6]
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(raw))
    with pytest.raises(Exception, match="stated|ends inside"):
        warc.read_warc(spark, str(tmp_path)).collect()
