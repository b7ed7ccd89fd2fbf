"""WARC archives: pages written as transactions of records, read back and assembled into captures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import cut, lean, scratch

# Fixed values of the WARC format.
VERSION = "WARC/1."
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRIMARY = ("response", "revisit", "resource")

RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "content_type string, fields map<string,string>, payload_bytes long, payload_sha1 string"
)
_BLOCK = ", block binary"


def _urn(*parts: Column) -> Column:
    """A record's name: a UUID made from what identifies it, the same on every run."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: str | Column, record_id: Column, fields: dict[str, Column], content_type: str, block: Column) -> Column:
    """The text of one record without its end; a field whose value is null is left out.

    The text is a string to Spark but may hold any bytes, as nothing decodes it.
    """
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind), F.lit("\r\nWARC-Record-ID: "), record_id]
    for name, value in fields.items():
        lines.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
    lines.append(F.concat(F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(RECORD_END)))
    return F.concat(*lines, block)


def one_line(c: Column) -> Column:
    """A value as it can stand in a header: blanks and controls percent-encoded."""
    for code in (*range(33), 127):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return c


def payload_owners(rows: DataFrame, least: int) -> DataFrame:
    """Rows (sha256, owner struct<page_id, url>) of payloads of `least` bytes or more that several rows share."""
    shared = rows.where(F.col("bytes") >= least).groupBy("sha256").agg(F.max(F.struct("page_id", "url")).alias("owner"), F.count("*").alias("n"))
    return shared.where("n > 1").drop("n")


def write_warc(pages: DataFrame, path: str, least: int = 1000, date: str = "2000-01-01T00:00:00Z", few: int = 100_000) -> None:
    """Write `pages(page_id, url, html)` as gzip archives: request, response or revisit, and metadata for each row.

    Rows of equal payloads of at least `least` bytes share one: that of the largest page_id is a
    response, the others revisit it and have no payload of their own. Rows that tie for that
    page_id are all responses, and the largest url's is the one referred to. A null html is an
    empty payload; null page_ids sort below all others; a null url leaves out the target. Other
    columns are not read. Record names follow from the row, so a task that runs again writes the same.

    Spark's text writer ends each record as the format asks and commits the archives task by task.
    Owners of shared payloads are broadcast if there are at most `few`, else payloads are shuffled.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")
    )
    rows = rows.withColumns({"sha256": F.sha2(F.col("html").cast("binary"), 256), "bytes": F.octet_length("html").cast("long")})
    owners = cut(payload_owners(rows, least))
    if owners.limit(few + 1).count() <= few:
        owners = F.broadcast(owners)
    rows = rows.join(owners, "sha256", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner.page_id"))
    named = lambda kind, page, url: _urn(F.lit(kind), page, url, F.col("sha256"))
    own = named("capture", F.col("page_id"), F.col("url"))
    target = one_line(F.col("url"))
    place, host = (F.coalesce(F.try_parse_url(target, F.lit(part)), F.lit("")) for part in ("PATH", "HOST"))
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": target}
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(RECORD_END))
    digest = {"WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.sha1(F.col("html").cast("binary")))}
    response = _record("response", own, common | digest, "application/http;msgtype=response", F.concat(http, F.col("html")))
    refers = {"WARC-Refers-To": named("capture", F.col("owner.page_id"), F.col("owner.url")), "WARC-Profile": F.lit(REVISIT_PROFILE)}
    revisited = _record("revisit", own, common | digest | refers, "application/http;msgtype=response", http)
    request = _record(
        "request", named("request", F.col("page_id"), F.col("url")), common | {"WARC-Concurrent-To": own}, "application/http;msgtype=request",
        F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(RECORD_END)),
    )
    metadata = _record(
        "metadata", named("metadata", F.col("page_id"), F.col("url")), common | {"WARC-Concurrent-To": own}, "application/warc-fields",
        F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
    )
    text = F.explode(F.array(request, F.when(revisit, revisited).otherwise(response), metadata)).alias("value")
    rows.select(text).write.mode("errorifexists").option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, list[str]]:
    """Named fields of a header by lower-case name; folded lines continue the one before."""
    out: dict[str, list[str]] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name][-1] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out.setdefault(name, []).append(value.strip())
    return out


def parse_record(head: bytes, block: bytes, keep: bool) -> dict:
    """A row of RECORD from a record's header and block; a payload that its digest denies is an error."""
    f = _fields(head)
    one = lambda k: f[k][0] if k in f else None
    kind, content = one("warc-type"), one("content-type")
    payload = block
    if (content or "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    sha1 = hashlib.sha1(payload).hexdigest()
    stated = one("warc-payload-digest")
    if kind == "revisit":  # the payload is the referred record's
        size, sha1 = None, None
    else:
        size = len(payload)
        if stated and stated.lower().startswith("sha1:") and len(stated) == 45 and stated[5:].lower() != sha1:
            raise ValueError(f"{one('warc-record-id')}: payload digest {sha1}, stated {stated}")
    own = {k: v[0] for k, v in _fields(block).items()} if (content or "").startswith("application/warc-fields") else {}
    row = {
        "record_id": one("warc-record-id"), "type": kind, "target_uri": one("warc-target-uri"), "date": one("warc-date"),
        "concurrent_to": f.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "content_type": content,
        "fields": own, "payload_bytes": size, "payload_sha1": sha1,
    }
    return row | ({"block": block} if keep else {})


def records_of(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of each record of an archive that was split before every `WARC/1.`.

    A block that holds such a text was split too; its stated length tells, and the pieces are put together again.
    """
    gap = (RECORD_END + VERSION).encode()
    for chunk in chunks:
        chunk = chunk.removeprefix(VERSION.encode())
        if not chunk.strip():
            continue
        head, found, block = chunk.partition(RECORD_END.encode())
        while not found:  # the header's own end was taken for the next record's begin
            chunk += gap + next(chunks)
            head, found, block = chunk.partition(RECORD_END.encode())
        size = int(_fields(head).get("content-length", ["0"])[0])
        pieces, have = [block], len(block)
        while have < size:
            more = next(chunks, None)
            if more is None:
                raise ValueError(f"archive ends inside a record: {head[:200]!r}")
            pieces += [gap, more]
            have += len(gap) + len(more)
        yield head, b"".join(pieces)[:size]


def read_warc(spark: SparkSession, path: str, keep_block: bool = False) -> DataFrame:
    """Rows of RECORD of all archives under `path`, with `block binary` if `keep_block`.

    Each gzip archive, by record or as a whole, is read from its start by one task, record by
    record; a task holds one record at a time. Plain archives may be split, and a later split
    begins at the first `WARC/1.` after a record's end. An archive that ends inside a record, or
    a payload that differs from its stated SHA-1, is an error. Names of fields have no case.
    """
    schema = RECORD + (_BLOCK if keep_block else "")
    lines = spark.read.option("lineSep", RECORD_END + VERSION).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))
    arrow = {"record_id": pa.string(), "type": pa.string(), "target_uri": pa.string(), "date": pa.string(), "concurrent_to": pa.list_(pa.string()),
             "refers_to": pa.string(), "content_type": pa.string(), "fields": pa.map_(pa.string(), pa.string()), "payload_bytes": pa.int64(), "payload_sha1": pa.string()}
    shape = pa.schema(list(arrow.items()) + ([("block", pa.binary())] if keep_block else []))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None

        def chunks() -> Iterator[tuple]:
            for b in batches:
                yield from zip(b.column("file").to_pylist(), b.column("at").to_pylist(), b.column("value"))

        rest = chunks()
        ahead = next(rest, None)
        out: list[dict] = []
        held = 0
        while ahead is not None:
            place = ahead[:2]

            def same() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and ahead[:2] == place:
                    now, ahead = ahead[2].as_py(), next(rest, None)
                    yield now

            for head, block in records_of(same()):
                out.append(parse_record(head, block, keep_block))
                held += len(block) if keep_block else 200
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist([_mapped(r) for r in out], shape)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([_mapped(r) for r in out], shape)

    return lines.mapInArrow(lean(each), schema)


def _mapped(row: dict) -> dict:
    return row | {"fields": list(row["fields"].items())}


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture_id, target_uri, date, kind, refers_to, payload_bytes, payload_sha1, requests, metadata, others).

    A capture is a response, revisit or resource record with all records that name it in a
    concurrent-to field, that it names there, or that hang on those in the same way, of either
    direction and any length of chain. Records without such a capture make rows of their own,
    whose kind is null, one for each record that none of them hangs on. Records of one name count once in an array; a
    capture whose record is repeated is a row each time. warcinfo records are left out. The
    arrays hold (record_id, type, content_type, fields), ordered by name. Columns of `records`
    beside those of RECORD, such as blocks, are not carried: join them by record_id.
    """
    told = cut(records.where("type <> 'warcinfo'").select(*[c.split()[0] for c in RECORD.split(", ")]))
    primary = F.col("type").isin(*PRIMARY)
    links = told.select("record_id", F.explode("concurrent_to").alias("other")).distinct()
    links = cut(links.unionByName(links.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct())
    parts = told.where(~primary).select("record_id").distinct()
    # owner: the capture that a part hangs on; each round follows the links of the parts placed by the one before
    owned = told.where(primary).select(F.col("record_id").alias("owner"), "record_id").distinct()
    placed, new = None, owned
    while True:
        next_to = new.withColumnRenamed("record_id", "_at").join(links.withColumnRenamed("record_id", "_at"), "_at").select(F.col("other").alias("record_id"), "owner")
        next_to = next_to.join(parts, "record_id").distinct()
        if placed is not None:
            next_to = next_to.join(placed, ["record_id", "owner"], "left_anti")
        new = cut(next_to)
        if new.isEmpty():
            break
        placed = new if placed is None else cut(placed.unionByName(new))
    alone = parts if placed is None else parts.join(placed, "record_id", "left_anti")
    every = alone.select(F.col("record_id").alias("owner"), "record_id", F.lit(True).alias("lone"))
    if placed is not None:
        every = every.unionByName(placed.withColumn("lone", F.lit(False)))
    detail = told.where(~primary).groupBy("record_id").agg(F.min(F.struct("type", "content_type", F.map_entries("fields").alias("fields"))).alias("r"))
    listed = every.join(detail, "record_id").groupBy("owner", "lone").agg(F.sort_array(F.collect_list(F.struct("record_id", "r"))).alias("ps"))

    def of(kind: str | None) -> Column:
        picked = F.filter("ps", lambda p: p["r"]["type"].eqNullSafe(F.lit(kind)) if kind else ~F.coalesce(p["r"]["type"].isin("request", "metadata"), F.lit(False)))
        shown = F.transform(picked, lambda p: F.struct(p["record_id"].alias("record_id"), p["r"]["type"].alias("type"), p["r"]["content_type"].alias("content_type"), F.map_from_entries(p["r"]["fields"]).alias("fields")))
        return shown

    listed = cut(listed.select(F.col("owner").alias("capture_id"), "lone", of("request").alias("requests"), of("metadata").alias("metadata"), of(None).alias("others")))
    mains = told.where(primary).select(F.col("record_id").alias("capture_id"), "target_uri", "date", F.col("type").alias("kind"), "refers_to", "payload_bytes", "payload_sha1")
    captures = mains.join(listed.where("not lone").drop("lone"), "capture_id", "left")
    captures = captures.withColumns({c: F.coalesce(c, F.array().cast(listed.schema[c].dataType)) for c in ("requests", "metadata", "others")})
    return captures.unionByName(listed.where("lone").drop("lone"), allowMissingColumns=True)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """`captures` whose revisits have the payload's size and SHA-1 of the response they refer to, and `referred` metadata.

    A revisit of a record that isn't there keeps nulls.
    """
    revisits = captures.where("kind = 'revisit'").select(F.col("refers_to").alias("_id")).distinct()
    responses = captures.where("kind <> 'revisit'").join(revisits, F.col("capture_id") == F.col("_id"), "left_semi")
    known = responses.groupBy(F.col("capture_id").alias("_id")).agg(
        F.first("payload_bytes").alias("_bytes"), F.first("payload_sha1").alias("_sha1"), F.first("metadata").alias("referred")
    )
    out = captures.join(known, (F.col("refers_to") == F.col("_id")) & (F.col("kind") == "revisit"), "left")
    return out.withColumns({"payload_bytes": F.coalesce("payload_bytes", "_bytes"), "payload_sha1": F.coalesce("payload_sha1", "_sha1")}).drop("_id", "_bytes", "_sha1")


def op11_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    page = lambda c: F.element_at(F.get(F.col(c), 0)["fields"], "page_id").cast("long")
    captures = resolve_revisits(assemble(read_warc(spark, path)))
    return captures.where("kind is not null").select(
        page("metadata").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.when(F.col("kind") == "revisit", page("referred")).alias("refers_to"),
    )


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), s AS (
  SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
    max(page_id) OVER (PARTITION BY html) AS owner FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM s
"""
