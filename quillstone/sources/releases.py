"""Releases as folders: staged whole, published by a second step, and set right after a crash between them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.functions.hashing import tree_sha
from quillstone.sources.sinks import _fs, directory_index, write_once

RECORD, READBACK = "release.json", "readback.json"


class ReleaseError(ValueError):
    """A release that may not be written or published."""


def payload_sha(spark: SparkSession, path: str) -> str:
    """One digest over the payload's files."""
    return tree_sha(directory_index(spark, f"{path}/payload")).first()[0]


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(p) else None


def _write(spark: SparkSession, path: str, value: dict) -> None:
    write_once(spark, path, json.dumps(value, sort_keys=True).encode())


def record(spark: SparkSession, path: str) -> dict:
    """The record of a release whose payload is what it says; else ReleaseError."""
    found = _read(spark, f"{path}/{RECORD}")
    if found is None:
        raise ReleaseError(f"no release at {path}")
    if payload_sha(spark, path) != found["payload_sha256"]:
        raise ReleaseError("payload differs from the record")
    return found


def stage(parts: dict[str, DataFrame], path: str, release: str) -> dict:
    """Write a release's parts and its record beside `path`, hashed before the rename that makes them visible.

    A path that exists is refused; two runs at once write folders of their own, and one rename wins.
    """
    spark = next(iter(parts.values())).sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise ReleaseError(f"{path} exists")
    beside = f"{path.rstrip('/')}.incoming-{uuid.uuid4().hex}"
    try:
        for name, df in parts.items():
            df.write.parquet(f"{beside}/payload/{name}")
        found = {"release": release, "status": "staged", "publishable": False, "payload_sha256": payload_sha(spark, beside), "rows": {n: spark.read.parquet(f"{beside}/payload/{n}").count() for n in parts}}
        _write(spark, f"{beside}/{RECORD}", found)
        if fs.exists(target) or not fs.rename(_fs(spark, beside)[1], target):
            raise ReleaseError(f"{path} exists")
    finally:
        fs.delete(_fs(spark, beside)[1], True)
    return found


def publish(spark: SparkSession, path: str, compared: int, matched: bool, between: Callable[[], None] = lambda: None) -> dict:
    """Publish a staged release after a read-back of all its rows: the read-back is written first, then the record.

    `between` runs between the two, as a crash would. A partial read-back, a release that isn't
    staged or a changed payload is refused before anything is written.
    """
    found = record(spark, path)
    if found["status"] != "staged":
        raise ReleaseError(f"only a staged release can be published, this one is {found['status']}")
    if not matched or compared != sum(found["rows"].values()):
        raise ReleaseError("partial read-back")
    _write(spark, f"{path}/{READBACK}", {"compared": compared, "matched": matched, "payload_sha256": found["payload_sha256"]})
    between()
    return _finish(spark, path, found)


def _finish(spark: SparkSession, path: str, found: dict) -> dict:
    done = found | {"status": "published", "publishable": True}
    _write(spark, f"{path}/{RECORD}", done)
    return done


def recover(spark: SparkSession, parent: str) -> dict[str, str]:
    """Set right what crashes left under `parent`: path to what was done.

    A folder still coming in is removed; a staged release whose read-back stands beside it, whole
    and of its payload, is published; with any other read-back it goes back to staged.
    """
    fs, folder = _fs(spark, parent)
    out = {}
    for status in fs.listStatus(folder):
        path, name = status.getPath().toString(), status.getPath().getName()
        if ".incoming-" in name:
            fs.delete(status.getPath(), True)
            out[name] = "removed"
            continue
        found, back = _read(spark, f"{path}/{RECORD}"), _read(spark, f"{path}/{READBACK}")
        if found is None or found["status"] != "staged" or back is None:
            continue
        whole = back["matched"] and back["compared"] == sum(found["rows"].values()) and back["payload_sha256"] == found["payload_sha256"]
        if whole and payload_sha(spark, path) == found["payload_sha256"]:
            _finish(spark, path, found)
            out[name] = "published"
        else:
            fs.delete(_fs(spark, f"{path}/{READBACK}")[1], False)
            out[name] = "staged"
    return out
