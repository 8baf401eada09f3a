"""Manifests: a table that is made of many folders has a small JSON file for each of its versions.

A version is there once its file is: it is written beside and renamed, so readers see a whole version or the one before.
Folders are written before the version that names them and never changed after, so a writer that is lost leaves folders
that no version names; ``vacuum`` deletes those, and what only older versions name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: Versions that ``vacuum`` keeps: readers of the last but one may still run.
KEPT = 2


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    system, place = _files(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def removed(spark: SparkSession, path: str) -> None:
    system, place = _files(spark, path)
    system.delete(place, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[1:-5]) for n in listed(spark, f"{path}/manifest") if n.startswith("v") and n.endswith(".json")]


def read(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The content of a version, the last one if none is named; without any, nothing."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return {}
        version = known[-1]
    return json.loads(spark.read.text(f"{path}/manifest/v{version:010d}.json", wholetext=True).first()[0])


def commit(spark: SparkSession, path: str, content: dict) -> dict:
    """Writes the version after ``content``'s own; a second writer of it is an error."""
    content = content | {"version": content.get("version", 0) + 1}
    system, place = _files(spark, f"{path}/manifest/v{content['version']:010d}.json")
    if system.exists(place):
        raise RuntimeError(f"version {content['version']} of {path} is there already: another writer has been here")
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/.{uuid.uuid4().hex}")
    out = system.create(beside, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if not system.rename(beside, place):
        raise RuntimeError(f"version {content['version']} of {path} can't be written")
    return content


def vacuum(spark: SparkSession, path: str, folders: dict[str, set[str]]) -> list[str]:
    """Deletes versions but the last ``KEPT``, and of each kind of folder those not named in ``folders``; returns what went."""
    gone = []
    for version in versions(spark, path)[:-KEPT]:
        removed(spark, f"{path}/manifest/v{version:010d}.json")
    for kind, named in folders.items():
        for name in listed(spark, f"{path}/{kind}"):
            if name not in named:
                removed(spark, f"{path}/{kind}/{name}")
                gone.append(f"{kind}/{name}")
    return gone


def kept_versions(spark: SparkSession, path: str) -> list[dict]:
    return [read(spark, path, v) for v in versions(spark, path)[-KEPT:]]
