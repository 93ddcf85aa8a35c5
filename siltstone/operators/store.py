"""A discovery index that is built once, stored, refreshed table by table, and read by every search.

Stored are, for each table, its value index and its profiles, and for all tables what pairs
of columns have in common (`values.similarities`), from which edges of every relation follow
by filters. Each build or refresh writes new folders and then a manifest that names the
folders in force; readers take the newest manifest, so a refresh that fails changes nothing.

A refresh indexes the changed tables only, and pairs are counted anew only over values that
a changed table holds.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import profiling, relations, values
from siltstone.plans.shared import open_writers
from siltstone.sources.catalog import Catalog

#: a change of what is stored changes this number, and older indexes are built again
FORMAT = 1


def state_of(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of the files below the paths: it changes when one is written anew."""
    seen = []
    for p in paths:
        fs, path = _files(spark, p)
        seen += sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(path)) if fs.exists(path) else [p]
    return hashlib.md5("\n".join(seen).encode()).hexdigest()


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("manifest-"))


@dataclass(frozen=True)
class Index:
    """What is stored, as DataFrames."""

    spark: SparkSession
    folder: str
    manifest: dict

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{x}" for x in sorted(self.manifest[kind].values())])

    @property
    def tables(self) -> list[str]:
        return sorted(self.manifest["values"])

    @property
    def values(self) -> DataFrame:
        """nid, source, column_name, value, cnt."""
        return self._read("values")

    @property
    def profiles(self) -> DataFrame:
        return self._read("profiles")

    @property
    def pairs(self) -> DataFrame:
        """Pairs of columns of different tables that share a value, as values.similarities gives them."""
        return self.spark.read.parquet(f"{self.folder}/{self.manifest['pairs']}")

    def edges(self, least: float = 0.7) -> DataFrame:
        """Content, inclusion and key edges of the stored pairs."""
        content = relations.as_edges(relations.content_similar(self.pairs, least), relations.CONTENT_SIM, "jaccard")
        inside = relations.as_edges(relations.inclusions(self.pairs), relations.INCLUSION, "containment", both_ways=False)
        keys = relations.as_edges(relations.keys(self.pairs), relations.PKFK, "weight", both_ways=False)
        return content.unionByName(inside).unionByName(keys)


def open_index(spark: SparkSession, folder: str) -> Index:
    """The newest index in the folder."""
    found = _manifests(spark, folder)
    if not found:
        raise LookupError(f"no index in {folder}")
    fs, path = _files(spark, found[-1])
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    manifest = json.loads(text)
    if manifest["format"] != FORMAT:
        raise LookupError(f"the index in {folder} has format {manifest['format']}, not {FORMAT}")
    return Index(spark, folder, manifest)


def _publish(spark: SparkSession, folder: str, manifest: dict) -> Index:
    number = len(_manifests(spark, folder)) + 1
    # written under another name and then renamed, so that no reader sees a part of it
    fs, path = _files(spark, f"{folder}/.manifest-{uuid.uuid4().hex}")
    stream = fs.create(path)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    if not fs.rename(path, _files(spark, f"{folder}/manifest-{number:08d}.json")[1]):
        raise RuntimeError(f"another build of {folder} was published at the same time")
    return Index(spark, folder, manifest)


def _store(df: DataFrame, folder: str, name: str) -> str:
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return name


def _pairs_of(index: DataFrame, changed: Sequence[str], old: DataFrame | None) -> DataFrame:
    """Pairs of which a changed table has a side are counted over its values; the other pairs stay."""
    if old is None:
        return values.similarities(index, written=True)
    mine = F.col("source").isin(list(changed))
    touched = index.join(index.filter(mine).select("value").distinct(), "value", "left_semi")
    fresh = values.similarities(touched, written=True, sizes_of=index)
    of_changed = F.col("source1").isin(list(changed)) | F.col("source2").isin(list(changed))
    return fresh.filter(of_changed).unionByName(old.filter(~of_changed))


def build(catalog: Catalog, folder: str, with_profiles: bool = True) -> Index:
    """Index every table of the catalog."""
    return _index(catalog, folder, list(catalog.tables), None, with_profiles)


def refresh(catalog: Catalog, folder: str, changed: Sequence[str]) -> Index:
    """Index the changed tables again (those that the catalog lacks are dropped); all others stay as they are."""
    spark = next(iter(catalog.tables.values())).sparkSession
    old = open_index(spark, folder)
    return _index(catalog, folder, list(changed), old, "profiles" in old.manifest)


def _index(catalog: Catalog, folder: str, changed: list[str], old: Index | None, with_profiles: bool) -> Index:
    spark = next(iter(catalog.tables.values())).sparkSession
    run = uuid.uuid4().hex
    present = [t for t in changed if t in catalog.tables]
    manifest = {"format": FORMAT, "values": dict(old.manifest["values"]) if old else {}}
    if with_profiles:
        manifest["profiles"] = dict(old.manifest["profiles"]) if old else {}
    for kinds in (manifest["values"], manifest.get("profiles", {})):
        for t in changed:
            kinds.pop(t, None)
    if present:
        part = Catalog({t: catalog.tables[t] for t in present}, catalog.db)
        # one write of all tables, a folder for each
        with open_writers(spark, len(present)):
            values.column_values(part).withColumn("t", F.col("source")).write.partitionBy("t").option("compression", "zstd").parquet(f"{folder}/values-{run}")
        fs, path = _files(spark, f"{folder}/values-{run}")
        written = {s.getPath().getName()[2:] for s in fs.listStatus(path)}
        manifest["values"] |= {t: f"values-{run}/t={t}" for t in present if t in written}  # a table without cells has no folder
        if with_profiles:
            profiling.profile(part).withColumn("t", F.col("source")).write.partitionBy("t").option("compression", "zstd").parquet(f"{folder}/profiles-{run}")
            manifest["profiles"] |= {t: f"profiles-{run}/t={t}" for t in present}
    index = Index(spark, folder, manifest)
    manifest["pairs"] = _store(_pairs_of(index.values, changed, old.pairs if old else None), folder, f"pairs-{run}")
    return _publish(spark, folder, manifest)
