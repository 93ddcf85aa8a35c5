"""A collection of tables without declared relationships, and the readers that fill it."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.cells import SCALAR


class Attribute(NamedTuple):
    nid: int
    source: str
    column_name: str
    kind: T.DataType


def column_id(db: str, source: str, column: str) -> int:
    """CRC-32 of the concatenated names, unsigned; F.crc32 gives the same."""
    return zlib.crc32(f"{db}{source}{column}".encode())


@dataclass
class Catalog:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    db: str = "lake"

    def add(self, name: str, table: DataFrame) -> Catalog:
        self.tables[name] = table
        return self

    def attributes(self) -> Iterator[Attribute]:
        """Scalar columns; nested ones have no cells to index."""
        for source, df in self.tables.items():
            for f in df.schema.fields:
                if isinstance(f.dataType, SCALAR):
                    yield Attribute(column_id(self.db, source, f.name), source, f.name, f.dataType)

    def metadata(self, spark: SparkSession) -> DataFrame:
        rows = [(a.nid, self.db, a.source, a.column_name, a.kind.simpleString()) for a in self.attributes()]
        return spark.createDataFrame(rows, "nid long, db string, source string, column_name string, kind string")


def parquet_tables(spark: SparkSession, folder: str, names: list[str]) -> Catalog:
    return Catalog({n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})


def csv_relation(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None, multiline: bool = True) -> DataFrame:
    """A file with a header as strings; rows whose number of cells differs from the header's are dropped."""
    return csv_with_rejects(spark, path, sep, schema, multiline)[0]


def csv_with_rejects(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None, multiline: bool = True, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The well-formed rows, and the raw text of the others. Files whose quoted cells hold no newlines can be read with
    multiline=False, which splits a large file over tasks."""
    options = {"header": header, "sep": sep, "quote": '"', "escape": '"', "multiLine": multiline}
    known = schema or spark.read.options(**options).csv(path).schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in known.fields])
    marked = T.StructType([*text.fields, T.StructField("_malformed", T.StringType())])
    rows = spark.read.options(**options, columnNameOfCorruptRecord="_malformed", mode="PERMISSIVE").schema(marked).csv(path)
    # whether a row is malformed depends on all its cells, so every query on it reads all of them: always true, but not to the optimizer
    whole = F.hash(*[F.col(f"`{f.name}`") for f in text.fields]) >= -(2**31)
    good, bad = rows.filter(F.col("_malformed").isNull() & whole), rows.filter(F.col("_malformed").isNotNull() & whole)
    return good.drop("_malformed"), bad.select("_malformed")


def _list_files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, path), through Hadoop so that every store works."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(path)]
    return sorted(x for x in found if not x[0].startswith(("_", ".")))


def csv_folder(spark: SparkSession, config: dict) -> Catalog:
    """Every file of a folder is a relation, named without its extension."""
    out = Catalog(db=config.get("db", "lake"))
    for name, path in _list_files(spark, config["path"]):
        out.add(name.removesuffix(".csv"), csv_relation(spark, path, config.get("separator", ","), multiline=config.get("multiline", True)))
    return out


def parquet_folder(spark: SparkSession, config: dict) -> Catalog:
    out = Catalog(db=config.get("db", "lake"))
    for name, path in _list_files(spark, config["path"]):
        out.add(name.removesuffix(".parquet"), spark.read.parquet(path))
    return out


# URL forms and the queries that list tables.
JDBC_URLS = {
    "postgres": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "oracle": "jdbc:oracle:thin:@{host}:{port}:{database}",
}
JDBC_TABLES = {
    "oracle": "SELECT table_name FROM all_tables WHERE owner = '{schema}'",
    "": "SELECT table_name FROM information_schema.tables WHERE table_schema = '{schema}'",
}
# End of fixed values.


def jdbc_tables(spark: SparkSession, config: dict) -> Catalog:
    """All tables of a schema, or those named; a partition column spreads a large table over tasks."""
    kind = config["type"]
    read = spark.read.format("jdbc").option("url", JDBC_URLS[kind].format(**config)).option("fetchsize", config.get("fetchsize", 1000))
    for name in ("user", "password", "driver"):
        if name in config:
            read = read.option(name, config[name])
    names = config.get("tables")
    if not names:
        listing = JDBC_TABLES.get(kind, JDBC_TABLES[""]).format(schema=config.get("schema", "public").replace("'", "''"))
        names = [r[0] for r in read.option("query", listing).load().collect()]  # metadata
    out = Catalog(db=config.get("db", config["database"]))
    for name in names:
        part = config.get("partition", {}).get(name, {})
        out.add(name, read.options(**part).option("dbtable", name).load())
    return out


def warehouse_tables(spark: SparkSession, config: dict) -> Catalog:
    """Tables of the session's metastore."""
    db = config.get("database", "default")
    names = config.get("tables") or [t.name for t in spark.catalog.listTables(db)]
    return Catalog({n: spark.table(f"{db}.{n}") for n in names}, db)


READERS: dict[str, Callable[[SparkSession, dict], Catalog]] = {"csv": csv_folder, "parquet": parquet_folder, "hive": warehouse_tables, **dict.fromkeys(JDBC_URLS, jdbc_tables)}


def register_reader(kind: str, reader: Callable[[SparkSession, dict], Catalog]) -> None:
    READERS[kind] = reader


def load_sources(spark: SparkSession, specs: list[dict]) -> dict[str, Catalog]:
    """specs: name, type, config, as a sources file lists them."""
    return {s["name"]: READERS[s["type"]](spark, {"db": s["name"], "type": s["type"], **s["config"]}) for s in specs}


def read_sources_file(path: str) -> list[dict]:
    import yaml

    with open(path) as f:
        return (yaml.safe_load(f) or {}).get("sources", [])


def pruned_sample(table: DataFrame, name: str, columns: list[str], n: int | None = None) -> DataFrame:
    """The columns as normalised text, named table.column; with n, the n rows of least hash (the same ones in every run)."""
    from siltstone.functions.cells import cell_text, normal

    kinds = {f.name: f.dataType for f in table.schema.fields}
    out = table.select(*[normal(cell_text(F.col(f"`{c}`"), kinds[c])).alias(f"{name}.{c}") for c in columns])
    if n is None:
        return out
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{name}.{c}`"), F.lit("\x00")) for c in columns])
    return out.withColumn("_h", F.md5(row)).orderBy("_h").limit(n).drop("_h")
