"""python -m siltstone.cli: keep a file of sources, profile what it names, and build, refresh and ask a stored index."""

from __future__ import annotations

import argparse

from siltstone.sources.catalog import JDBC_URLS, load_sources, read_sources_file


def _write(path: str, sources: list[dict]) -> None:
    import yaml

    with open(path, "w") as f:
        yaml.safe_dump({"sources": sources}, f, sort_keys=False)


def _add(path: str, source: dict) -> None:
    kept = [s for s in read_sources_file(path) if s["name"] != source["name"]]
    _write(path, [*kept, source])


def _ask(args: argparse.Namespace) -> None:
    """The commands on a stored index: one for each named source of a file, or one that is read."""
    from pyspark.sql import SparkSession

    from siltstone.operators import graph, store, textsearch

    spark = SparkSession.builder.getOrCreate()
    if args.command in ("build", "refresh"):
        for name, lake in load_sources(spark, read_sources_file(args.file)).items():
            folder = f"{args.index}/{name}"
            made = store.build(lake, folder) if args.command == "build" else store.refresh(lake, folder, args.tables)
            print(name, len(made.tables), "tables")
        return
    index = store.open_index(spark, args.index)
    if args.command == "search":
        for r in textsearch.search(index.values, args.words, args.domain, args.limit).collect():
            print(f"{r.source}.{r.column_name}", r.score)
    elif args.command == "neighbors":
        found = graph.neighbors(index.edges(), spark.createDataFrame([(args.column,)], "node string"), args.relation)
        for r in found.orderBy("relation", "node").collect():
            print(r.relation, r.node, round(r.weight, 6))
    else:
        for r in graph.shortest_paths(index.edges(), args.start, args.target).orderBy("path").collect():
            print(" > ".join(r.path))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("create", "list"):
        sub.add_parser(name).add_argument("file")
    p = sub.add_parser("add-csv")
    for a in ("file", "name", "path"):
        p.add_argument(a)
    p.add_argument("--separator", default=",")
    p = sub.add_parser("add-database")
    for a in ("file", "name"):
        p.add_argument(a)
    p.add_argument("type", choices=sorted(JDBC_URLS))
    for a in ("host", "port", "database"):
        p.add_argument(a)
    p.add_argument("--schema", default="public")
    p.add_argument("--user")
    p = sub.add_parser("profile")
    for a in ("file", "output"):
        p.add_argument(a)
    p = sub.add_parser("build")
    for a in ("file", "index"):
        p.add_argument(a)
    p = sub.add_parser("refresh")
    for a in ("file", "index"):
        p.add_argument(a)
    p.add_argument("tables", nargs="+")
    p = sub.add_parser("search")
    for a in ("index", "words"):
        p.add_argument(a)
    p.add_argument("--domain", default="content", choices=("content", "schema", "table"))
    p.add_argument("--limit", type=int, default=10)
    p = sub.add_parser("neighbors")
    for a in ("index", "column"):
        p.add_argument(a)
    p.add_argument("--relation")
    p = sub.add_parser("paths")
    for a in ("index", "start", "target"):
        p.add_argument(a)
    args = parser.parse_args(argv)
    if args.command == "create":
        _write(args.file, [])
    elif args.command == "list":
        for s in read_sources_file(args.file):
            print(s["name"], s["type"], s["config"])
    elif args.command == "add-csv":
        _add(args.file, {"name": args.name, "type": "csv", "config": {"path": args.path, "separator": args.separator}})
    elif args.command == "add-database":
        config = {"host": args.host, "port": args.port, "database": args.database, "schema": args.schema}
        _add(args.file, {"name": args.name, "type": args.type, "config": config | ({"user": args.user} if args.user else {})})
    elif args.command != "profile":
        _ask(args)
    else:
        from pyspark.sql import SparkSession

        from siltstone.operators import profiling, values
        from siltstone.sources import sinks

        spark = SparkSession.builder.getOrCreate()
        for name, lake in load_sources(spark, read_sources_file(args.file)).items():
            sinks.store(profiling.profile(lake), f"{args.output}/{name}/profiles")
            sinks.store(values.column_values(lake), f"{args.output}/{name}/values")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
