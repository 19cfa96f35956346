"""Commands: ``python -m deckmill extract|rank PATH... --out FOLDER``, ``python -m deckmill query NAME TABLES --out FOLDER``, ``python -m deckmill list``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="deckmill")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("extract", "rank"):
        c = sub.add_parser(name)
        c.add_argument("paths", nargs="+")
        c.add_argument("--out", required=True)
        if name == "rank":
            c.add_argument("--problems", nargs="*", help="JSON files of problem statements")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("--out", required=True)
    sub.add_parser("list")
    a = p.parse_args(argv)
    from .plans import pipeline, registry

    if a.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    if a.command == "query" and a.name not in registry.queries():
        p.error(f"no query {a.name!r}")
    spark = SparkSession.builder.appName("deckmill").getOrCreate()
    from .functions.ship import ship

    ship(spark)
    if a.command == "query":
        registry.queries()[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)
    elif a.command == "extract":
        from .sources.packages import discover

        for name, df in pipeline.extracted(discover(spark, a.paths)).items():
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    else:
        from .sources.problems import read_problems

        pipeline.run(spark, a.paths, a.out, problems=read_problems(spark, a.problems)[0] if a.problems else None)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
