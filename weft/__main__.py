"""python -m weft parse|explain|run|backup|load-vault|restore: queries, vaults and copies from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from weft.cypher.parser import parse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weft")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("parse").add_argument("query")
    for name in ("explain", "run"):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("--graph", required=True, help="a folder written by backup, or trade:FOLDER, social:FOLDER, vault:FOLDER")
        s.add_argument("--params", default="{}", help="JSON")
        s.add_argument("--limit", type=int, default=50, help="rows to show")
    for name in ("backup", "load-vault", "restore"):
        s = sub.add_parser(name)
        s.add_argument("--graph", required=True, help="as for run; for load-vault the vault's folder, for restore a folder written by backup")
        s.add_argument("--to", required=True)
    a = p.parse_args(argv)
    if a.what == "parse":
        print(parse(a.query))
        return 0
    from pyspark.sql import SparkSession

    from weft.graphs import social_graph, trade_graph
    from weft.session import GraphSession
    from weft.sources.graph_files import backup, restore
    from weft.sources.vault import read_vault, vault_graph

    spark = SparkSession.builder.appName("weft").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    kind, _, folder = (f"vault:{a.graph}" if a.what == "load-vault" else a.graph).partition(":")
    made = {"trade": trade_graph, "social": social_graph, "vault": lambda s, d: vault_graph(read_vault(s, d))}.get(kind)
    g = made(spark, folder) if made and folder else restore(spark, a.graph)
    if a.what in ("backup", "load-vault", "restore"):
        backup(g, a.to)
        return 0
    df = GraphSession(spark, g).cypher(("EXPLAIN " if a.what == "explain" else "") + a.query, json.loads(a.params))
    df.show(a.limit if a.what == "run" else 10_000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
