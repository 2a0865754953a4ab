"""Command line: python -m resgraph.cli PACKAGE COMMAND [ARGUMENT]."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resgraph.operators import detail, resolve, usage, validate
from resgraph.operators.queries import Engine
from resgraph.sources.package import chunk_directory, package_game

COMMANDS = {
    "summary": (lambda e: e.summary(), 0), "graph": (lambda e: e.graph_summary(), 0), "why": (lambda e, x: e.why_objects(x), 1), "trace": (lambda e, x: e.trace(x), 1),
    "search": (lambda e, x: e.search(x), 1), "who_uses": (lambda e, x: e.who_uses(x), 1), "who": (lambda e, x: e.who_uses(x), 1), "flag": (lambda e, x: e.flag_users(int(x)), 1),
    "room": (lambda e, x: e.show_rooms().where(F.col("name") == x), 1), "show_room": (lambda e, x: detail.room_lists(e, x), 1),
    "why_lists": (lambda e, x: detail.object_lists(e, x), 1), "resolver": (lambda e: detail.resolver_report(e.game), 0), "degrees": (lambda e: detail.degree_classes(e), 0), "dialogue": (lambda e: usage.dialogue_summary(e.game), 0),
    "unreachable": (lambda e: e.unreachable_rooms(), 0), "secret": (lambda e: e.suspicious().orderBy("rank", "node_id"), 0), "dead": (lambda e: e.dead_resources(), 0),
    "analyze": (lambda e: e.relation_counts(), 0), "usage": (lambda e: usage.object_states(e.game), 0), "debug_resolver": (lambda e: resolve.owners(e.game), 0), "debug_graph": (lambda e: validate.totals(validate.validate(e.game)), 0),
}


def run(spark: SparkSession, path: str, command: str, *arguments: str) -> DataFrame:
    if command == "debug_chunks":
        return chunk_directory(spark, path)
    if command not in COMMANDS:
        raise SystemExit(f"unknown command {command}; one of: {', '.join([*COMMANDS, 'debug_chunks', 'interactive'])}")
    f, n = COMMANDS[command]
    if len(arguments) < n:
        raise SystemExit(f"{command} needs an argument")
    return f(Engine(package_game(spark, path)), *arguments[:n])


def main(argv: list[str]) -> None:
    if len(argv) < 2 or argv[0] in ("help", "-h", "--help"):
        raise SystemExit(f"{__doc__}\ncommands: {', '.join([*COMMANDS, 'debug_chunks', 'interactive'])}")
    spark = SparkSession.builder.appName("resgraph").getOrCreate()
    path, command, *rest = argv
    if command not in ("interactive", "shell", "i"):
        run(spark, path, command, *rest).show(100, False)
        return
    while (line := input("> ").split()) and line[0] not in ("quit", "exit"):
        try:
            run(spark, path, *line).show(100, False)
        except SystemExit as error:
            print(error)


if __name__ == "__main__":
    main(sys.argv[1:])
