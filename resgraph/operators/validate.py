"""Consistency checks of a package's relations as rows of (category, severity, message, source)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resgraph.operators import resolve
from resgraph.schema import Game


def _issue(rows: DataFrame, category: str, severity: str, message: Column, source: Column) -> DataFrame:
    return rows.select(F.lit(category).alias("category"), F.lit(severity).alias("severity"), message.alias("message"), source.cast("string").alias("source"))


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def validate(game: Game) -> DataFrame:
    """All issues; counts are rows of severity info."""
    g, c = game, F.col
    code, objects = g.code.select(c("id").alias("k")), g.objects.select(c("id").alias("k"))

    def missing(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
        return rows.where(c(key) >= 0).join(known, c(key) == c("k"), "left_anti")

    out = [_issue(rows.agg(F.count("*").alias("n")), "chunks", "info", _said(f"{name}: ", c("n")), F.lit(name)) for name, rows in g.relations().items()]
    for name, rows in (("object", g.objects), ("room", g.rooms)):
        twice = rows.where("name <> ''").groupBy("name").count().where("count > 1")
        out.append(_issue(twice, "chunks", "warning", _said(f"Duplicate {name} name, times ", c("count")), c("name")))
    out += [
        _issue(g.code.agg(F.count("*").alias("n")).where("n = 0"), "chunks", "error", F.lit("No code entries"), F.lit("code")),
        _issue(g.code.agg(F.count("*").alias("n"), F.max("id").alias("m")).where("n > 0 and m + 1 <> n"), "chunks", "warning", F.lit("Code ids are not contiguous"), F.lit("code")),
        _issue(missing(g.objects, "sprite_index", g.sprites.select(c("id").alias("k"))), "objects", "error", _said("Missing sprite ", c("sprite_index")), c("name")),
        _issue(missing(g.objects, "mask_index", g.sprites.select(c("id").alias("k"))), "objects", "error", _said("Missing mask ", c("mask_index")), c("name")),
        _issue(missing(g.objects, "parent_index", objects), "objects", "error", _said("Missing parent ", c("parent_index")), c("name")),
        _issue(missing(g.object_events, "code_id", code), "objects", "warning", _said("Event code ", c("code_id"), " does not exist"), c("object_id")),
        _issue(missing(g.rooms, "creation_code_id", code), "rooms", "error", _said("Missing creation code ", c("creation_code_id")), c("name")),
        _issue(g.rooms.join(g.instances.select(c("room_id").alias("k")), c("id") == c("k"), "left_anti"), "rooms", "info", F.lit("Room has no instances"), c("name")),
        _issue(missing(g.instances, "object_id", objects), "rooms", "error", _said("Instance of missing object ", c("object_id")), c("instance_id")),
        _issue(missing(g.instances, "creation_code_id", code), "rooms", "error", _said("Instance with missing creation code ", c("creation_code_id")), c("instance_id")),
        _issue(resolve.owners(g).where("owner_type = -1"), "ownership", "warning", F.lit("Code owner is unknown"), c("owner")),
        _issue(_containment(g).where("code_id is null"), "ownership", "warning", F.lit("Function offset lies in no code entry"), c("name")),
        _issue(_uncalled(g), "calls", "info", F.lit("Code is never called and calls nothing"), c("id")),
        _issue(missing(g.instructions.where("opcode = 'PUSHSTR'"), "value_str_id", g.strings.select(c("id").alias("k"))), "strings", "info", _said("String id out of range ", c("value_str_id")), c("code_id")),
        _issue(g.objects.where("sprite_index < 0"), "usage", "info", F.lit("Object has no sprite"), c("name")),
        _issue(_only_read(g), "flags", "warning", F.lit("Flag is read but never written"), c("flag")),
    ]
    return reduce(DataFrame.unionByName, out)


def _containment(g: Game) -> DataFrame:
    """(func_id, name, code_id): of each function with an offset, the first code entry whose bytes hold it.

    A range join by buckets of 256 bytes: an entry is listed under each bucket that it touches, an offset under its own.
    """
    parts = g.code.where("length > 0").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("offset") / 256), F.floor((F.col("offset") + F.col("length") - 1) / 256)))).select(F.col("id").alias("c_id"), "offset", "length", "bucket")
    f = g.functions.where("code_offset > 0").select(F.col("id").alias("func_id"), "name", "code_offset", F.floor(F.col("code_offset") / 256).alias("bucket"))
    held = f.join(parts, "bucket").where("code_offset >= offset and code_offset < offset + length").groupBy("func_id").agg(F.min("c_id").alias("code_id"))
    return f.join(held, "func_id", "left").select("func_id", "name", "code_id")


def _uncalled(g: Game) -> DataFrame:
    made = resolve.calls(g)
    return g.code.join(made.select(F.col("caller").alias("id")), "id", "left_anti").join(made.where("callee is not null").select(F.col("callee").alias("id")), "id", "left_anti")


def _only_read(g: Game) -> DataFrame:
    uses = resolve.flag_uses(g).where("flag >= 0")
    return uses.where("access = 'read'").select("flag").distinct().join(uses.where("access = 'write'").select("flag"), "flag", "left_anti")


def totals(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category", "severity").agg(F.count("*").alias("n"))
