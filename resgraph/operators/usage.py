"""Runtime use of objects as a bit mask of states, and dialogue strings by the calls that follow them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resgraph.operators import resolve
from resgraph.schema import Game

#: States in order of their bits, with their labels.
STATES = {
    "ROOM_PLACED": "placed in room", "CREATED_DYNAMICALLY": "created dynamically", "INSTANTIATE_CREATED": "instantiate opcode", "FUNCTION_CREATED": "creation function call",
    "WITH_REFERENCED": "with() reference", "ASSET_GET_REFERENCED": "asset_get_index", "EVENT_EXECUTE_REFERENCED": "event_execute_object", "BYTECODE_REFERENCED": "bytecode reference",
    "STRING_REFERENCED": "string reference", "CREATION_CODE_REFERENCED": "creation code", "COLLISION_REFERENCED": "collision event", "INHERITED": "inherited from parent",
    "PARENT_OF": "is a parent", "HAS_SPRITE": "has sprite", "HAS_EVENTS": "has events", "UNUSED": "unused", "UNKNOWN": "unknown", "LIKELY_UNUSED": "likely unused",
}
BIT = {name: 1 << i for i, name in enumerate(STATES)}
#: States that show an object in use.
ALIVE = sum(BIT[s] for s in ("ROOM_PLACED", "CREATED_DYNAMICALLY", "WITH_REFERENCED", "ASSET_GET_REFERENCED", "BYTECODE_REFERENCED", "STRING_REFERENCED", "CREATION_CODE_REFERENCED", "COLLISION_REFERENCED", "INHERITED", "PARENT_OF"))
#: Functions that show text whatever their name says.
SHOW = ("scr_Dialogue", "scr_Dialogue_String", "scr_Dialogue_Name", "show_message", "draw_text", "draw_text_ext")


def object_states(game: Game) -> DataFrame:
    """(object_id, name, mask, alive, labels) of every object."""
    ids = game.objects.select(F.col("id").alias("o_id"))
    i = resolve.looked(game)
    classes = resolve.function_classes(game.functions)

    def mark(rows: DataFrame, column: str, *states: str) -> DataFrame:
        return rows.select(F.col(column).cast("long").alias("object_id"), F.lit(sum(BIT[s] for s in states)).cast("long").alias("bit"))

    made = i.where("opcode = 'INSTANTIATE'").join(ids, F.col("value_int") == F.col("o_id"))
    seen = resolve.look_back(game, 7).where(resolve.is_call(F.col("opcode"))).join(classes, F.col("value_func_id") == F.col("func_id"))
    named = (F.col("arg.opcode") != "PUSHSTR") | F.col("arg.value_str").rlike("^(obj_|_)")
    created = resolve.object_arguments(game, seen.where("creation or execute").where(named))
    near = resolve.look_back(game, 4)
    asked = near.where(resolve.is_call(F.col("opcode"))).join(classes.where("asset"), F.col("value_func_id") == F.col("func_id")).where(F.col("arg.value_str").rlike("^(obj_|_)"))
    asked = resolve.named_arguments(asked, game.objects)
    within = near.where("opcode = 'WITH' and arg.opcode = 'PUSHI'").join(ids, F.col("arg.value_int") == F.col("o_id"))
    pushed = i.where("opcode = 'PUSHI'").join(ids, F.col("value_int") == F.col("o_id"))
    said = i.where("opcode = 'PUSHSTR'").join(resolve.last_by_name(game.objects).select(F.col("name").alias("value_str"), F.col("id").alias("o_id")), "value_str")
    codes = game.rooms.select(F.col("creation_code_id").alias("code_id")).union(game.instances.select("creation_code_id")).where("code_id >= 0").distinct()
    parents = game.objects.join(ids, F.col("parent_index") == F.col("o_id"))
    hits = game.object_events.where("event_type = 4").join(ids, F.col("subtype") == F.col("o_id"))
    bits = reduce(DataFrame.union, [
        mark(game.instances.join(ids, F.col("object_id") == F.col("o_id")), "o_id", "ROOM_PLACED"),
        mark(made, "o_id", "INSTANTIATE_CREATED", "CREATED_DYNAMICALLY"), mark(created, "object_id", "FUNCTION_CREATED", "CREATED_DYNAMICALLY"),
        mark(asked, "target_id", "ASSET_GET_REFERENCED"), mark(within, "o_id", "WITH_REFERENCED"), mark(pushed, "o_id", "BYTECODE_REFERENCED"), mark(said, "o_id", "STRING_REFERENCED"),
        mark(pushed.join(codes, "code_id", "left_semi"), "o_id", "CREATION_CODE_REFERENCED"),
        mark(parents, "id", "INHERITED"), mark(parents, "o_id", "PARENT_OF"), mark(hits, "o_id", "COLLISION_REFERENCED"),
        mark(game.objects.where("sprite_index >= 0"), "id", "HAS_SPRITE"), mark(game.object_events, "object_id", "HAS_EVENTS"),
    ])
    sums = bits.groupBy("object_id").agg(F.bit_or("bit").alias("mask"))
    rows = game.objects.select(F.col("id").alias("object_id"), "name").join(sums, "object_id", "left").withColumn("mask", F.coalesce("mask", F.lit(0)).cast("long"))
    alive = F.col("mask").bitwiseAND(F.lit(ALIVE).cast("long")) != 0
    some = F.col("mask").bitwiseAND(F.lit(BIT["HAS_EVENTS"] | BIT["HAS_SPRITE"]).cast("long")) != 0
    final = F.when(alive, F.col("mask")).when(some, F.col("mask").bitwiseOR(F.lit(BIT["LIKELY_UNUSED"]).cast("long"))).otherwise(F.col("mask").bitwiseOR(F.lit(BIT["UNUSED"]).cast("long")))
    labels = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(BIT[s]).cast("long")) != 0, F.lit(label)) for s, label in STATES.items()]), lambda x: x.isNotNull())
    return rows.select("object_id", "name", final.alias("mask"), alive.alias("alive")).withColumn("labels", F.array_join(labels, ", "))


def dialogue_strings(game: Game) -> DataFrame:
    """(code_id, pos, string_id): of the 5 instructions before a dialogue call, the last 3 pushed strings."""
    low = F.lower("name")
    talk = game.functions.where(low.contains("dialogue") | F.col("name").isin(*SHOW)).select(F.col("id").alias("value_func_id"))
    w = Window.partitionBy("code_id").orderBy("pos").rowsBetween(-5, -1)
    seen = game.instructions.withColumn("pushed", F.collect_list(F.when((F.col("opcode") == "PUSHSTR") & (F.col("value_str_id") >= 0), F.col("value_str_id"))).over(w))
    called = seen.where(F.col("opcode").isin("CALL", "CALLV", "CALLVN")).join(talk, "value_func_id", "left_semi")
    last = F.when(F.size("pushed") > 3, F.slice("pushed", -3, 3)).otherwise(F.col("pushed"))
    return called.select("code_id", "pos", F.explode(last).alias("string_id"))


def unused_dialogue(game: Game) -> DataFrame:
    """(string_id, text): pushed strings of more than 3 characters that no dialogue call follows."""
    shown = game.instructions.where("opcode = 'PUSHSTR' and value_str_id >= 0 and length(value_str) > 3").select(F.col("value_str_id").alias("string_id"), F.col("value_str").alias("text")).distinct()
    return shown.join(dialogue_strings(game), "string_id", "left_anti")


def dialogue_summary(game: Game) -> DataFrame:
    """(metric, n): pushed strings of more than 3 characters, those that a dialogue call shows, those that none shows."""
    shown = game.instructions.where("opcode = 'PUSHSTR' and value_str_id >= 0 and length(value_str) > 3").select(F.col("value_str_id").alias("string_id")).distinct()
    used = dialogue_strings(game).select("string_id").distinct().withColumn("used", F.lit(1))
    counts = shown.join(used, "string_id", "full").agg(F.count("*").alias("every"), F.count("used").alias("referenced"))
    total = shown.agg(F.count("*").alias("total"))
    both = counts.join(F.broadcast(total))  # one row a side
    named = F.array(*[F.struct(F.lit(m).alias("metric"), n.alias("n")) for m, n in (("total_dialogue_strings", F.col("total")), ("referenced_strings", F.col("referenced")), ("unused_strings", F.col("every") - F.col("referenced")))])
    return both.select(F.explode(named).alias("m")).select("m.metric", "m.n")


def creators(game: Game) -> DataFrame:
    """(object_id, code_id): each code entry that creates the object by opcode or by a creating function, once."""
    ids = game.objects.select(F.col("id").alias("object_id"))
    made = resolve.looked(game).where("opcode = 'INSTANTIATE'").join(ids, F.col("value_int") == F.col("object_id")).select("object_id", "code_id")
    classes = resolve.function_classes(game.functions).where("creation or execute")
    seen = resolve.look_back(game, 7).where(resolve.is_call(F.col("opcode"))).join(classes, F.col("value_func_id") == F.col("func_id"))
    named = (F.col("arg.opcode") != "PUSHSTR") | F.col("arg.value_str").rlike("^(obj_|_)")
    return made.union(resolve.object_arguments(game, seen.where(named)).select("object_id", "code_id")).distinct()
