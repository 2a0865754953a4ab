"""Reference resolution: joins of ids, owners of code by name, and windows that look back over instructions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resgraph.schema import CALLS, EVENT_TYPES, FUNCTION_CLASSES, OWNER_EVENT, OWNER_GLOBAL, OWNER_ROOM, OWNER_SCRIPT, OWNER_SEQUENCE, OWNER_TIMELINE, OWNER_UNKNOWN, PASSED_OVER, Game
from resgraph.session import cut


def is_call(opcode: Column) -> Column:
    return opcode.isin(*CALLS)


def first_by_name(rows: DataFrame) -> DataFrame:
    """(name, id): the least id of each name."""
    return rows.groupBy("name").agg(F.min("id").alias("id"))


def last_by_name(rows: DataFrame) -> DataFrame:
    """(name, id): the greatest id of each name."""
    return rows.groupBy("name").agg(F.max("id").alias("id"))


def kept(game: Game, name: str, make: Callable[[Game], DataFrame]) -> DataFrame:
    """make(game) as a table written when it is first asked for."""
    if name not in game.__dict__:
        game.__dict__[name] = cut(make(game))
    return game.__dict__[name]


def looked(game: Game) -> DataFrame:
    """instructions with the results of all look-backs, by one join and one sort, written once for all rules that read them.

    arg4 and arg7 (opcode, value_int, value_str) are the nearest of the 4 and 7 instructions before that aren't passed over;
    room_id is the room that the nearest of the 14 before that pushes a room's name names.
    """
    return kept(game, "_looked", _looked)


def _looked(game: Game) -> DataFrame:
    rooms = last_by_name(game.rooms).select(F.col("name").alias("r_name"), F.col("id").alias("pushed_room"))
    names_room = (F.col("opcode") == "PUSHSTR") & (F.col("value_str_id") >= 0) & (F.col("value_str") == F.col("r_name"))
    rows = game.instructions.join(rooms, names_room, "left")
    w = Window.partitionBy("code_id").orderBy("pos")
    shown = F.when(~F.col("opcode").isin(*PASSED_OVER), F.struct("opcode", "value_int", "value_str"))
    args = [F.last(shown, ignorenulls=True).over(w.rowsBetween(-k, -1)).alias(f"arg{k}") for k in (4, 7)]
    return rows.select(*game.instructions.columns, *args, F.last("pushed_room", ignorenulls=True).over(w.rowsBetween(-14, -1)).alias("room_id"))


def look_back(game: Game, k: int) -> DataFrame:
    """instructions with arg: the nearest of the k (4 or 7) before that isn't passed over."""
    return looked(game).withColumn("arg", F.col(f"arg{k}")).drop("arg4", "arg7", "room_id")


def owners(game: Game) -> DataFrame:
    """(code_id, owner, owner_type, object_id): who owns each code entry by the form of its name."""
    return kept(game, "_owners", _owners)


def _owners(game: Game) -> DataFrame:
    words = "|".join(sorted(EVENT_TYPES, key=len, reverse=True))
    form = f"(?s)^gml_Object_(.*)_({words})_(.*)$"
    name = F.col("name")
    word, tail = F.regexp_extract(name, form, 2), F.regexp_extract(name, form, 3)
    sub = F.when(word != "Collision", tail).when(tail.contains("_"), F.substring_index(tail, "_", -1)).otherwise("0")
    kind = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
    parsed = game.code.select(
        F.col("id").alias("code_id"), "name", F.when(name.rlike(form), F.regexp_extract(name, form, 1)).alias("object_name"),
        F.try_element_at(kind, word).alias("event_type"), F.coalesce(sub.try_cast("int"), F.lit(0)).alias("subtype"),
    )
    objects = first_by_name(game.objects).select(F.col("name").alias("object_name"), F.col("id").alias("object_id"))
    rows = parsed.join(objects, "object_name", "left")

    def after(prefix: str) -> Column:
        return F.substring(name, len(prefix) + 1, 1 << 30)

    event = F.concat(F.col("object_name"), F.lit(".event_"), F.col("event_type"), F.lit("_"), F.col("subtype"))
    by_name = [
        ("gml_Object_", OWNER_EVENT, F.when(F.col("object_id").isNotNull(), event).when(F.col("object_name").isNotNull(), F.concat(F.lit("object_unknown::"), name)).otherwise(F.concat(F.lit("object_unparseable::"), name))),
        ("gml_Script_", OWNER_SCRIPT, F.concat(F.lit("script::"), after("gml_Script_"))),
        ("gml_GlobalScript_", OWNER_GLOBAL, F.concat(F.lit("global_init::"), after("gml_GlobalScript_"))),
        ("gml_RoomCC_", OWNER_ROOM, F.concat(F.lit("room_cc::"), F.substring_index(after("gml_RoomCC_"), "_", 1))),
        ("gml_Room_", OWNER_ROOM, F.concat(F.lit("room_creation::"), after("gml_Room_"))),
        ("gml_Sequence_", OWNER_SEQUENCE, F.concat(F.lit("sequence::"), name)),
        ("gml_Timeline_", OWNER_TIMELINE, F.concat(F.lit("timeline::"), name)),
    ]
    owner = F.concat(F.lit("unknown::"), F.when(name != "", name).otherwise(F.concat(F.lit("code_"), F.col("code_id"))))
    kind_of = F.lit(OWNER_UNKNOWN)
    for prefix, number, label in reversed(by_name):
        owner = F.when(name.startswith(prefix), label).otherwise(owner)
        kind_of = F.when(name.startswith(prefix), number).otherwise(kind_of)
    return rows.select("code_id", owner.alias("owner"), kind_of.cast("int").alias("owner_type"), F.when(name.startswith("gml_Object_"), F.col("object_id")).alias("object_id"))


def entry_points(game: Game) -> DataFrame:
    """(func_id, code_id): functions whose offset is that of a code entry; of several entries the last."""
    by_offset = game.code.groupBy("offset").agg(F.max("id").alias("code_id"))
    return game.functions.where("code_offset > 0").join(by_offset, F.col("code_offset") == F.col("offset")).select(F.col("id").alias("func_id"), "code_id")


def calls(game: Game) -> DataFrame:
    """(caller, func_id, callee, pos, arg_count): each call of a listed function; callee is null for builtins."""
    made = game.instructions.where(is_call(F.col("opcode")) & (F.col("value_func_id") >= 0))
    known = made.join(game.functions.select(F.col("id").alias("value_func_id")), "value_func_id")
    return known.join(entry_points(game).select(F.col("func_id").alias("value_func_id"), F.col("code_id").alias("callee")), "value_func_id", "left").select(F.col("code_id").alias("caller"), F.col("value_func_id").alias("func_id"), "callee", "pos", "arg_count")


def function_classes(functions: DataFrame) -> DataFrame:
    """(func_id, func_name, creation, execute, asset, sound, flag): flag is write, read or null."""
    low = F.lower("name")

    def has(parts: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | low.contains(p)
        return out

    get = low.contains("_flag_get") | low.startswith("flag_get")
    put = low.contains("_flag_set") | low.startswith("flag_set")
    loose = low.contains("flag") & ~low.isin("flag", "flag_name", "flagname") & ~low.contains("name")
    flag = F.when(put, "write").when(get | loose, "read")
    return functions.where("name <> ''").select(F.col("id").alias("func_id"), F.col("name").alias("func_name"), *[has(p).alias(c) for c, p in FUNCTION_CLASSES.items()], flag.alias("flag"))


def flag_index(arg: Column) -> Column:
    """The constant that an argument pushes; -1 where it isn't one."""
    index = F.when(arg["opcode"] == "PUSHI", arg["value_int"]).when(arg["opcode"] == "PUSHSTR", F.trim(arg["value_str"]).try_cast("long"))
    return F.coalesce(index, F.lit(-1)).cast("long")


def flag_uses(game: Game) -> DataFrame:
    """(code_id, pos, flag, access): calls of flag functions; flag is -1 where the index isn't a constant."""
    seen = look_back(game, 4).where(is_call(F.col("opcode")))
    used = seen.join(function_classes(game.functions).where("flag is not null").select(F.col("func_id").alias("value_func_id"), F.col("flag").alias("access")), "value_func_id")
    return used.select("code_id", "pos", flag_index(F.col("arg")).alias("flag"), "access")


def room_transitions(game: Game) -> DataFrame:
    """(code_id, pos, room_id): for each call, the nearest of the 14 instructions before that pushes a room's name."""
    return looked(game).where(is_call(F.col("opcode")) & F.col("room_id").isNotNull()).select("code_id", "pos", "room_id")


def object_arguments(game: Game, seen: DataFrame) -> DataFrame:
    """Rows of look_back whose argument is an object, by id or by name, with object_id."""
    by_id = game.objects.select(F.col("id").alias("o_id"))
    by_name = last_by_name(game.objects).select(F.col("name").alias("o_name"), F.col("id").alias("o_named"))
    arg = F.col("arg")
    rows = seen.join(by_id, (arg["opcode"] == "PUSHI") & (arg["value_int"] == F.col("o_id")), "left")
    rows = rows.join(by_name, (arg["opcode"] == "PUSHSTR") & (arg["value_str"] == F.col("o_name")), "left")
    return rows.withColumn("object_id", F.coalesce("o_id", "o_named")).where("object_id is not null").drop("o_id", "o_name", "o_named")


def named_arguments(seen: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of look_back whose argument is a string that names a row of named (name, id); with target_id."""
    arg = F.col("arg")
    return seen.join(last_by_name(named).select(F.col("name").alias("t_name"), F.col("id").alias("target_id")), (arg["opcode"] == "PUSHSTR") & (arg["value_str"] == F.col("t_name"))).drop("t_name")
