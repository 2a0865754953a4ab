"""A tiny package with hand-computed answers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from resgraph.schema import DDL, Game


def _i(code: int, pos: int, op: str, v=None, s=None, sid: int = -1, f: int = -1, var: int = -1):
    return (code, pos, op, v, s, sid, f, var, 0)


ROWS = {
    "objects": [(0, "obj_player", 0, -1, -1), (1, "obj_door", 1, -1, 2), (2, "obj_base", -1, -1, -1), (3, "obj_test_dummy", -1, -1, -1), (4, "obj_orphan", 2, -1, -1), (5, "obj_menu_ctrl", -1, -1, -1)],
    "object_events": [(0, 0, 0, 0), (0, 3, 0, 1)],
    "rooms": [(0, "room_start", 320, 240, 30, False, -1), (1, "room_town", 320, 240, 30, False, 3), (2, "room_void", 320, 240, 30, False, -1)],
    "instances": [(0, 100, 0, 10, 20, -1), (0, 101, 1, 30, 40, 4), (1, 102, 0, 5, 5, -1)],
    "sprites": [(0, "spr_player"), (1, "spr_door"), (2, "spr_orphan"), (3, "spr_debug_box")],
    "sounds": [(0, "snd_beta_jingle"), (1, "snd_ok")],
    "strings": [(0, "room_town"), (1, "hello"), (2, "never used")],
    "functions": [(0, "room_goto", 0), (1, "scr_flag_get", 0), (2, "scr_flag_set", 0)],
    "variables": [],
    "code": [(0, "gml_Object_obj_player_Create_0", 100, 10), (1, "gml_Object_obj_player_Step_0", 200, 10), (2, "gml_GlobalScript_scr_init", 300, 10), (3, "gml_Room_room_town_Create", 400, 10), (4, "gml_RoomCC_room_start_1_Create", 500, 10)],
    "instructions": [
        _i(0, 0, "PUSHSTR", s="room_town", sid=0), _i(0, 1, "CALL", f=0), _i(1, 0, "PUSHI", v=77), _i(1, 1, "CALL", f=1), _i(1, 2, "PUSHI", v=77),
        _i(1, 3, "PUSHBLTN", var=-1), _i(1, 4, "CALL", f=2), _i(2, 0, "POPZ"), _i(3, 0, "PUSHSTR", s="hello", sid=1), _i(4, 0, "PUSHI", v=88), _i(4, 1, "CALL", f=1),
    ],
}


def tiny_game(spark: SparkSession, **more: list[tuple]) -> Game:
    """The fixture, with rows added to (or, by name=None, taken from) its relations."""
    rows = {name: [] if more.get(name, ()) is None else [*held, *more.get(name, ())] for name, held in ROWS.items()}
    return Game(**{name: spark.createDataFrame(held, DDL[name]) for name, held in rows.items()})
