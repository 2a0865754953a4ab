"""Star tables seen as a package: each relation is one SQL projection that any SQL engine reads alike."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from resgraph.schema import Game

_NUMBERS = "SELECT p_partkey AS k FROM part"
_OBJECT = "concat(CASE WHEN p_partkey % 97 = 5 THEN 'debug ' ELSE '' END, p_name, '_', CAST(p_partkey AS varchar(20)))"
_SAID = """CASE WHEN k >= 100 THEN concat('never said ', CAST(k AS varchar(20))) WHEN k % 4 = 0 THEN concat({obj_name}) WHEN k % 4 = 1 THEN s_name
  WHEN k % 4 = 2 THEN {snd_name} ELSE concat('text ', CAST(k AS varchar(20))) END"""
_SOUND = "concat('snd_', CASE WHEN k % 10 = 4 THEN 'beta_' ELSE '' END, CAST(k AS varchar(20)))"

#: Relation by relation; each may read the star tables and the relations above it.
PROJECTION = {
    "objects": f"""SELECT p_partkey AS id, {_OBJECT} AS name, CAST(p_size AS bigint) AS sprite_index, CAST(-1 AS bigint) AS mask_index,
  CASE WHEN p_partkey > 0 AND p_partkey % 3 = 0 THEN CAST(floor(p_partkey / 7) AS bigint) ELSE CAST(-1 AS bigint) END AS parent_index FROM part""",
    "object_events": """SELECT p_partkey AS object_id, CAST(CASE WHEN p_partkey % 5 = 2 THEN 4 ELSE p_partkey % 4 END AS int) AS event_type,
  CAST(p_partkey % 60 AS int) AS subtype, p_partkey % 150 AS code_id FROM part""",
    "rooms": """SELECT s_suppkey AS id, s_name AS name, CAST(320 + s_nationkey AS int) AS width, CAST(240 AS int) AS height, CAST(30 AS int) AS speed,
  s_suppkey % 7 = 0 AS persistent, CASE WHEN s_suppkey % 10 = 3 THEN s_suppkey ELSE CAST(-1 AS bigint) END AS creation_code_id FROM supplier""",
    "instances": """SELECT DISTINCT l_suppkey AS room_id, l_suppkey * 1000000 + l_partkey AS instance_id, l_partkey - l_partkey % 6 AS object_id,
  CAST(l_partkey % 640 AS int) AS x, CAST(l_suppkey % 480 AS int) AS y,
  CASE WHEN l_partkey % 50 = 0 THEN l_partkey % 150 ELSE CAST(-1 AS bigint) END AS creation_code_id FROM lineitem""",
    "sprites": f"""SELECT k AS id, concat('spr_', CASE WHEN k % 10 = 9 THEN 'debug_' ELSE '' END, CAST(k AS varchar(20))) AS name FROM ({_NUMBERS}) n""",
    "sounds": f"""SELECT k AS id, {_SOUND} AS name FROM ({_NUMBERS}) n""",
    "strings": f"""SELECT k AS id, {_SAID.format(obj_name=_OBJECT, snd_name=_SOUND)} AS value
  FROM (SELECT p_partkey AS k, p_partkey, p_name, s_name FROM part LEFT JOIN supplier ON s_suppkey = p_partkey) n""",
    "functions": f"""SELECT k AS id, concat(CASE k % 10 WHEN 0 THEN 'scr_flag_get_' WHEN 1 THEN 'scr_flag_set_' WHEN 2 THEN 'instance_create_depth_'
  WHEN 3 THEN 'asset_get_index_' WHEN 4 THEN 'audio_play_sound_' WHEN 5 THEN 'room_goto_' WHEN 6 THEN 'scr_dialogue_' ELSE 'fn_' END,
  CAST(k AS varchar(20))) AS name, CASE WHEN k % 2 = 0 THEN 1000 + 64 * k ELSE CAST(0 AS bigint) END AS code_offset FROM ({_NUMBERS}) n""",
    "variables": f"""SELECT k AS id, concat('var_', CAST(k AS varchar(20))) AS name FROM ({_NUMBERS}) n""",
    "code": """SELECT user_id AS id, CASE user_id % 6 WHEN 1 THEN concat('gml_Script_scr_', CAST(user_id AS varchar(20)))
  WHEN 2 THEN concat('gml_GlobalScript_g_', CAST(user_id AS varchar(20))) WHEN 3 THEN concat('gml_Room_r', CAST(user_id AS varchar(20)), '_Create')
  WHEN 4 THEN concat('gml_RoomCC_r', CAST(user_id AS varchar(20)), '_1_Create')
  WHEN 5 THEN concat('gml_Timeline_t', CAST(user_id AS varchar(20)))
  ELSE concat('gml_Object_', o.name, CASE WHEN user_id % 4 = 0 THEN '_Step_0' ELSE concat('_Collision_', 'x_', CAST(user_id % 9 AS varchar(20))) END) END AS name,
  1000 + 64 * user_id AS offset, CAST(64 AS bigint) AS length
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN objects o ON o.id = user_id""",
    "instructions": """SELECT e.code_id, e.pos, e.opcode, CASE WHEN e.opcode = 'PUSHI' OR e.opcode = 'INSTANTIATE' THEN k ELSE CAST(NULL AS bigint) END AS value_int,
  CASE WHEN e.opcode = 'PUSHSTR' THEN s.value ELSE CAST(NULL AS varchar(200)) END AS value_str,
  CASE WHEN e.opcode = 'PUSHSTR' THEN k ELSE CAST(-1 AS bigint) END AS value_str_id,
  CASE WHEN e.opcode = 'CALL' THEN k ELSE CAST(-1 AS bigint) END AS value_func_id,
  CASE WHEN e.opcode = 'PUSHBLTN' THEN k ELSE CAST(-1 AS bigint) END AS value_variable_id, CAST(k % 4 AS int) AS arg_count
  FROM (SELECT user_id AS code_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS pos,
    CASE event_type WHEN 'view' THEN CASE WHEN event_id % 9 = 0 THEN 'INSTANTIATE' ELSE 'PUSHI' END WHEN 'signup' THEN 'PUSHSTR' WHEN 'error' THEN 'PUSHBLTN'
      WHEN 'purchase' THEN 'CALL' ELSE 'WITH' END AS opcode, {k} AS k FROM events) e LEFT JOIN strings s ON s.id = e.k""",
}
_SPARK = {"{k}": "CAST(get_json_object(props, '$.k') AS bigint)"}
_DUCK = {"{k}": "CAST(json_extract(props, '$.k') AS bigint)"}
_STAR = ("part", "supplier", "lineitem", "events")


def _swap(sql: str, names: dict[str, str]) -> str:
    for a, b in names.items():
        sql = sql.replace(a, b)
    return sql


def star_game(spark: SparkSession, sf_dir: str) -> Game:
    """The package that the star tables stand for; its relations are views, and what resolution reads often is cut there."""
    known = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in _STAR}
    for name, sql in PROJECTION.items():
        used = [n for n in known if re.search(rf"(FROM|JOIN) {n}\b", sql)]
        text = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in known else m[0], _swap(sql, _SPARK))
        known[name] = spark.sql(text, **{n: known[n] for n in used})
    return Game(**{name: known[name] for name in PROJECTION})


def duck_ctes() -> str:
    """The same relations as CTEs over the star tables' views."""
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({_swap(sql, _DUCK)})" for name, sql in PROJECTION.items())
