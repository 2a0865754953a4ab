"""Star tables seen as a source-text project, by projections that any SQL engine reads alike."""

from __future__ import annotations

from pyspark.sql import SparkSession

from resgraph.operators.analyzers import Project

_K = "CAST(p_partkey AS varchar(20))"
#: Names refer to each other within groups of 300 keys, so that used and unused resources both grow with ``part``.
_GROUP = "p_partkey - p_partkey % 300"


def _n(expr: str) -> str:
    return f"CAST({expr} AS varchar(20))"


def _near(expr: str) -> str:
    return _n(f"{_GROUP} + {expr}")


_BODY = f"""concat('if (scr_flag_get(', {_near("p_partkey % 50")}, ')) {{ room_goto(room_', {_near("p_partkey % 30")}, '); }}', chr(10),
  'global.flag[', {_near("p_partkey % 20")}, '] = 1;', chr(10), 'scr_', {_near("p_partkey % 70")}, '(1);', chr(10), 'with (obj_', {_near("(p_partkey % 300 * 3) % 350")}, ') {{ }}', chr(10),
  CASE WHEN p_partkey % 5 = 0 THEN concat('instance_create(0, 0, obj_', {_near("(p_partkey % 300 * 7) % 400")}, ');', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 4 = 0 THEN concat('audio_play_sound(snd_', {_near("p_partkey % 15")}, ', 1);', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 9 = 0 THEN concat('return;', chr(10), 'x = global.flag[', {_near("p_partkey % 33")}, '] + 1;', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 11 = 0 THEN concat('show_message("hello ', {_K}, '");', chr(10), 'goto_end();', chr(10)) ELSE '' END)"""

#: Relation by relation over all of ``part``.
PROJECTION = {
    "p_objects": f"SELECT concat('obj_', {_K}) AS name, concat('spr_', {_near('p_partkey % 40')}) AS sprite, CASE WHEN p_partkey % 6 = 0 THEN concat('obj_', {_n('CAST(floor(p_partkey / 7) AS bigint)')}) ELSE CAST(NULL AS varchar(30)) END AS parent FROM part",
    "p_events": f"SELECT concat('obj_', {_near('p_partkey % 300 % 250')}) AS object, CASE p_partkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'step' ELSE 'draw' END AS key, {_BODY} AS code FROM part",
    "p_rooms": f"SELECT concat('room_', {_K}) AS name, CASE WHEN p_partkey % 4 = 0 THEN concat('room_goto(room_', {_n('p_partkey + 1')}, ');') ELSE '' END AS creation_code FROM part",
    "p_room_instances": f"SELECT concat('room_', {_near('p_partkey % 35')}) AS room, concat('obj_', {_n('p_partkey - p_partkey % 3 + 1')}) AS object FROM part",
    "p_scripts": f"SELECT concat(CASE WHEN p_partkey % 17 = 0 THEN 'gml_' ELSE 'scr_' END, {_K}) AS name, concat('scr_', {_n('p_partkey + 1 + p_partkey % 2')}, '(obj_', {_near('3')}, '(1));') AS code, p_partkey % 17 = 0 AS is_anonymous FROM part",
    "p_sprites": f"SELECT concat('spr_', {_K}) AS name FROM part",
    "p_sounds": f"SELECT concat('snd_', {_K}) AS name FROM part",
    "p_fonts": f"SELECT concat('fnt_', {_K}) AS name FROM part",
    "p_dialogues": f"SELECT concat('hello ', {_K}) AS id, concat('text ', {_K}) AS text FROM part",
}


def text_project(spark: SparkSession, sf_dir: str) -> Project:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return Project(**{name[2:]: spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {part}"), part=part) for name, sql in PROJECTION.items()})


def duck_ctes() -> str:
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({sql})" for name, sql in PROJECTION.items())
