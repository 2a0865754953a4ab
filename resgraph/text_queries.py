"""Queries of the source-text analyzers over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from resgraph.functions import text as T
from resgraph.operators.analyzers import NOT_CALLS, Analyzers
from resgraph.sources.text_star import duck_ctes, text_project

UNITS = duck_ctes() + r""", units AS (SELECT 'OBJECT' AS kind, object AS name, 'Event: ' || key AS context, code FROM p_events UNION ALL SELECT 'SCRIPT', name, '', code FROM p_scripts UNION ALL SELECT 'ROOM', name, '', creation_code FROM p_rooms WHERE creation_code <> ''),
refs AS (""" + " UNION ALL ".join(f"SELECT kind, name, context, '{k}' AS what, unnest(regexp_extract_all(code, '{p.removeprefix('(?U)')}', 1)) AS target FROM units" for k, p in T.PATTERNS.items() if "(?!" not in p) + r"""),
targets AS (SELECT * FROM (SELECT kind, name AS source, target, CASE WHEN what IN ('script_call', 'script_execute', 'method') THEN 'CALL' WHEN what = 'create' AND NOT regexp_matches(target, '^[0-9]') THEN 'DYNAMIC'
  WHEN what = 'with' AND target NOT IN ('self', 'other', 'all', 'noone') THEN 'DYNAMIC' WHEN what = 'room_goto' THEN 'TRANSITION' WHEN what = 'play' THEN 'REFERENCE'
  WHEN what = 'object_index' AND target NOT IN ('self', 'other', 'all', 'noone', 'instance') THEN 'REFERENCE' END AS ref_type FROM refs) r WHERE ref_type IS NOT NULL),
moves AS (SELECT name AS source, target, 'room_goto' AS transition FROM refs WHERE what = 'room_goto' AND target <> 'room'
  UNION ALL SELECT name, '__next__', 'room_goto_next' FROM units WHERE regexp_matches(code, 'room_goto_next\s*\(\s*\)') UNION ALL SELECT name, '__previous__', 'room_goto_previous' FROM units WHERE regexp_matches(code, 'room_goto_previous\s*\(\s*\)')
  UNION ALL SELECT name, '__current__', 'room_restart' FROM units WHERE regexp_matches(code, 'room_restart\s*\(\s*\)')),
dead AS (SELECT 'object' AS kind, name FROM p_objects WHERE name NOT IN (SELECT object FROM p_room_instances) AND name NOT IN (SELECT target FROM refs WHERE (what = 'create' AND kind <> 'ROOM') OR (what = 'create_layer' AND kind = 'OBJECT')) AND name NOT IN (SELECT parent FROM p_objects WHERE parent IS NOT NULL)
  UNION ALL SELECT 'room', name FROM p_rooms WHERE name NOT IN (SELECT target FROM moves) AND name NOT IN (SELECT target FROM targets)
  UNION ALL SELECT 'script', name FROM p_scripts WHERE NOT is_anonymous AND name NOT IN (SELECT target FROM refs WHERE what IN ('script_call', 'script_execute', 'method')) AND name NOT IN (SELECT target FROM targets WHERE ref_type IN ('CALL', 'REFERENCE'))
  UNION ALL SELECT 'sound', name FROM p_sounds WHERE name NOT IN (SELECT target FROM refs WHERE what IN ('play', 'play_at', 'sound_play') AND kind <> 'ROOM')
  UNION ALL SELECT 'sprite', name FROM p_sprites WHERE name NOT IN (SELECT target FROM refs WHERE (what IN ('sprite_index', 'draw_sprite') AND kind <> 'ROOM') OR (what = 'mask_index' AND kind = 'OBJECT')) AND name NOT IN (SELECT sprite FROM p_objects)
  UNION ALL SELECT 'dialogue', id FROM p_dialogues WHERE id NOT IN (SELECT target FROM refs WHERE what IN ('dialogue_text', 'dialogue_id', 'message_id', 'show_message'))) """
_not_call = " AND ".join(f"NOT starts_with(target, '{x}')" for x in NOT_CALLS)
_edges = f""", call AS (SELECT * FROM refs WHERE what = 'function' AND length(target) > 1 AND {_not_call}),
known AS (SELECT name FROM p_objects UNION SELECT name FROM p_rooms UNION SELECT name FROM p_scripts UNION SELECT name FROM p_sprites UNION SELECT name FROM p_sounds UNION SELECT name FROM p_fonts),
every AS (SELECT name AS src, sprite AS dst, 'uses_sprite' AS label, 0 AS rule FROM p_objects UNION ALL SELECT name, parent, 'inherits', 1 FROM p_objects WHERE parent IS NOT NULL UNION ALL SELECT room, object, 'contains', 2 FROM p_room_instances
  UNION ALL SELECT object, room, 'placed_in', 3 FROM p_room_instances UNION ALL SELECT source, target, 'transitions_' || transition, 4 FROM moves UNION ALL SELECT source, target, lower(ref_type), 5 FROM targets
  UNION ALL SELECT name, target, 'calls', 6 FROM call WHERE kind = 'SCRIPT' AND target IN (SELECT name FROM p_scripts) UNION ALL SELECT name, target, 'references', 7 FROM call WHERE kind = 'SCRIPT' AND target IN (SELECT name FROM p_objects)
  UNION ALL SELECT name, target, 'event_' || substr(context, 8) || '_calls', 8 FROM call WHERE kind = 'OBJECT' AND target IN (SELECT name FROM p_scripts) UNION ALL SELECT name, target, 'event_' || substr(context, 8) || '_references', 9 FROM call WHERE kind = 'OBJECT' AND target IN (SELECT name FROM p_objects))
SELECT src, dst, max({{'rule': rule, 'label': label}}).label AS label FROM every WHERE src IN (SELECT name FROM known) AND dst IN (SELECT name FROM known) GROUP BY src, dst"""


def _of(f):
    return lambda spark, sf_dir: f(Analyzers(text_project(spark, sf_dir)))


QUERIES = {
    "text_references": _of(lambda a: a.refs.where("what <> 'global_get'").groupBy("what", "target").agg(F.count("*").alias("n"))),
    "text_targets": _of(lambda a: a.targets),
    "text_transitions": _of(lambda a: a.transitions),
    "text_top_called": _of(lambda a: a.top_called()),
    "text_dead": _of(lambda a: a.dead()),
    "text_edges": _of(lambda a: a.edges()),
    "text_flag_counts": _of(lambda a: a.flag_counts()),
    "text_mutual_recursion": _of(lambda a: a.callgraph().where("score = 30").select("name")),
    "text_suspicious": _of(lambda a: a.suspicious()),
}
SQL = {
    "text_references": UNITS + "SELECT what, target, count(*) AS n FROM refs GROUP BY 1, 2",
    "text_targets": UNITS + "SELECT * FROM targets",
    "text_transitions": UNITS + "SELECT * FROM moves",
    "text_top_called": UNITS + "SELECT target, count(*) AS calls FROM targets GROUP BY 1 ORDER BY calls DESC, target LIMIT 20",
    "text_dead": UNITS + "SELECT * FROM dead",
    "text_edges": UNITS + _edges,
    # an indexed flag after a single equals sign ("x = global.flag[n] + 1") counts as written, so only scr_flag_get reads here
    "text_flag_counts": UNITS + r"""SELECT flag, sum(s)::BIGINT AS sets, sum(g)::BIGINT AS gets FROM (SELECT unnest(regexp_extract_all(code, 'global\.flag\[(\d+)\] = ', 1))::BIGINT AS flag, 1 AS s, 0 AS g FROM units
  UNION ALL SELECT unnest(regexp_extract_all(code, 'global\.flag\[(\d+)\] \+', 1))::BIGINT, 1, 0 FROM units UNION ALL SELECT unnest(regexp_extract_all(code, 'scr_flag_get\s*\(\s*(\d+)', 1))::BIGINT, 0, 1 FROM units) GROUP BY flag""",
    "text_mutual_recursion": UNITS + ", p AS (SELECT DISTINCT source, target FROM targets) SELECT 'recursion_' || a.source || '_' || a.target AS name FROM p a JOIN p b ON a.source = b.target AND a.target = b.source",
}
