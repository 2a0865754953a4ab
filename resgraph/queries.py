"""Named queries over the driver's tables, and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resgraph.functions.opcodes import GROUPS, in_group
from resgraph.operators import detail, resolve, usage, validate
from resgraph.operators.queries import Engine
from resgraph.plans import graph as g
from resgraph.schema import EVENT_NAMES, EVENT_TYPES, FUNCTION_CLASSES, SUSPICIOUS_NAMES
from resgraph.sources.star import duck_ctes, star_game

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# -- SQL pieces --------------------------------------------------------------------------------------------------------
_words = "|".join(sorted(EVENT_TYPES, key=len, reverse=True))
_event_case = " ".join(f"WHEN '{w}' THEN {n}" for w, n in EVENT_TYPES.items())
_calls = "('CALL', 'CALLV', 'CALLVN', 'NEW_OBJECT')"


def _any(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(name), '{p}')" for p in parts) + ")"


def _look(k: int) -> str:
    """The look-back argument within k rows, as SQL."""
    return f"last_value(CASE WHEN opcode NOT IN ('PUSHENV', 'POPENV', 'PUSHBLTN') THEN {{'op': opcode, 'i': value_int, 's': value_str}} END IGNORE NULLS) OVER (PARTITION BY code_id ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


GRAPH = (
    duck_ctes()
    + rf""", parsed AS (SELECT id AS code_id, name, regexp_matches(name, '^gml_Object_(.*)_({_words})_(.*)$') AS ok,
  regexp_extract(name, '^gml_Object_(.*)_({_words})_(.*)$', 1) AS o_name, regexp_extract(name, '^gml_Object_(.*)_({_words})_(.*)$', 2) AS word,
  regexp_extract(name, '^gml_Object_(.*)_({_words})_(.*)$', 3) AS tail FROM code),
own AS (SELECT p.code_id, CASE WHEN p.name LIKE 'gml\_Object\_%' ESCAPE '\' THEN CASE WHEN NOT ok THEN 'object_unparseable::' || p.name
    WHEN o.id IS NULL THEN 'object_unknown::' || p.name
    ELSE o_name || '.event_' || (CASE word {_event_case} END) || '_' || coalesce(try_cast(CASE WHEN word <> 'Collision' THEN tail WHEN contains(tail, '_') THEN list_last(string_split(tail, '_')) ELSE '0' END AS int), 0) END
  WHEN p.name LIKE 'gml\_Script\_%' ESCAPE '\' THEN 'script::' || substr(p.name, 12)
  WHEN p.name LIKE 'gml\_GlobalScript\_%' ESCAPE '\' THEN 'global_init::' || substr(p.name, 18)
  WHEN p.name LIKE 'gml\_RoomCC\_%' ESCAPE '\' THEN 'room_cc::' || split_part(substr(p.name, 12), '_', 1)
  WHEN p.name LIKE 'gml\_Room\_%' ESCAPE '\' THEN 'room_creation::' || substr(p.name, 10)
  WHEN p.name LIKE 'gml\_Sequence\_%' ESCAPE '\' THEN 'sequence::' || p.name
  WHEN p.name LIKE 'gml\_Timeline\_%' ESCAPE '\' THEN 'timeline::' || p.name
  ELSE 'unknown::' || CASE WHEN p.name <> '' THEN p.name ELSE 'code_' || p.code_id END END AS owner,
  CASE WHEN p.name LIKE 'gml\_Object\_%' ESCAPE '\' THEN 1 WHEN p.name LIKE 'gml\_Script\_%' ESCAPE '\' THEN 0 WHEN p.name LIKE 'gml\_GlobalScript\_%' ESCAPE '\' THEN 3
    WHEN p.name LIKE 'gml\_RoomCC\_%' ESCAPE '\' OR p.name LIKE 'gml\_Room\_%' ESCAPE '\' THEN 2 WHEN p.name LIKE 'gml\_Sequence\_%' ESCAPE '\' THEN 4
    WHEN p.name LIKE 'gml\_Timeline\_%' ESCAPE '\' THEN 5 ELSE -1 END::INT AS owner_type,
  CASE WHEN ok THEN o.id END AS object_id
  FROM parsed p LEFT JOIN (SELECT name, min(id) AS id FROM objects GROUP BY name) o ON p.ok AND o.name = p.o_name),
entry AS (SELECT f.id AS func_id, c.code_id FROM functions f JOIN (SELECT "offset" AS off, max(id) AS code_id FROM code GROUP BY "offset") c ON f.code_offset > 0 AND f.code_offset = c.off),
call AS (SELECT i.code_id AS caller, i.value_func_id AS func_id, e.code_id AS callee, i.pos, i.arg_count FROM instructions i JOIN functions f ON f.id = i.value_func_id
  LEFT JOIN entry e ON e.func_id = i.value_func_id WHERE i.opcode IN {_calls} AND i.value_func_id >= 0),
fclass AS (SELECT id AS func_id, name AS func_name, {_any(FUNCTION_CLASSES["creation"])} AS creation, {_any(FUNCTION_CLASSES["execute"])} AS "execute", {_any(FUNCTION_CLASSES["asset"])} AS asset, {_any(FUNCTION_CLASSES["sound"])} AS sound,
  CASE WHEN contains(lower(name), '_flag_set') OR starts_with(lower(name), 'flag_set') THEN 'write'
    WHEN contains(lower(name), '_flag_get') OR starts_with(lower(name), 'flag_get') OR (contains(lower(name), 'flag') AND lower(name) NOT IN ('flag', 'flag_name', 'flagname') AND NOT contains(lower(name), 'name')) THEN 'read' END AS flag
  FROM functions WHERE name <> ''),
seen7 AS (SELECT *, {_look(7)} AS arg FROM instructions), seen4 AS (SELECT *, {_look(4)} AS arg FROM instructions),
uses AS (SELECT code_id, pos, coalesce(CASE arg.op WHEN 'PUSHI' THEN arg.i WHEN 'PUSHSTR' THEN try_cast(trim(arg.s) AS bigint) END, -1) AS flag, c.flag AS access
  FROM seen4 JOIN fclass c ON c.func_id = value_func_id WHERE opcode IN {_calls} AND c.flag IS NOT NULL),
last_o AS (SELECT name, max(id) AS id FROM objects GROUP BY name), last_r AS (SELECT name, max(id) AS id FROM rooms GROUP BY name), last_s AS (SELECT name, max(id) AS id FROM sounds GROUP BY name),
moves AS (SELECT * FROM (SELECT code_id, pos, opcode, last_value(r.id IGNORE NULLS) OVER (PARTITION BY code_id ORDER BY pos ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS room_id
  FROM instructions i LEFT JOIN last_r r ON i.opcode = 'PUSHSTR' AND i.value_str_id >= 0 AND r.name = i.value_str) m WHERE opcode IN {_calls} AND room_id IS NOT NULL),
obj_arg AS (SELECT s.*, coalesce(o.id, n.id) AS oid FROM seen7 s LEFT JOIN objects o ON arg.op = 'PUSHI' AND o.id = arg.i LEFT JOIN last_o n ON arg.op = 'PUSHSTR' AND n.name = arg.s WHERE coalesce(o.id, n.id) IS NOT NULL),
called AS (SELECT s.*, c.creation OR c."execute" AS makes, c.asset, c.sound FROM seen7 s LEFT JOIN fclass c ON c.func_id = s.value_func_id WHERE opcode IN {_calls}),
named AS (SELECT name, arg_min(target, rank) AS target, arg_min(rel, rank) AS rel FROM (SELECT name, 0 AS rank, 'obj_' || id AS target, 'references' AS rel FROM last_o
  UNION ALL SELECT name, 1, 'snd_' || id, 'references_sound' FROM last_s UNION ALL SELECT name, 2, 'room_' || id, 'references' FROM last_r) GROUP BY name),
edges AS (
  SELECT 'room_' || room_id AS src, 'inst_' || instance_id AS dst, 'contains' AS relation, 1 AS rule, instance_id AS seq FROM instances
  UNION ALL SELECT 'inst_' || instance_id, 'obj_' || object_id, 'is_instance_of', 2, instance_id FROM instances WHERE object_id IN (SELECT id FROM objects)
  UNION ALL SELECT 'inst_' || instance_id, 'code_' || creation_code_id, 'has_creation_code', 3, instance_id FROM instances WHERE creation_code_id IN (SELECT id FROM code)
  UNION ALL SELECT 'code_' || creation_code_id, 'obj_' || object_id, 'creates', 4, instance_id FROM instances WHERE creation_code_id IN (SELECT id FROM code)
  UNION ALL SELECT 'room_' || id, 'code_' || creation_code_id, 'has_creation_code', 5, id FROM rooms WHERE creation_code_id IN (SELECT id FROM code)
  UNION ALL SELECT 'obj_' || id, 'obj_' || parent_index, 'inherits', 6, id FROM objects WHERE parent_index >= 0 AND parent_index IN (SELECT id FROM objects)
  UNION ALL SELECT 'obj_' || id, 'spr_' || sprite_index, 'uses_sprite', 7, id FROM objects WHERE sprite_index >= 0 AND sprite_index IN (SELECT id FROM sprites)
  UNION ALL SELECT 'obj_' || object_id, 'obj_' || subtype, 'collision_reference', 8, object_id FROM object_events WHERE event_type = 4 AND subtype IN (SELECT id FROM objects)
  UNION ALL SELECT 'obj_' || object_id, 'code_' || code_id, 'has_event', 9, code_id FROM own WHERE object_id IS NOT NULL
  UNION ALL SELECT CASE owner_type WHEN 3 THEN 'global_' WHEN 4 THEN 'seq_' ELSE 'timeline_' END || substr(owner, strpos(owner, '::') + 2), 'code_' || code_id, 'owns', 10, code_id FROM own WHERE owner_type IN (3, 4, 5)
  UNION ALL SELECT 'func_' || func_id, 'code_' || code_id, 'entry_point', 11, func_id FROM entry
  UNION ALL SELECT DISTINCT 'code_' || caller, 'code_' || callee, 'calls', 12, 0 FROM call WHERE callee IS NOT NULL
  UNION ALL SELECT 'code_' || caller, 'func_' || func_id, 'calls_function', 13, pos FROM call WHERE callee IS NULL
  UNION ALL SELECT 'code_' || code_id, 'flag_' || flag, CASE access WHEN 'write' THEN 'writes_flag' ELSE 'reads_flag' END, 14, pos FROM uses
  UNION ALL SELECT 'room_' || (SELECT min(id) FROM rooms), 'room_' || room_id, 'connected_to', 15, pos FROM moves
  UNION ALL SELECT 'code_' || code_id, 'room_' || room_id, 'connected_to', 16, pos FROM moves
  UNION ALL SELECT 'code_' || code_id, 'obj_' || value_int, 'creates', 18, pos FROM instructions WHERE opcode = 'INSTANTIATE' AND value_int IN (SELECT id FROM objects)
  UNION ALL SELECT 'code_' || a.code_id, 'obj_' || a.oid, 'creates', 19, a.pos FROM obj_arg a JOIN fclass c ON c.func_id = a.value_func_id WHERE a.opcode IN {_calls} AND (c.creation OR c."execute")
  UNION ALL SELECT 'code_' || code_id, 'obj_' || o.id, 'asset_get_index_ref', 20, pos FROM called JOIN last_o o ON arg.op = 'PUSHSTR' AND o.name = arg.s WHERE asset
  UNION ALL SELECT 'code_' || code_id, 'snd_' || o.id, 'references_sound', 21, pos FROM called JOIN last_s o ON arg.op = 'PUSHSTR' AND o.name = arg.s WHERE sound
  UNION ALL SELECT 'code_' || code_id, 'room_' || o.id, 'connected_to', 22, pos FROM called JOIN last_r o ON arg.op = 'PUSHSTR' AND o.name = arg.s WHERE NOT coalesce(makes, false)
  UNION ALL SELECT 'code_' || code_id, 'obj_' || arg.i, 'with_reference', 23, pos FROM seen7 WHERE opcode = 'WITH' AND arg.op = 'PUSHI' AND arg.i IN (SELECT id FROM objects)
  UNION ALL SELECT 'code_' || code_id, 'obj_' || value_int, 'references_object', 24, pos FROM instructions WHERE opcode = 'PUSHI' AND value_int IN (SELECT id FROM objects)
  UNION ALL SELECT 'code_' || code_id, n.target, n.rel, 25, pos FROM instructions JOIN named n ON n.name = value_str WHERE opcode = 'PUSHSTR' AND value_str_id >= 0
  UNION ALL SELECT 'code_' || code_id, 'str_' || value_str_id, 'references', 26, pos FROM instructions WHERE opcode = 'PUSHSTR' AND value_str_id IN (SELECT id FROM strings)),
nodes AS (
  SELECT 'obj_' || id AS node_id, 'object' AS type, name, CAST(id AS varchar) AS id FROM objects UNION ALL SELECT 'room_' || id, 'room', name, CAST(id AS varchar) FROM rooms
  UNION ALL SELECT 'spr_' || id, 'sprite', name, CAST(id AS varchar) FROM sprites UNION ALL SELECT 'snd_' || id, 'sound', name, CAST(id AS varchar) FROM sounds
  UNION ALL SELECT 'var_' || id, 'variable', name, CAST(id AS varchar) FROM variables UNION ALL SELECT 'code_' || code_id, 'code', owner, CAST(code_id AS varchar) FROM own
  UNION ALL SELECT 'func_' || id, 'function', CASE WHEN name <> '' THEN name ELSE 'func_' || id END, CAST(id AS varchar) FROM functions
  UNION ALL SELECT 'str_' || id, 'string', substr(value, 1, 60), CAST(id AS varchar) FROM strings UNION ALL SELECT 'inst_' || instance_id, 'instance', NULL, CAST(instance_id AS varchar) FROM instances
  UNION ALL SELECT DISTINCT 'flag_' || flag, 'flag', CASE WHEN flag < 0 THEN 'flag[?]' ELSE 'flag[' || flag || ']' END, CAST(flag AS varchar) FROM uses
  UNION ALL SELECT DISTINCT CASE owner_type WHEN 3 THEN 'global_' WHEN 4 THEN 'seq_' ELSE 'timeline_' END || substr(owner, strpos(owner, '::') + 2), CASE owner_type WHEN 3 THEN 'global_script' WHEN 4 THEN 'seq' ELSE 'timeline' END,
    substr(owner, strpos(owner, '::') + 2), NULL FROM own WHERE owner_type IN (3, 4, 5)),
deg AS (SELECT n.node_id, coalesce(sum(e.i), 0)::BIGINT AS in_degree, coalesce(sum(e.o), 0)::BIGINT AS out_degree FROM nodes n
  LEFT JOIN (SELECT dst AS node_id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) e ON e.node_id = n.node_id GROUP BY n.node_id),
room_view AS (SELECT DISTINCT src, dst FROM edges WHERE relation = 'connected_to'),
room_src AS (SELECT DISTINCT src AS node_id FROM room_view WHERE src NOT IN (SELECT dst FROM room_view)),
room_reach AS (SELECT node_id FROM room_src UNION SELECT v.dst FROM room_reach r JOIN room_view v ON v.src = r.node_id),
lost AS (SELECT id, name FROM rooms WHERE 'room_' || id NOT IN (SELECT node_id FROM room_reach) AND ((SELECT count(*) FROM room_view) = 0 OR (SELECT count(*) FROM room_src) > 0)),
root AS (SELECT node_id FROM nodes WHERE type = 'object' AND (node_id IN (SELECT src FROM edges WHERE relation = 'has_event') OR node_id IN (SELECT dst FROM edges)) UNION SELECT node_id FROM nodes WHERE type IN ('room', 'script')),
simple AS (SELECT DISTINCT src, dst FROM edges),
reach AS (SELECT node_id FROM root UNION SELECT v.dst FROM reach r JOIN simple v ON v.src = r.node_id) """
)
_names = ", ".join(f"'{n}'" for n in SUSPICIOUS_NAMES)
_part = f"list_filter([{_names}], lambda p: contains(lower(name), p))[1]"


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(star_game(spark, sf_dir))


def _of(f: Callable[[Engine], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_engine(spark, sf_dir))


# -- resolution --------------------------------------------------------------------------------------------------------
_query("code_owners", GRAPH + "SELECT code_id, owner, owner_type, object_id FROM own")(_of(lambda e: resolve.owners(e.game)))
_query("entry_points", GRAPH + "SELECT * FROM entry")(_of(lambda e: resolve.entry_points(e.game)))
_query("calls", GRAPH + "SELECT * FROM call")(_of(lambda e: resolve.calls(e.game)))
_query("function_classes", GRAPH + "SELECT * FROM fclass")(_of(lambda e: resolve.function_classes(e.game.functions)))
_query("flag_uses", GRAPH + "SELECT * FROM uses")(_of(lambda e: resolve.flag_uses(e.game)))
_query("room_transitions", GRAPH + "SELECT code_id, pos, room_id FROM moves")(_of(lambda e: resolve.room_transitions(e.game)))
_query("object_arguments", GRAPH + f"SELECT code_id, pos, oid AS object_id FROM obj_arg WHERE opcode IN {_calls}")(_of(lambda e: resolve.object_arguments(e.game, resolve.look_back(e.game, 7)).where(resolve.is_call(F.col("opcode"))).select("code_id", "pos", "object_id")))
# -- graph reads -------------------------------------------------------------------------------------------------------
_query("edges", GRAPH + "SELECT src, dst, relation, rule, seq::BIGINT AS seq FROM edges")(_of(lambda e: e.graph.edges))
_query("nodes", GRAPH + "SELECT node_id, type, name, id FROM nodes")(_of(lambda e: e.graph.nodes.select("node_id", "type", "name", "id")))
_query("relation_counts", GRAPH + "SELECT relation, count(*) AS n FROM edges GROUP BY 1")(_of(lambda e: e.relation_counts()))
_query("find", GRAPH + "SELECT node_id, name FROM nodes WHERE type = 'object' AND contains(lower(name), 'blue')")(_of(lambda e: e.graph.find("object", "Blue").select("node_id", "name")))
_query("find_edges", GRAPH + "SELECT src, dst, s.name AS src_name, s.type AS src_type, d.name AS dst_name, d.type AS dst_type FROM edges LEFT JOIN nodes s ON s.node_id = src LEFT JOIN nodes d ON d.node_id = dst WHERE relation = 'writes_flag'")(_of(lambda e: e.graph.find_edges("writes_flag").select("src", "dst", "src_name", "src_type", "dst_name", "dst_type")))
_query("incoming", GRAPH + "SELECT dst AS node, relation, src AS source, coalesce(n.type, '?') AS type, coalesce(n.name, src) AS name FROM edges LEFT JOIN nodes n ON n.node_id = src WHERE dst IN (SELECT node_id FROM nodes WHERE type = 'room')")(_of(lambda e: e.graph.incoming(e.graph.find("room")).drop("rule", "seq")))
_query("outgoing", GRAPH + "SELECT src AS node, relation, dst AS target, coalesce(n.type, '?') AS type, coalesce(n.name, dst) AS name FROM edges LEFT JOIN nodes n ON n.node_id = dst WHERE src IN (SELECT node_id FROM nodes WHERE type = 'code')")(_of(lambda e: e.graph.outgoing(e.graph.find("code")).drop("rule", "seq")))
_query("neighbors", GRAPH + "SELECT dst AS node, src AS neighbor FROM edges WHERE dst LIKE 'room%' UNION SELECT src, dst FROM edges WHERE src LIKE 'room%'")(_of(lambda e: e.graph.neighbors(e.graph.find("room"))))
_query("node_info", GRAPH + "SELECT n.node_id, type, name, id, in_degree, out_degree FROM nodes n JOIN deg d ON d.node_id = n.node_id")(_of(lambda e: e.graph.node_info().select("node_id", "type", "name", "id", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"))))
_query("roots", GRAPH + "SELECT node_id, type FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)")(_of(lambda e: e.graph.roots().select("node_id", "type")))
_query("leaves", GRAPH + "SELECT node_id, type FROM nodes WHERE node_id NOT IN (SELECT src FROM edges)")(_of(lambda e: e.graph.leaves().select("node_id", "type")))
for _v, _w in (("room", "relation = 'connected_to'"), ("call", "relation = 'calls'"), ("object", "relation IN ('contains', 'is_instance_of', 'uses_sprite', 'inherits', 'placed_in')"), ("flag", "relation IN ('reads_flag', 'writes_flag')")):
    _query(f"view_{_v}", GRAPH + f"SELECT DISTINCT src, dst FROM edges WHERE {_w}")(_of(lambda e, v=_v: e.graph.view(v)))
# -- searches ----------------------------------------------------------------------------------------------------------
_query("reachable_from", GRAPH.replace("reach AS (SELECT node_id FROM root ", "reach AS (SELECT 'obj_7' AS node_id ") + "SELECT node_id FROM reach")(_of(lambda e: g.reachable(e.graph.edges, e.graph.nodes.where("node_id = 'obj_7'"))))
_query("reaching", GRAPH.replace("reach AS (SELECT node_id FROM root UNION SELECT v.dst FROM reach r JOIN simple v ON v.src = r.node_id)", "reach AS (SELECT 'spr_9' AS node_id UNION SELECT v.src FROM reach r JOIN simple v ON v.dst = r.node_id)") + "SELECT node_id FROM reach WHERE node_id <> 'spr_9'")(_of(lambda e: g.reaching(e.graph.edges, e.graph.nodes.where("node_id = 'spr_9'"))))
_query("unreachable_rooms", GRAPH + "SELECT id, name FROM lost")(_of(lambda e: e.unreachable_rooms()))
_query("dead_resources", GRAPH + "SELECT type, name, node_id FROM nodes WHERE type IN ('object', 'room', 'sprite', 'sound', 'script') AND node_id NOT IN (SELECT node_id FROM reach)")(_of(lambda e: e.dead_resources()))
_query("room_components", GRAPH + """, u AS (SELECT src AS a, dst AS b FROM room_view UNION SELECT dst, src FROM room_view), cc AS (SELECT a, a AS b FROM u UNION SELECT c.a, u.b FROM cc c JOIN u ON u.a = c.b)
SELECT a AS node_id, min(b) AS component FROM cc GROUP BY a""")(_of(lambda e: g.weak_components(e.graph.view("room"))))
_query("object_cycles", GRAPH + """, v AS (SELECT DISTINCT src, dst FROM edges WHERE relation = 'collision_reference'),
p AS (SELECT [src, dst] AS path FROM v WHERE dst >= src UNION ALL SELECT list_append(path, dst) FROM p JOIN v ON v.src = list_last(path) WHERE len(path) <= 3 AND (len(path) < 2 OR path[1] <> list_last(path)) AND dst >= path[1] AND (dst = path[1] OR NOT list_contains(path, dst)))
SELECT (len(path) - 1)::INT AS length, array_to_string(path, ' > ') AS cycle FROM p WHERE path[1] = list_last(path)""")(_of(lambda e: g.cycles(e.graph.edges.where("relation = 'collision_reference'"), 3)))


@_query("shortest_path", GRAPH + """, d AS (SELECT 'room_0' AS node_id, 0 AS dist UNION SELECT v.dst, dist + 1 FROM d JOIN simple v ON v.src = d.node_id WHERE dist < 8),
near AS (SELECT node_id, min(dist) AS dist FROM d GROUP BY 1), back AS (SELECT 'spr_9' AS node_id, (SELECT dist FROM near WHERE node_id = 'spr_9') AS dist
  UNION ALL SELECT (SELECT min(v.src) FROM simple v JOIN near n ON n.node_id = v.src AND n.dist = b.dist - 1 WHERE v.dst = b.node_id), b.dist - 1 FROM back b WHERE b.dist > 0)
SELECT dist::INT AS step, node_id FROM back WHERE dist IS NOT NULL""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir)
    path = g.shortest_path(e.graph.edges, "room_0", "spr_9")
    return spark.createDataFrame(list(enumerate(path)), "step int, node_id string")


# -- questions ---------------------------------------------------------------------------------------------------------
_query("trace", GRAPH + """, hit AS (SELECT node_id, type, name FROM nodes WHERE name = (SELECT min(name) FROM rooms) OR node_id = (SELECT min(name) FROM rooms)),
told AS (SELECT src AS node, 0 AS side, '→ ' || relation || ' ' || coalesce(n.name, dst) AS said, rule, seq FROM edges LEFT JOIN nodes n ON n.node_id = dst WHERE src IN (SELECT node_id FROM hit)
  UNION ALL SELECT dst, 1, '← ' || relation || ' ' || coalesce(n.name, src), rule, seq FROM edges LEFT JOIN nodes n ON n.node_id = src WHERE dst IN (SELECT node_id FROM hit)),
ord AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY side, rule, seq, said) AS nth FROM told)
SELECT h.node_id, any_value(h.type) AS type, any_value(h.name) AS name, coalesce(string_agg(CASE WHEN nth <= 12 THEN said END, '; ' ORDER BY nth), 'Isolated node') AS edges, count(o.node)::BIGINT AS edge_count FROM hit h LEFT JOIN ord o ON o.node = h.node_id GROUP BY h.node_id""")(_of(lambda e: e.trace(e.game.rooms.agg(F.min("name")).first()[0])))
_query("who_uses", GRAPH + """, t AS (SELECT node_id FROM nodes WHERE name = 'spr_7' OR node_id = 'spr_7'), r AS (
  SELECT CASE n.type WHEN 'object' THEN 'objects' WHEN 'code' THEN 'bytecode' WHEN 'room' THEN 'rooms' WHEN 'sprite' THEN 'sprites' WHEN 'script' THEN 'scripts' WHEN 'function' THEN 'functions' WHEN 'string' THEN 'strings' WHEN 'flag' THEN 'flags' WHEN 'instance' THEN 'creation_code' ELSE 'bytecode' END AS bucket, coalesce(n.name, src) || ' (' || relation || ')' AS entry FROM edges LEFT JOIN nodes n ON n.node_id = src WHERE dst IN (SELECT node_id FROM t)
  UNION SELECT CASE n.type WHEN 'sprite' THEN 'sprites' WHEN 'sound' THEN 'sounds' ELSE 'bytecode' END, coalesce(n.name, dst) || ' (' || relation || ')' FROM edges JOIN nodes n ON n.node_id = dst WHERE src IN (SELECT node_id FROM t) AND n.type IN ('sprite', 'sound', 'code'))
SELECT bucket, entry FROM r QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY entry) <= 30""")(_of(lambda e: e.who_uses("spr_7")))
_query("why_objects", GRAPH + """SELECT o.id, o.name, coalesce(s.name, 'None') AS sprite, coalesce(p.name, 'None') AS parent,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT r.name))[1:20], ', ') FROM instances i JOIN rooms r ON r.id = i.room_id WHERE i.object_id = o.id), '') AS rooms,
  (SELECT count(*) FROM instances i JOIN rooms r ON r.id = i.room_id WHERE i.object_id = o.id) AS placed, (SELECT count(*) FROM edges WHERE relation = 'creates' AND dst = 'obj_' || o.id) AS created_by,
  (SELECT count(*) FROM edges WHERE relation = 'inherits' AND dst = 'obj_' || o.id) AS children, (SELECT count(*) FROM object_events v WHERE v.object_id = o.id) AS events, d.in_degree, d.out_degree
FROM objects o LEFT JOIN sprites s ON s.id = o.sprite_index LEFT JOIN objects p ON p.id = o.parent_index JOIN deg d ON d.node_id = 'obj_' || o.id""")(_of(lambda e: e.why_objects()))
_query("show_rooms", GRAPH + """SELECT r.id, r.name, width || 'x' || height AS size, speed, persistent, creation_code_id >= 0 AS has_creation_code, r.id NOT IN (SELECT id FROM lost) AS reachable,
  coalesce(c.n, 0) AS instances, coalesce(c.k, 0)::BIGINT AS coded, coalesce(c.o, 0) AS objects, in_degree, out_degree FROM rooms r JOIN deg d ON d.node_id = 'room_' || r.id
  LEFT JOIN (SELECT room_id, count(*) AS n, sum((creation_code_id >= 0)::INT) AS k, count(DISTINCT object_id) AS o FROM instances GROUP BY 1) c ON c.room_id = r.id""")(_of(lambda e: e.show_rooms()))
_query("flag_users", GRAPH + """SELECT flag, nth::INT AS nth, entry FROM (SELECT flag, owner || CASE access WHEN 'write' THEN ' — writes' ELSE ' — reads' END AS entry, row_number() OVER (PARTITION BY flag ORDER BY CASE access WHEN 'write' THEN 0 ELSE 1 END, u.code_id, pos) AS nth
  FROM uses u JOIN own o ON o.code_id = u.code_id) WHERE nth <= 30""")(_of(lambda e: e.flag_users()))
_flags = "fc AS (SELECT flag, count(*) FILTER (access = 'read') AS reads, count(*) FILTER (access = 'write') AS writes FROM uses WHERE flag >= 0 GROUP BY 1), fs AS (SELECT *, CASE WHEN writes = 0 THEN 'read_only' WHEN reads = 0 THEN 'write_only' ELSE 'used' END AS state FROM fc) "
_query("flag_counts", GRAPH + ", " + _flags + "SELECT * FROM fs")(_of(lambda e: e.flag_counts()))
_query("flag_analysis", GRAPH + ", " + _flags + """SELECT count(*) AS flags, sum(reads)::BIGINT AS reads, sum(writes)::BIGINT AS writes, count(*) FILTER (state = 'read_only') AS read_only, count(*) FILTER (state = 'write_only') AS write_only,
  coalesce(array_to_string(list_sort(list(flag) FILTER (state = 'read_only'))[1:50], ','), '') AS first_read_only, coalesce(array_to_string(list_sort(list(flag) FILTER (state = 'write_only'))[1:50], ','), '') AS first_write_only FROM fs""")(_of(lambda e: e.flag_analysis()))
_query("unused_strings", GRAPH + "SELECT node_id, 'str[' || id || ']' AS label, substr(name, 1, 80) AS text FROM nodes WHERE type = 'string' AND node_id NOT IN (SELECT dst FROM edges WHERE relation = 'references') ORDER BY id::BIGINT LIMIT 200")(_of(lambda e: e.unused_strings()))
_query("suspicious", GRAPH + f""", sane AS (SELECT dst AS node_id FROM edges WHERE relation IN ('is_instance_of', 'creates', 'inherits', 'with_reference', 'references_object', 'references', 'asset_get_index_ref') UNION SELECT src FROM edges WHERE relation IN ('has_event', 'inherits', 'collision_reference')),
odd AS (SELECT n.node_id, name, {_part} AS part, contains(lower(name), 'controller') OR contains(lower(name), 'ctrl') AS ctl, in_degree AS i, out_degree AS o FROM nodes n JOIN deg d ON d.node_id = n.node_id WHERE type = 'object' AND n.node_id NOT IN (SELECT node_id FROM sane)),
oe AS (SELECT node_id, name, concat_ws('; ', CASE WHEN part IS NOT NULL THEN 'suspicious name pattern: ''' || part || '''' END, CASE WHEN part IS NULL AND NOT ctl AND i = 0 AND o = 0 THEN 'completely isolated (no edges)' WHEN part IS NULL AND NOT ctl AND i = 0 THEN 'no incoming references from graph' END, CASE WHEN part IS NULL AND NOT ctl AND o = 0 THEN 'no outgoing relationships' END) AS reasons, ctl FROM odd)
SELECT 0 AS rank, node_id, name, 'OBJECT' AS resource_type, 35 AS confidence, reasons, '' AS against FROM oe WHERE NOT ctl AND reasons <> ''
UNION ALL SELECT 1, 'room_' || l.id, l.name, 'ROOM', 35, 'no incoming room transitions', '' FROM lost l JOIN rooms r ON r.id = l.id WHERE r.creation_code_id < 0 AND l.id NOT IN (SELECT room_id FROM instances)
UNION ALL SELECT 2, node_id, name, 'SPRITE', 35, 'no object uses this sprite; suspicious name: ''' || {_part} || '''', '' FROM nodes WHERE type = 'sprite' AND node_id NOT IN (SELECT dst FROM edges) AND {_part} IS NOT NULL
UNION ALL SELECT 3, node_id, name, 'SOUND', 35, 'sound never played; suspicious name: ''' || {_part} || '''', '' FROM nodes WHERE type = 'sound' AND node_id NOT IN (SELECT dst FROM edges WHERE relation = 'references_sound') AND {_part} IS NOT NULL""")(_of(lambda e: e.suspicious()))
_query("summary", GRAPH + " UNION ALL ".join(f"SELECT '{n}' AS metric, count(*) AS n FROM {n}" for n in ("objects", "object_events", "rooms", "instances", "sprites", "sounds", "strings", "functions", "variables", "code", "instructions")))(_of(lambda e: e.summary()))
# -- usage and validation ----------------------------------------------------------------------------------------------
_bit = usage.BIT
_query("object_states", GRAPH + f""", cc AS (SELECT creation_code_id AS k FROM rooms WHERE creation_code_id >= 0 UNION SELECT creation_code_id FROM instances WHERE creation_code_id >= 0), near AS (SELECT s.*, c.asset FROM seen4 s LEFT JOIN fclass c ON c.func_id = s.value_func_id),
b AS (SELECT object_id AS o, {_bit["ROOM_PLACED"]} AS bit FROM instances UNION ALL SELECT value_int, {_bit["INSTANTIATE_CREATED"] | _bit["CREATED_DYNAMICALLY"]} FROM instructions WHERE opcode = 'INSTANTIATE'
  UNION ALL SELECT a.oid, {_bit["FUNCTION_CREATED"] | _bit["CREATED_DYNAMICALLY"]} FROM obj_arg a JOIN fclass c ON c.func_id = a.value_func_id WHERE a.opcode IN {_calls} AND (c.creation OR c."execute") AND (a.arg.op <> 'PUSHSTR' OR regexp_matches(a.arg.s, '^(obj_|_)'))
  UNION ALL SELECT o.id, {_bit["ASSET_GET_REFERENCED"]} FROM near n JOIN last_o o ON n.arg.op = 'PUSHSTR' AND o.name = n.arg.s WHERE n.opcode IN {_calls} AND n.asset AND regexp_matches(n.arg.s, '^(obj_|_)')
  UNION ALL SELECT arg.i, {_bit["WITH_REFERENCED"]} FROM seen4 WHERE opcode = 'WITH' AND arg.op = 'PUSHI' UNION ALL SELECT value_int, {_bit["BYTECODE_REFERENCED"]} FROM instructions WHERE opcode = 'PUSHI'
  UNION ALL SELECT o.id, {_bit["STRING_REFERENCED"]} FROM instructions i JOIN last_o o ON o.name = i.value_str WHERE opcode = 'PUSHSTR' UNION ALL SELECT value_int, {_bit["CREATION_CODE_REFERENCED"]} FROM instructions WHERE opcode = 'PUSHI' AND code_id IN (SELECT k FROM cc)
  UNION ALL SELECT id, {_bit["INHERITED"]} FROM objects WHERE parent_index IN (SELECT id FROM objects) UNION ALL SELECT parent_index, {_bit["PARENT_OF"]} FROM objects UNION ALL SELECT subtype, {_bit["COLLISION_REFERENCED"]} FROM object_events WHERE event_type = 4
  UNION ALL SELECT id, {_bit["HAS_SPRITE"]} FROM objects WHERE sprite_index >= 0 UNION ALL SELECT object_id, {_bit["HAS_EVENTS"]} FROM object_events),
m AS (SELECT o.id AS object_id, name, coalesce(bit_or(bit), 0)::BIGINT AS mask FROM objects o LEFT JOIN b ON b.o = o.id GROUP BY o.id, name)
SELECT object_id, name, CASE WHEN mask & {usage.ALIVE} <> 0 THEN mask WHEN mask & {_bit["HAS_EVENTS"] | _bit["HAS_SPRITE"]} <> 0 THEN mask | {_bit["LIKELY_UNUSED"]} ELSE mask | {_bit["UNUSED"]} END AS mask, mask & {usage.ALIVE} <> 0 AS alive FROM m""")(_of(lambda e: usage.object_states(e.game).drop("labels")))
_query("dialogue_strings", GRAPH + """, w AS (SELECT code_id, pos, opcode, value_func_id, list(CASE WHEN opcode = 'PUSHSTR' AND value_str_id >= 0 THEN value_str_id END) OVER (PARTITION BY code_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l FROM instructions)
SELECT code_id, pos, unnest(list_filter(l, lambda x: x IS NOT NULL)[-3:]) AS string_id FROM w JOIN functions f ON f.id = value_func_id WHERE opcode IN ('CALL', 'CALLV', 'CALLVN') AND contains(lower(f.name), 'dialogue')""")(_of(lambda e: usage.dialogue_strings(e.game)))
_query("validation", GRAPH + """, i AS (SELECT 'objects' AS category, 'error' AS severity FROM objects WHERE sprite_index >= 0 AND sprite_index NOT IN (SELECT id FROM sprites)
  UNION ALL SELECT 'objects', 'error' FROM objects WHERE parent_index >= 0 AND parent_index NOT IN (SELECT id FROM objects) UNION ALL SELECT 'objects', 'warning' FROM object_events WHERE code_id NOT IN (SELECT id FROM code)
  UNION ALL SELECT 'rooms', 'error' FROM rooms WHERE creation_code_id >= 0 AND creation_code_id NOT IN (SELECT id FROM code) UNION ALL SELECT 'rooms', 'info' FROM rooms WHERE id NOT IN (SELECT room_id FROM instances)
  UNION ALL SELECT 'rooms', 'error' FROM instances WHERE object_id NOT IN (SELECT id FROM objects) UNION ALL SELECT 'rooms', 'error' FROM instances WHERE creation_code_id >= 0 AND creation_code_id NOT IN (SELECT id FROM code)
  UNION ALL SELECT 'ownership', 'warning' FROM own WHERE owner_type = -1 UNION ALL SELECT 'ownership', 'warning' FROM functions f WHERE code_offset > 0 AND NOT EXISTS (SELECT 1 FROM code c WHERE f.code_offset >= c."offset" AND f.code_offset < c."offset" + c.length)
  UNION ALL SELECT 'calls', 'info' FROM code WHERE id NOT IN (SELECT caller FROM call) AND id NOT IN (SELECT callee FROM call WHERE callee IS NOT NULL)
  UNION ALL SELECT 'usage', 'info' FROM objects WHERE sprite_index < 0
  UNION ALL SELECT 'flags', 'warning' FROM (SELECT flag FROM uses WHERE flag >= 0 GROUP BY flag HAVING count(*) FILTER (access = 'write') = 0))
SELECT category, severity, count(*) AS n FROM i GROUP BY ALL""")(_of(lambda e: validate.totals(validate.validate(e.game).where("category not in ('chunks', 'strings')"))))
# -- lists, reports and checks -----------------------------------------------------------------------------------------
_query("opcode_groups", GRAPH + "SELECT opcode, " + ", ".join(f"opcode IN {names!r} AS {group}".replace(",)", ")") for group, names in GROUPS.items()) + ", count(*) AS n FROM instructions GROUP BY opcode")(_of(lambda e: e.game.instructions.groupBy("opcode").agg(F.count("*").alias("n")).select("opcode", *[in_group(F.col("opcode"), group).alias(group) for group in GROUPS], "n")))
_query("object_lists", GRAPH + """, i AS (SELECT dst, src, relation, coalesce(n.name, src) AS name, rule, seq FROM edges LEFT JOIN nodes n ON n.node_id = src WHERE dst IN (SELECT 'obj_' || id FROM objects)),
t AS (SELECT 'obj_' || object_id AS node_id, 'placed_in' AS part, r.name AS entry, 1 AS rule, instance_id AS seq FROM instances JOIN rooms r ON r.id = room_id WHERE object_id IN (SELECT id FROM objects)
  UNION ALL SELECT dst, 'created_by', name || ' (' || src || ')', rule, seq FROM i WHERE relation = 'creates' UNION ALL SELECT dst, 'child', name, rule, seq FROM i WHERE relation = 'inherits'
  UNION ALL SELECT 'obj_' || object_id, 'event', event_type || ',' || subtype, event_type, subtype FROM object_events UNION ALL SELECT dst, 'incoming', name || ' (' || relation || ')', rule, seq FROM i
  UNION ALL SELECT src, 'outgoing', coalesce(n.name, dst) || ' (' || relation || ')', rule, seq FROM edges LEFT JOIN nodes n ON n.node_id = dst WHERE src IN (SELECT 'obj_' || id FROM objects))
SELECT substr(node_id, 5)::BIGINT AS object_id, part, row_number() OVER (PARTITION BY node_id, part ORDER BY rule, seq, entry)::INT AS nth, entry FROM t
QUALIFY nth <= CASE part WHEN 'event' THEN 30 WHEN 'child' THEN 20 WHEN 'incoming' THEN 15 WHEN 'outgoing' THEN 15 ELSE nth END""")(_of(lambda e: detail.object_lists(e)))
_query("room_instances", GRAPH + "SELECT room_id, instance_id, coalesce(o.name, '?') AS object, x, y, c.id IS NOT NULL AS has_creation_code FROM instances LEFT JOIN objects o ON o.id = object_id LEFT JOIN code c ON c.id = creation_code_id")(_of(lambda e: detail.room_instances(e)))
_query("room_lists", GRAPH + """, t AS (SELECT dst AS node_id, 'incoming' AS part, coalesce(n.name, src) || ' (' || relation || ')' AS entry, rule, seq FROM edges LEFT JOIN nodes n ON n.node_id = src WHERE dst IN (SELECT 'room_' || id FROM rooms)
  UNION ALL SELECT src, 'outgoing', coalesce(n.name, dst) || ' (' || relation || ')', rule, seq FROM edges LEFT JOIN nodes n ON n.node_id = dst WHERE src IN (SELECT 'room_' || id FROM rooms)),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY node_id, part ORDER BY rule, seq, entry) <= 20),
u AS (SELECT node_id, part, entry, rule, seq FROM f WHERE part = 'incoming' OR rule <> 1
  UNION ALL SELECT 'room_' || room_id, 'instance', coalesce(o.name, '?') || ' #' || instance_id || ' at ' || x || ',' || y || CASE WHEN c.id IS NOT NULL THEN ' with code' ELSE '' END, 1, instance_id FROM instances LEFT JOIN objects o ON o.id = object_id LEFT JOIN code c ON c.id = creation_code_id)
SELECT substr(node_id, 6)::BIGINT AS room_id, part, row_number() OVER (PARTITION BY node_id, part ORDER BY rule, seq, entry)::INT AS nth, entry FROM u""")(_of(lambda e: detail.room_lists(e)))
_named = " ".join(f"WHEN {n} THEN '{name}'" for n, name in enumerate(EVENT_NAMES))
_query("event_summaries", GRAPH + f"""SELECT object_id, count(*) AS events, bool_or(event_type = 0 AND subtype = 0) AS has_create, bool_or(event_type = 3 AND subtype = 0) AS has_step, bool_or(event_type = 8 AND subtype = 0) AS has_draw, bool_or(event_type = 2) AS has_alarm,
  string_agg(coalesce(CASE event_type {_named} END, 'EV_' || event_type) || CASE WHEN subtype > 0 THEN '(' || subtype || ')' ELSE '' END, ', ' ORDER BY event_type, subtype) AS summary FROM object_events GROUP BY object_id""")(_of(lambda e: detail.event_summaries(e.game)))
_owned = {"scripts": 0, "object_events": 1, "room_code": 2, "global_scripts": 3, "sequence_callbacks": 4, "timeline_code": 5, "unknown_code": -1}
_report = {
    "objects_loaded": "count(*)::VARCHAR FROM objects", "objects_resolved": "count(*)::VARCHAR FROM objects", "events_total": "count(*)::VARCHAR FROM object_events",
    "parents_resolved": "count(*) FILTER (parent_index >= 0 AND parent_index IN (SELECT id FROM objects)) || '/' || count(*) FROM objects",
    "sprites_resolved": "count(*) FILTER (sprite_index >= 0 AND sprite_index IN (SELECT id FROM sprites)) || '/' || count(*) FROM objects",
    "masks_resolved": "count(*) FILTER (mask_index >= 0 AND mask_index IN (SELECT id FROM sprites)) || '/' || count(*) FROM objects",
    "room_instances": "count(*)::VARCHAR FROM instances", "room_placements": "count(*)::VARCHAR FROM instances", "room_creation_code": "count(*)::VARCHAR FROM rooms WHERE creation_code_id IN (SELECT id FROM code)",
    "functions_total": "count(*)::VARCHAR FROM functions", "code_entries_total": "count(*)::VARCHAR FROM code", "code_ownership_resolved": "(SELECT count(*) FROM own) || '/' || count(*) FROM code",
    "call_nodes": "count(*)::VARCHAR FROM code", "call_edges": "count(*)::VARCHAR FROM (SELECT DISTINCT caller, callee FROM call WHERE callee IS NOT NULL)",
    "room_nodes": "count(*)::VARCHAR FROM rooms", "room_edges": "count(*)::VARCHAR FROM moves",
    "broken_script_refs": "count(*)::VARCHAR FROM call WHERE func_id < (SELECT count(*) FROM code) AND func_id NOT IN (SELECT id FROM code)",
} | {metric: f"count(*)::VARCHAR FROM own WHERE owner_type = {number}" for metric, number in _owned.items()}
_query("resolver_report", GRAPH + " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT {v}) AS value" for m, v in _report.items()))(_of(lambda e: detail.resolver_report(e.game)))
_query("degree_classes", GRAPH + "SELECT node_id, CASE WHEN in_degree + out_degree = 0 THEN 'isolated' WHEN in_degree = 0 THEN 'source' ELSE 'sink' END AS class FROM deg WHERE in_degree = 0 OR out_degree = 0")(_of(lambda e: detail.degree_classes(e)))
_query("graph_issues", GRAPH + """, vc AS (SELECT DISTINCT src, dst FROM edges WHERE relation = 'calls'), vo AS (SELECT DISTINCT src, dst FROM edges WHERE relation IN ('contains', 'is_instance_of', 'uses_sprite', 'inherits', 'placed_in')), vf AS (SELECT DISTINCT src, dst FROM edges WHERE relation IN ('reads_flag', 'writes_flag')),
z AS (SELECT (SELECT count(*) FROM room_view) AS re, (SELECT count(DISTINCT room_id) FROM moves WHERE room_id IN (SELECT id FROM rooms)) AS rt, (SELECT count(*) FROM moves) AS rm, (SELECT count(*) FROM vc) AS ce, (SELECT count(*) FROM (SELECT DISTINCT caller, callee FROM call WHERE callee IS NOT NULL)) AS cm,
  (SELECT count(*) FROM vo) AS oe, (SELECT count(*) FROM (SELECT src FROM vo UNION SELECT dst FROM vo)) AS o, (SELECT count(*) FROM vf) AS fe, (SELECT count(*) FROM (SELECT src FROM vf UNION SELECT dst FROM vf)) AS f)
SELECT 'graph' AS category, 'info' AS severity, 'Object view: ' || o || ' nodes, ' || oe || ' edges' AS message FROM z UNION ALL SELECT 'graph', 'info', 'Flag view: ' || f || ' nodes, ' || fe || ' edges' FROM z
UNION ALL SELECT 'graph', 'error', 'Room moves were found, none to a room that exists' FROM z WHERE rm > 0 AND rt = 0 UNION ALL SELECT 'graph', 'warning', 'Room view has fewer edges than rooms are moved to: ' || re || ' of ' || rt FROM z WHERE rt > 0 AND re < rt
UNION ALL SELECT 'graph', 'warning', 'Call view has ' || ce || ' edges, resolution found ' || cm FROM z WHERE ce <> cm""")(_of(lambda e: detail.graph_issues(e)))
_query("creators", GRAPH + f"""SELECT value_int AS object_id, code_id FROM instructions WHERE opcode = 'INSTANTIATE' AND value_int IN (SELECT id FROM objects)
UNION SELECT a.oid, a.code_id FROM obj_arg a JOIN fclass c ON c.func_id = a.value_func_id WHERE a.opcode IN {_calls} AND (c.creation OR c."execute") AND (a.arg.op <> 'PUSHSTR' OR regexp_matches(a.arg.s, '^(obj_|_)'))""")(_of(lambda e: usage.creators(e.game)))
_talk = """, w AS (SELECT code_id, pos, opcode, value_func_id, list(CASE WHEN opcode = 'PUSHSTR' AND value_str_id >= 0 THEN value_str_id END) OVER (PARTITION BY code_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l FROM instructions),
shown AS (SELECT DISTINCT unnest(list_filter(l, lambda x: x IS NOT NULL)[-3:]) AS string_id FROM w JOIN functions f ON f.id = value_func_id WHERE opcode IN ('CALL', 'CALLV', 'CALLVN') AND contains(lower(f.name), 'dialogue')),
told AS (SELECT DISTINCT value_str_id AS string_id, value_str AS text FROM instructions WHERE opcode = 'PUSHSTR' AND value_str_id >= 0 AND length(value_str) > 3) """
_query("unused_dialogue", GRAPH + _talk + "SELECT string_id, text FROM told WHERE string_id NOT IN (SELECT string_id FROM shown)")(_of(lambda e: usage.unused_dialogue(e.game)))
_query("dialogue_summary", GRAPH + _talk + """SELECT 'total_dialogue_strings' AS metric, count(*) AS n FROM told UNION ALL SELECT 'referenced_strings', count(*) FROM shown
UNION ALL SELECT 'unused_strings', count(*) FROM told WHERE string_id NOT IN (SELECT string_id FROM shown)""")(_of(lambda e: usage.dialogue_summary(e.game)))
_query("graph_stats", None)(_of(lambda e: detail.graph_stats(e)))
