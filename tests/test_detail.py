"""Lists about objects and rooms, the resolver's report, degree classes, graph checks and the opcode catalogue."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from resgraph.functions.opcodes import GROUPS, OPCODES, catalogue, in_group, opcode_name
from resgraph.operators import detail, usage
from resgraph.operators.queries import Engine
from resgraph.plans.graph import Graph
from resgraph.session import cut
from tests.fixture import tiny_game


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(tiny_game(spark, object_events=[(0, 4, 1, 1)]))


def told(rows, part):
    return [r.entry for r in rows.where(F.col("part") == part).orderBy("nth").collect()]


def test_object_lists(engine):
    rows = detail.object_lists(engine, "obj_player").cache()
    assert told(rows, "placed_in") == ["room_start", "room_town"]
    assert told(rows, "event") == ["0,0", "3,0", "4,1"]
    assert told(rows, "incoming") == ["inst_100 (is_instance_of)", "inst_102 (is_instance_of)"]
    assert told(rows, "outgoing")[0] == "spr_player (uses_sprite)" and told(rows, "error") == []
    assert told(detail.object_lists(engine, "obj_base"), "child") == ["obj_door"]
    assert [tuple(r) for r in detail.object_lists(engine, "nobody's").collect()] == [(None, "error", 1, "Object 'nobody's' not found")]


def test_lists_are_cut_at_their_lengths(spark):
    many = [(0, 1000 + i, 5, 1, 1, -1) for i in range(40)]
    e = Engine(tiny_game(spark, instances=many, objects=[(50 + i, f"obj_kid_{i}", -1, -1, 5) for i in range(30)]))
    rows = detail.object_lists(e, "obj_menu_ctrl").cache()
    assert {p: rows.where(F.col("part") == p).count() for p in ("placed_in", "child", "incoming", "outgoing")} == {"placed_in": 40, "child": 20, "incoming": 15, "outgoing": 0}


def test_room_lists(engine):
    rows = detail.room_lists(engine, "room_start").cache()
    assert told(rows, "instance") == ["obj_player #100 at 10,20", "obj_door #101 at 30,40 with code"]
    assert told(rows, "outgoing") == ["room_town (connected_to)"] and told(rows, "incoming") == []
    assert detail.room_lists(engine, "nowhere").collect()[0].part == "error"


def test_room_lists_derive_no_whole_graph(spark):
    e = Engine(tiny_game(spark))
    assert detail.room_lists(e).count() > 0
    assert e._graph is None


@pytest.mark.parametrize("moves", [True, False])
def test_room_lists_against_whole_graph(spark, moves):
    """Few and many instances, an instance id in two rooms, rooms named by calls, objects and sounds, ties, ids repeated or absent."""
    many = [(2, 200 + i, i % 7, i, i, 4 if i % 5 == 0 else -1) for i in range(25)] + [(4, 300 + i, 0, 1, 1, 99) for i in range(19)]
    more = {
        "instances": [*many, (3, 300, 5, 1, 1, -1), (3, 301, None, 1, 1, -1), (9, 302, 0, 1, 1, -1)],
        "rooms": [(3, "obj_door", 1, 1, 1, False, 0), (4, "room_four", 1, 1, 1, False, 3), (5, "snd_ok", 1, 1, 1, False, 77), (6, "room_town", 1, 1, 1, False, 0), (7, None, 1, 1, 1, False, 1)],
    }
    if moves:
        said = ["room_town", "obj_door", "snd_ok", "room_four", "nothing", "room_void"]
        more["functions"] = [(3, "instance_create", 0), (4, "", 0)]
        more["instructions"] = [row for c in (2, 3, 9) for p in range(10, 100, 3) for row in (
            (c, p, "PUSHSTR", None, said[p % 6 if c < 9 else (p // 3) % 6], 1 if p % 4 else -1, -1, -1, 0), (c, p + 1, "PUSHBLTN" if p % 2 else "POPZ", None, None, -1, -1, -1, 0), (c, p + 2, "CALL", None, None, -1, p % 5, -1, 0))]
    else:
        more["functions"] = more["instructions"] = None
    e = Engine(tiny_game(spark, **more))
    got = sorted(tuple(r) for r in detail.room_lists(e).collect())
    names, rooms = {}, {r.id for r in e.game.rooms.collect()}
    for r in e.graph.nodes.collect():
        names.setdefault(r.node_id, []).append(r.name)
    sides = {}
    for r in e.graph.edges.collect():
        for part, at, other in (("incoming", r.dst, r.src), ("outgoing", r.src, r.dst)):
            for name in names.get(other, [None]):
                sides.setdefault((at, part), []).append((r.rule, r.seq, f"{name or other} ({r.relation})"))
    want = []
    for room in rooms:
        for part in ("incoming", "outgoing"):
            first = [x for x in sorted(sides.get((f"room_{room}", part), []))[:20] if part == "incoming" or x[0] != 1]
            want += [(room, part, n, x[2]) for n, x in enumerate(first, 1)]
    assert [r for r in got if r[1] != "instance"] == sorted(want)
    assert {17 in {r.rule for r in e.graph.edges.collect()}} == {not moves}
    objects, code = {r.id: r.name for r in e.game.objects.collect()}, {r.id for r in e.game.code.collect()}
    held = {}
    for r in e.game.instances.collect():
        held.setdefault(r.room_id, []).append((r.instance_id, f"{objects.get(r.object_id, '?')} #{r.instance_id} at {r.x},{r.y}{' with code' if r.creation_code_id in code else ''}"))
    assert [r for r in got if r[1] == "instance"] == sorted((room, "instance", n, x[1]) for room, rows in held.items() if room in rooms for n, x in enumerate(sorted(rows), 1))


def test_written_tables_leave_no_shuffle_files(spark):
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    before = files()
    cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_summaries_and_creators(engine):
    (row,) = detail.event_summaries(engine.game).collect()
    assert (row.object_id, row.events, row.has_create, row.has_step, row.has_draw, row.has_alarm, row.summary) == (0, 3, True, True, False, False, "Create, Step, Collision(1)")
    assert usage.creators(engine.game).count() == 0
    assert dict(usage.dialogue_summary(engine.game).collect()) == {"total_dialogue_strings": 2, "referenced_strings": 0, "unused_strings": 2}


def test_resolver_report(engine):
    got = dict(detail.resolver_report(engine.game).collect())
    assert len(got) == 24
    assert {k: got[k] for k in ("parents_resolved", "sprites_resolved", "masks_resolved", "events_total", "code_ownership_resolved", "room_code", "room_creation_code", "call_edges", "room_edges", "broken_script_refs")} == {
        "parents_resolved": "1/6", "sprites_resolved": "3/6", "masks_resolved": "0/6", "events_total": "3", "code_ownership_resolved": "5/5",
        "room_code": "2", "room_creation_code": "1", "call_edges": "0", "room_edges": "1", "broken_script_refs": "0",
    }


def test_degrees_and_graph(engine):
    kinds = {r.node_id: r["class"] for r in detail.degree_classes(engine).collect()}
    assert kinds["obj_3"] == kinds["str_2"] == "isolated" and kinds["room_0"] == "source" and kinds["str_0"] == "sink" and "obj_0" not in kinds
    stats = dict(detail.graph_stats(engine).collect())
    n, e = {r.node_id for r in engine.graph.nodes.collect()}, [(r.src, r.dst) for r in engine.graph.edges.collect()]
    group = {x: {x} for x in n | {x for p in e for x in p}}
    for a, b in e:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    assert stats == {"nodes": len(n), "edges": len(e), "components": len({id(g) for g in group.values()}), "isolated": len(n - {x for p in e for x in p})}
    assert {r.severity for r in detail.graph_issues(engine).collect()} == {"info"}


@pytest.mark.parametrize("moves", [True, False])
def test_graph_stats_against_whole_graph(spark, moves):
    """Instances that share an id, lack a room or an id, or name objects and code that don't exist; the whole graph isn't made."""
    more = {
        "instances": [(7, 700, 3, 1, 1, -1), (8, 700, 5, 1, 1, -1), (9, 901, 4, 1, 1, 77), (10, 902, 999, 1, 1, 2), (11, 903, 999, 1, 1, 2), (12, 904, None, 1, 1, -1), (13, 905, 998, 1, 1, 66),
            (None, 906, 2, 1, 1, -1), (None, 907, None, 1, 1, -1), (None, 901, 6, 1, 1, -1), (14, None, 7, 1, 1, -1), (None, None, 8, 1, 1, -1), (15, None, 9, 1, 1, 1), (1, 102, 0, 5, 5, -1)],
        "objects": [(n, f"obj_{n}", -1, -1, -1) for n in range(6, 12)], "rooms": [(n, f"room_{n}", 1, 1, 1, False, -1) for n in range(7, 18)],
    }
    if not moves:
        more["instructions"] = None
    e = Engine(tiny_game(spark, **more))
    stats = dict(detail.graph_stats(e).collect())
    assert e.graph.game is e.game
    nodes, edges = [r.node_id for r in e.graph.nodes.collect()], [(r.src, r.dst) for r in e.graph.edges.collect()]
    group = {x: {x} for x in {x for p in edges for x in p} - {None}}
    for a, b in edges:
        if a is not None and b is not None and group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    alone = len([x for x in nodes if x not in group])
    want = {"nodes": len(nodes), "edges": len(edges), "components": len({id(x) for x in group.values()}) + alone, "isolated": alone}
    assert stats == want and dict(detail.graph_stats(e).collect()) == want  # the second from the graph that is made by now
    assert dict(detail.graph_stats(Engine(e.game, Graph(e.graph.nodes, e.graph.edges))).collect()) == want


def test_empty_package(spark):
    e = Engine(tiny_game(spark, **dict.fromkeys(("objects", "object_events", "rooms", "instances", "code", "instructions"))))
    assert detail.object_lists(e).count() == detail.room_lists(e).count() == detail.event_summaries(e.game).count() == 0
    assert dict(detail.resolver_report(e.game).collect())["parents_resolved"] == "0/0"


def test_opcodes(spark):
    assert len(OPCODES) == 110 and opcode_name(46) == "INSTANTIATE" and opcode_name(200) == "UNKNOWN_200"
    assert all(name in OPCODES for names in GROUPS.values() for name in names)
    known = catalogue(spark)
    assert known.where("kind = 'opcode'").where(in_group(F.col("name"), "is_push")).count() == 8
    assert known.where("kind = 'if_kind' and number = 9").first().name == "IF_UNDEFINED"
