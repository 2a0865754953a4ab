"""The fixture's hand-computed answers, and invariants of the graph searches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from resgraph.operators import resolve
from resgraph.operators.queries import Engine
from resgraph.plans import graph as g
from tests.fixture import tiny_game


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(tiny_game(spark))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_owner_labels(engine):
    got = dict(resolve.owners(engine.game).select("code_id", "owner").collect())
    assert got == {0: "obj_player.event_0_0", 1: "obj_player.event_3_0", 2: "global_init::scr_init", 3: "room_creation::room_town_Create", 4: "room_cc::room"}


def test_sizes_and_relations(engine):
    assert engine.graph.nodes.count() == 32 and engine.graph.edges.count() == 29
    assert dict(engine.relation_counts().collect()) == {
        "contains": 3, "is_instance_of": 3, "has_creation_code": 2, "creates": 1, "inherits": 1, "uses_sprite": 3, "has_event": 2, "owns": 1,
        "calls_function": 4, "reads_flag": 2, "writes_flag": 1, "connected_to": 3, "references": 3,
    }


def test_degrees(engine):
    got = {r[0]: (r[1], r[2]) for r in engine.graph.degrees().collect()}
    assert got["obj_0"] == (2, 3) and got["room_1"] == (4, 2) and got["str_0"] == (1, 0)


def test_rooms_strings_dead(engine):
    assert rows(engine.unreachable_rooms()) == [(2, "room_void")]
    assert rows(engine.unused_strings()) == [("str_2", "str[2]", "never used")]
    assert rows(engine.dead_resources().select("type", "name")) == [
        ("object", "obj_menu_ctrl"), ("object", "obj_orphan"), ("object", "obj_test_dummy"), ("sound", "snd_beta_jingle"), ("sound", "snd_ok"), ("sprite", "spr_debug_box"), ("sprite", "spr_orphan"),
    ]


def test_suspicious_score_35(engine):
    got = rows(engine.suspicious().select("resource_type", "name", "confidence"))
    assert got == [("OBJECT", "obj_orphan", 35), ("OBJECT", "obj_test_dummy", 35), ("ROOM", "room_void", 35), ("SOUND", "snd_beta_jingle", 35), ("SPRITE", "spr_debug_box", 35)]


def test_flags_trace_uses(engine):
    assert rows(engine.flag_analysis()) == [(2, 2, 1, 1, 0, "88", "")]
    assert rows(engine.trace("room_town").select("node_id", "edge_count")) == [("room_1", 6), ("str_0", 1)]
    assert rows(engine.who_uses("spr_player")) == [("objects", "obj_player (uses_sprite)")]
    assert engine.trace("nothing like it").count() == 0


def test_look_back_stops(spark):
    ops = [(9, p, "PUSHBLTN", None, None, -1, -1, -1, 0) for p in range(1, 4)]
    near = tiny_game(spark, instructions=[(9, 0, "PUSHI", 5, None, -1, -1, -1, 0), *ops, (9, 4, "CALL", None, None, -1, 1, -1, 0)], code=[(9, "x", 900, 1)])
    far = tiny_game(spark, instructions=[(9, 0, "PUSHI", 5, None, -1, -1, -1, 0), *ops, (9, 4, "PUSHBLTN", None, None, -1, -1, -1, 0), (9, 5, "CALL", None, None, -1, 1, -1, 0)], code=[(9, "x", 900, 1)])
    assert [r.flag for r in resolve.flag_uses(near).where("code_id = 9").collect()] == [5]
    assert [r.flag for r in resolve.flag_uses(far).where("code_id = 9").collect()] == [-1]


def test_search(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("f", "f")], "src string, dst string").withColumn("relation", F.lit("x"))
    root = spark.createDataFrame([("a",)], "node_id string")
    assert sorted(r[0] for r in g.reachable(e, root).collect()) == ["a", "b", "c"]
    assert sorted(r[0] for r in g.reaching(e, root).collect()) == ["b", "c"]
    assert g.shortest_path(e, "a", "c") == ["a", "b", "c"] and g.shortest_path(e, "a", "e") == []
    assert dict(g.weak_components(e).collect()) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert rows(g.cycles(e, 3)) == [(1, "f > f"), (3, "a > b > c > a")]
