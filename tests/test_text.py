"""A small source-text project: what each analyzer finds."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from resgraph.functions import text as T
from resgraph.operators.analyzers import DDL, Analyzers, Project

ROWS = {
    "objects": [("obj_a", "spr_a", None)],
    "events": [("obj_a", "create", "global.flag[3] = 1;\nscr_used();\nif (scr_flag_get(4)) { room_goto(room_b); }")],
    "rooms": [("room_b", "")],
    "room_instances": [("room_b", "obj_a")],
    "scripts": [("scr_used", "return 1;", False), ("scr_unused", "x = 1;", False)],
    "sprites": [("spr_a",)],
    "sounds": [("snd_x",)],
    "fonts": [],
    "dialogues": [("msg_hello", "Hi")],
}


def test_project(spark):
    a = Analyzers(Project(**{k: spark.createDataFrame(v, DDL[k]) for k, v in ROWS.items()}))
    got = {(r.analyzer, r.name): r.score for r in a.suspicious().collect()}
    assert got["flags", "flag[3]"] == 30 and got["flags", "flag[4]"] == 50
    assert got["scripts", "scr_unused"] == 60 and got["callgraph", "scr_flag_get"] == 40
    assert got["rooms", "room_b"] == 20 and got["transitions", "room_b"] == 20
    assert got["sounds", "snd_x"] == 15 and got["dialogues", "msg_hello"] == 35
    assert [tuple(r) for r in a.transitions.collect()] == [("obj_a", "room_b", "room_goto")]
    assert ("obj_a", "spr_a", "uses_sprite") in {tuple(r) for r in a.edges().collect()}


def test_flag_access(spark):
    code = "global.flag[1] = 2; x = global.flag[2]; if (global.flag[3] == 1) {} global.flag[4]++; global.flag[5] += 1; scr_flag_set(6, 1); scr_flag_get(7)"
    got = {r.flag: r.is_write for r in T.flag_accesses(spark.createDataFrame([(code,)], "code string")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False}


def test_flag_accesses_by_brute_force(spark):
    pieces = ["global.flag[7]", "global.flag [ 12 ]", "=", "==", " ", "\n", "+=", "x", "++", "value_of_thing", "😀", ";"]
    draw = random.Random(3)
    texts = ["", "global.flag[1]", *("".join(draw.choices(pieces, k=40)) for _ in range(60))]
    want = []
    for n, text in enumerate(texts):
        for m in re.finditer(r"global\.flag\s*\[\s*(\d+)\s*\]", text):
            before, after = text[: m.start()][-20:].strip(), text[m.end() : m.end() + 20].strip()
            write = (after.startswith("=") and not after.startswith("==")) or after.startswith(("+=", "-=", "*=", "/=", "++")) or (before.endswith("=") and not before.endswith("=="))
            want.append((n, int(m[1]), write))
    units = spark.createDataFrame(list(enumerate(texts)), "n int, code string")
    assert sorted(tuple(r) for r in T.flag_accesses(units).collect()) == sorted(want)


def test_next_line(spark):
    units = spark.createDataFrame([("u", "a\n\nb\n\n\nc"), ("v", "")], "unit string, code string")
    rows = T.lines(units).withColumn("next", T.next_line(["unit"], F.col("text") != ""))
    got = {(r.unit, r.n): r.next and tuple(r.next) for r in rows.collect()}
    assert got == {("u", 1): (3, "b"), ("u", 2): (3, "b"), ("u", 3): (6, "c"), ("u", 4): (6, "c"), ("u", 5): (6, "c"), ("u", 6): None, ("v", 1): None}
