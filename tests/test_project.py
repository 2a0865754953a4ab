"""A project folder read, analysed and reported; the command line; running flags."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from resgraph import cli, report
from resgraph.operators.analyzers import Analyzers
from resgraph.sources.project import read_project
from resgraph.streaming.flags import running_flags
from tests.test_package import write

FILES = {
    "objects/obj_a.gml": "// @sprite spr_a\n// @event create\nglobal.flag[3] = 1;\nscr_used();\nif (scr_flag_get(4)) { room_goto(room_b); }",
    "objects/obj_d/step.gml": "x = 1;",
    "rooms/room_b.json": '{"width":64,"height":32,"instances":[{"objectName":"obj_a","x":1,"y":2}]}',
    "scripts/scr_used.gml": "return 1;",
    "scripts/scr_unused.gml": "x = 1;",
    "sprites/spr_a/a.txt": "-",
    "sounds/snd_x/a.txt": "-",
    "allTexts.txt": 'msg_hello\n"Hi"\n"again"',
}


def test_folder(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(text)
    a = Analyzers(read_project(spark, str(tmp_path / "p")))
    assert {tuple(r) for r in a.p.objects.collect()} == {("obj_a", "spr_a", None), ("obj_d", None, None)}
    assert {(r.object, r.key) for r in a.p.events.collect()} == {("obj_a", "create"), ("obj_d", "step")}
    assert {tuple(r) for r in a.p.dialogues.collect()} == {("msg_hello", "Hi")}
    assert {tuple(r) for r in a.dead().collect()} == {("object", "obj_d"), ("script", "scr_unused"), ("sound", "snd_x"), ("dialogue", "msg_hello")}
    report.to_json(a, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["summary"]["objects"] == 2
    report.to_markdown(a, str(tmp_path / "r.md"))
    report.to_html(a, str(tmp_path / "r.html"))
    report.to_dot(a, str(tmp_path / "r.dot"), 5)
    assert "scr_unused" in (tmp_path / "r.md").read_text() and "<table>" in (tmp_path / "r.html").read_text() and "digraph" in (tmp_path / "r.dot").read_text()


def test_cli(spark, tmp_path):
    path = tmp_path / "data.win"
    path.write_bytes(write())
    assert [r.name for r in cli.run(spark, str(path), "unreachable").collect()] == ["room_void"]
    assert cli.run(spark, str(path), "debug_chunks").count() >= 7


def test_running_flags(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", 1, 7, "read"), ("2024-01-01 00:00:01", 1, 7, "read"), ("2024-01-01 00:01:00", 2, 7, "write")]
    spark.createDataFrame(rows, "ts string, event_id long, flag long, access string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_id long, flag long, access string").parquet(str(tmp_path / "in"))
    query = running_flags(stream).writeStream.outputMode("complete").format("memory").queryName("flags_now").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.flag, r.reads, r.writes) for r in spark.table("flags_now").collect()] == [(7, 1, 1)]
