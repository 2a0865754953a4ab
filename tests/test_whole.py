"""Relations projected from the star tables hold all of their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from resgraph.operators.analyzers import Analyzers
from resgraph.sources.star import star_game
from resgraph.sources.text_star import text_project


def test_text_project_is_whole(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    project = text_project(spark, str(tmp_path))
    assert {k: v.count() for k, v in vars(project).items()} == dict.fromkeys(vars(project), 1000)
    a = Analyzers(project)
    late = {r.kind for r in a.dead().where("cast(regexp_extract(name, '([0-9]+)$', 1) as int) >= 900").collect()}
    assert late == {"object", "room", "script", "sound", "sprite", "dialogue"}
    assert a.dead().where("name in ('room_901', 'spr_901', 'snd_904')").count() == 0


def test_star_game_is_whole(spark, tmp_path):
    n = 400
    ids = spark.range(n)
    ids.select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), "id").alias("p_name"), (F.col("id") % 50).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(5).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("supplier "), "id").alias("s_name"), F.col("id").alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    ids.select((F.col("id") % 5).alias("l_suppkey"), F.col("id").alias("l_partkey"), F.lit(10.0).alias("l_quantity"), F.lit("N").alias("l_returnflag")).write.parquet(f"{tmp_path}/lineitem.parquet")
    ids.select(F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), F.lit("view").alias("event_type"), F.col("id").alias("ts"), F.lit('{"k": 7}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    game = star_game(spark, str(tmp_path))
    names = ("objects", "object_events", "instances", "sprites", "sounds", "strings", "functions", "variables", "instructions")
    assert {k: getattr(game, k).count() for k in names} == dict.fromkeys(names, n)
    # some objects stay unplaced
    assert 0 < game.objects.join(game.instances, game.objects.id == game.instances.object_id, "left_anti").count() < n
