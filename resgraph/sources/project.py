"""Source-text projects from a folder: object events, rooms, scripts, resources and dialogue texts, by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resgraph.operators.analyzers import Project
from resgraph.session import cut

#: Markers of events and properties in object files.
_EVENT = r"(?i)^\s*//[/\s]*@event\s+(\w+)(?:\s+(.+))?"
_MARK = r"(?i)^\s*//[/\s]*@(sprite|parent)\s+(.+)"


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def read_project(spark: SparkSession, folder: str) -> Project:
    """The relations of a project folder: objects/, rooms/, scripts/, sprites/, sounds/, fonts/ and dialogue texts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.decode("content", "UTF-8").alias("content"))
    root = "/" + folder.split("://")[-1].strip("/") + "/"
    files = files.withColumn("rel", F.substring_index("path", root, -1))
    files = cut(files)  # each file is read once; all relations and what is built on them start from here
    object_files = files.where(F.col("rel").rlike(r"^objects/[^/]+\.(gml|txt)$")).withColumn("object", _stem(F.col("rel")))
    lines = object_files.select("object", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    w = Window.partitionBy("object").orderBy("n")
    marked = lines.withColumn("part", F.sum(F.col("line").rlike(_EVENT).cast("int")).over(w))
    marks = marked.where(F.col("line").rlike(_MARK)).select("object", F.lower(F.regexp_extract("line", _MARK, 1)).alias("kind"), F.trim(F.regexp_extract("line", _MARK, 2)).alias("value"))
    head = marks.groupBy("object").agg(F.max(F.when(F.col("kind") == "sprite", F.col("value"))).alias("sprite"), F.max(F.when(F.col("kind") == "parent", F.col("value"))).alias("parent"))
    parts = marked.where("part > 0").groupBy("object", "part").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"))
    first = F.col("l")[0]["line"]
    kind, sub = F.lower(F.regexp_extract(first, _EVENT, 1)), F.trim(F.regexp_extract(first, _EVENT, 2))
    from_files = parts.select("object", F.when(sub != "", F.concat(kind, F.lit("_"), sub)).otherwise(kind).alias("key"), F.array_join(F.transform(F.expr("slice(l, 2, size(l))"), lambda x: x["line"]), "\n").alias("code"))
    in_dirs = files.where(F.col("rel").rlike(r"^objects/[^/]+/[^/]+\.gml$")).select(F.regexp_extract("rel", r"^objects/([^/]+)/", 1).alias("object"), _stem(F.col("rel")).alias("key"), F.col("content").alias("code"))
    dir_sprite = in_dirs.where("key = 'sprite'").select("object", F.trim("code").alias("dir_sprite"))
    names = object_files.select("object").union(in_dirs.select("object")).distinct()
    objects = names.join(head, "object", "left").join(dir_sprite, "object", "left").select(F.col("object").alias("name"), F.coalesce("dir_sprite", "sprite").alias("sprite"), "parent")
    events = from_files.union(in_dirs.where("key <> 'sprite'"))
    room_files = files.where(F.col("rel").rlike(r"^rooms/[^/]+\.(json|gml)$")).withColumn("name", _stem(F.col("rel")))
    parsed = room_files.withColumn("j", F.from_json("content", "creationCode string, instances array<struct<objectName: string, x: double, y: double>>"))
    is_json = F.col("rel").endswith(".json")
    rooms = parsed.select("name", F.when(is_json, F.coalesce("j.creationCode", F.lit(""))).otherwise("").alias("creation_code"))
    listed = parsed.where(is_json).select(F.col("name").alias("room"), F.explode("j.instances.objectName").alias("object"))
    told = parsed.where(~is_json).select(F.col("name").alias("room"), F.explode(F.regexp_extract_all("content", F.lit(r"//\s*Instance:\s*(\w+)"), F.lit(1))).alias("object"))
    scripts = files.where(F.col("rel").rlike(r"^(scripts/.*|(scr_|gml_)[^/]*)\.gml$")).withColumn("name", _stem(F.col("rel"))).select("name", F.col("content").alias("code"), (F.col("name").startswith("gml_") | F.col("name").startswith("anon_") | F.col("name").startswith("Anonymous_")).alias("is_anonymous"))

    def resources(kind: str) -> DataFrame:
        return files.where(F.col("rel").startswith(f"{kind}/")).select(F.regexp_extract("rel", rf"^{kind}/([^/.]+)", 1).alias("name")).distinct()

    talk = files.where(F.col("rel").rlike(r"(?i)(text|dialog)[^/]*\.txt$")).select("path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    id_line = F.when(F.trim("line").rlike(r"^(#\w+|msg_\w+|str_\w+|txt_\w+)$"), F.trim("line"))
    said = talk.withColumn("id", F.last(id_line, ignorenulls=True).over(Window.partitionBy("path").orderBy("n"))).withColumn("text", F.regexp_extract("line", r'"((?:[^"\\]|\\.)*)"', 1)).where("text <> '' and id is not null")
    dialogues = said.groupBy("id").agg(F.min_by("text", F.struct("path", "n")).alias("text"))
    made = {"objects": objects, "events": events, "rooms": rooms, "room_instances": listed.union(told), "scripts": scripts, "dialogues": dialogues}
    return Project(**{name: cut(rows) for name, rows in made.items()}, sprites=resources("sprites"), sounds=resources("sounds"), fonts=resources("fonts"))
