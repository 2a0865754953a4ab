"""Full answers about objects and rooms as lists in rows, the resolver's report, degree classes and graph checks.

A list is rows of (…, part, nth, entry): lists of a whole package stay spread over tasks, however long one of them is.
Order within a part is that of the edges (rule, seq) and then the entry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resgraph.operators import resolve
from resgraph.operators.queries import Engine
from resgraph.plans.graph import build_links, build_nodes, node, room_edges, weak_components
from resgraph.schema import EVENT_NAMES, Game
from resgraph.session import cut

#: Entries told of each part; parts not named are told whole.
MOST = {"event": 30, "child": 20, "incoming": 15, "outgoing": 15}
MOST_OF_ROOM = 20


def _numbered(rows: DataFrame, most: dict[str, int]) -> DataFrame:
    """(node_id, part, entry, rule, seq) with nth by node and part; parts of most are cut to their length."""
    w = Window.partitionBy("node_id", "part").orderBy("rule", "seq", "entry")
    limit = F.try_element_at(F.create_map(*[F.lit(x) for p in most.items() for x in p]), F.col("part"))
    return rows.withColumn("nth", F.row_number().over(w)).where(limit.isNull() | (F.col("nth") <= limit))


def _refs(rows: DataFrame, part: str) -> DataFrame:
    return rows.select(F.col("node").alias("node_id"), F.lit(part).alias("part"), F.concat("name", F.lit(" ("), "relation", F.lit(")")).alias("entry"), "rule", "seq")


def object_lists(e: Engine, name: str | None = None) -> DataFrame:
    """(object_id, part, nth, entry) of every object, or of the first of a name; part error where none has the name.

    Parts: placed_in (a room for each instance), created_by, event (type,subtype), child, incoming and outgoing.
    """
    g, graph = e.game, e.graph
    objects = g.objects if name is None else g.objects.where(F.col("name") == name).orderBy("id").limit(1)
    chosen = objects.select(F.col("id").alias("object_id"), node("object", "id").alias("node_id"))
    into, out = graph.incoming(chosen), graph.outgoing(chosen)
    placed = g.instances.join(g.rooms.select(F.col("id").alias("room_id"), F.col("name").alias("room")), "room_id").select(node("object", "object_id").alias("node_id"), F.lit("placed_in").alias("part"), F.col("room").alias("entry"), F.lit(1).alias("rule"), F.col("instance_id").cast("long").alias("seq"))
    made = into.where("relation = 'creates'").select(F.col("node").alias("node_id"), F.lit("created_by").alias("part"), F.concat("name", F.lit(" ("), "source", F.lit(")")).alias("entry"), "rule", "seq")
    kids = into.where("relation = 'inherits'").select(F.col("node").alias("node_id"), F.lit("child").alias("part"), F.col("name").alias("entry"), "rule", "seq")
    events = g.object_events.select(node("object", "object_id").alias("node_id"), F.lit("event").alias("part"), F.concat("event_type", F.lit(","), "subtype").alias("entry"), F.col("event_type").alias("rule"), F.col("subtype").cast("long").alias("seq"))
    told = _numbered(reduce(DataFrame.unionByName, [placed, made, kids, events, _refs(into, "incoming"), _refs(out, "outgoing")]).join(chosen, "node_id"), MOST).select("object_id", "part", "nth", "entry")
    if name is None:
        return told
    none = objects.agg(F.count("*").alias("n")).where("n = 0")
    return told.union(none.select(F.lit(None).cast("long"), F.lit("error"), F.lit(1), F.lit(f"Object '{name}' not found")))


def room_instances(e: Engine) -> DataFrame:
    """(room_id, instance_id, object, x, y, has_creation_code): object is ? where it doesn't exist."""
    return _room_instances(e.game, e.game.instances, e.game.code)


def _room_instances(g: Game, instances: DataFrame, code: DataFrame) -> DataFrame:
    objects = g.objects.select(F.col("id").alias("object_id"), F.col("name").alias("object"))
    coded = code.select(F.col("id").alias("creation_code_id"), F.lit(True).alias("coded"))
    rows = instances.join(objects, "object_id", "left").join(coded, "creation_code_id", "left")
    return rows.select("room_id", "instance_id", F.coalesce("object", F.lit("?")).alias("object"), "x", "y", F.coalesce("coded", F.lit(False)).alias("has_creation_code"))


def room_lists(e: Engine, name: str | None = None) -> DataFrame:
    """(room_id, part, nth, entry) of every room, or of the first of a name; part error where none has the name.

    Parts: instance (object, id and place), incoming and outgoing: of the first 20 edges, those that lead to no instance.
    """
    g = e.game
    rooms = g.rooms if name is None else g.rooms.where(F.col("name") == name).orderBy("id").limit(1)
    chosen = rooms.select(F.col("id").alias("room_id")).distinct()
    instances = resolve.kept(g, "_instances", lambda g: g.instances)
    # of all code entries only those that instances name, few as a rule: instances needn't be dealt by code entry
    code = cut(g.code.join(instances.select(F.col("creation_code_id").alias("id")).distinct(), "id", "left_semi").select("id"))
    held = _room_instances(g, instances, code).select("room_id", "instance_id", "object", "x", "y", "has_creation_code")
    # dealt by room before the text is made, as the text is several times as large
    held = held.repartition("room_id").join(chosen, "room_id", "left_semi")
    placed = held.select("room_id", F.lit("instance").alias("part"), F.concat("object", F.lit(" #"), "instance_id", F.lit(" at "), "x", F.lit(","), "y", F.when(F.col("has_creation_code"), " with code").otherwise("")).alias("entry"), F.lit(1).alias("rule"), "instance_id")
    placed = placed.select("room_id", "part", F.row_number().over(Window.partitionBy("room_id").orderBy("instance_id", "entry")).alias("nth"), "entry")
    told = placed.unionByName(_first_edges(g, chosen, instances))
    if name is None:
        return told
    none = rooms.agg(F.count("*").alias("n")).where("n = 0")
    return told.union(none.select(F.lit(None).cast("long"), F.lit("error"), F.lit(1), F.lit(f"Room '{name}' not found")))


def _first_edges(g: Game, chosen: DataFrame, instances: DataFrame) -> DataFrame:
    """(room_id, part, nth, entry): of the first 20 edges a side of chosen rooms, those that lead to no instance.

    Edges to instances come first of all outgoing ones, so only their number counts: one for each node that has the id.
    """
    ranked = F.rank().over(Window.partitionBy("room_id", "part").orderBy("rule", "seq"))
    near = cut(room_edges(g).join(chosen, "room_id", "left_semi").withColumn("nth", ranked).where(F.col("nth") <= MOST_OF_ROOM).drop("nth"))
    names = g.rooms.select(F.lit("room").alias("kind"), "id", "name").union(resolve.owners(g).select(F.lit("code"), "code_id", "owner"))
    other = F.coalesce("name", F.when(F.col("kind") == "room", node("room", "id")).otherwise(node("code", "id")))
    said = near.join(names, ["kind", "id"], "left").select("room_id", "part", F.concat(other, F.lit(" ("), "relation", F.lit(")")).alias("entry"), "rule", "seq")
    nth = F.row_number().over(Window.partitionBy("room_id", "part").orderBy("rule", "seq", "entry"))
    said = said.withColumn("nth", nth).where(F.col("nth") <= MOST_OF_ROOM)
    out = near.where("part = 'outgoing'").select("room_id").distinct()
    counts = instances.groupBy("room_id").agg(F.count("*").alias("held")).join(out, "room_id", "left_semi")
    counts = cut(counts)
    few = instances.join(counts.where(F.col("held") < MOST_OF_ROOM), "room_id", "left_semi").select("room_id", "instance_id")
    if counts.where(F.col("held") < MOST_OF_ROOM).take(1):
        times = instances.join(few.select("instance_id").distinct(), "instance_id", "left_semi").groupBy("instance_id").agg(F.count("*").alias("times"))
        exact = few.join(times, "instance_id", "left").groupBy("room_id").agg(F.sum(F.coalesce("times", F.lit(1))).alias("held"))
        counts = counts.where(F.col("held") >= MOST_OF_ROOM).unionByName(exact)
    fits = (F.col("part") == "incoming") | (F.coalesce("held", F.lit(0)) + F.col("nth") <= MOST_OF_ROOM)
    return said.join(counts, "room_id", "left").where(fits).select("room_id", "part", "nth", "entry")


def event_summaries(game: Game) -> DataFrame:
    """(object_id, events, has_create, has_step, has_draw, has_alarm, summary): events by name, the subtype where it is above 0."""
    kind, sub = F.col("event_type"), F.col("subtype")
    names = F.create_map(*[F.lit(x) for p in enumerate(EVENT_NAMES) for x in p])
    said = F.concat(F.coalesce(F.try_element_at(names, kind), F.concat(F.lit("EV_"), kind)), F.when(sub > 0, F.concat(F.lit("("), sub, F.lit(")"))).otherwise(""))

    def has(number: int, any_subtype: bool = False) -> Column:
        return F.max((kind == number) & (F.lit(any_subtype) | (sub == 0)))

    listed = F.array_sort(F.collect_list(F.struct("event_type", "subtype", said.alias("said"))))
    return game.object_events.groupBy("object_id").agg(F.count("*").alias("events"), has(0).alias("has_create"), has(3).alias("has_step"), has(8).alias("has_draw"), has(2, True).alias("has_alarm"), F.array_join(F.transform(listed, lambda x: x["said"]), ", ").alias("summary"))


def resolver_report(game: Game) -> DataFrame:
    """(metric, value): what was resolved of all references, code by owner, and the sizes of the views."""
    g, c = game, F.col

    def known(key: str, rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.where(c(key) >= 0).join(of.select(c("id").alias("k")), c(key) == c("k"), "left_semi")

    total = {n: rows.agg(F.count("*").alias("total")) for n, rows in (("objects", g.objects), ("code", g.code))}

    def count(metric: str, rows: DataFrame, out_of: str | None = None) -> DataFrame:
        n = rows.agg(F.count("*").alias("n"))
        if out_of is None:
            return n.select(F.lit(metric).alias("metric"), c("n").cast("string").alias("value"))
        return n.join(F.broadcast(total[out_of])).select(F.lit(metric).alias("metric"), F.concat("n", F.lit("/"), "total").alias("value"))

    own, made = resolve.owners(g), resolve.calls(g)
    typed = {"scripts": 0, "object_events": 1, "room_code": 2, "global_scripts": 3, "sequence_callbacks": 4, "timeline_code": 5, "unknown_code": -1}
    size = g.code.agg(F.count("*").alias("size"))
    broken = made.select("func_id").join(F.broadcast(size)).where("func_id < size").join(g.code.select(c("id").alias("func_id")), "func_id", "left_anti")
    parts = [
        count("objects_loaded", g.objects), count("objects_resolved", g.objects),
        count("parents_resolved", known("parent_index", g.objects, g.objects), "objects"),
        count("sprites_resolved", known("sprite_index", g.objects, g.sprites), "objects"),
        count("masks_resolved", known("mask_index", g.objects, g.sprites), "objects"),
        count("events_total", g.object_events), count("room_instances", g.instances), count("room_placements", g.instances),
        count("room_creation_code", known("creation_code_id", g.rooms, g.code)), count("functions_total", g.functions),
        count("code_entries_total", g.code), count("code_ownership_resolved", own, "code"),
        count("call_nodes", g.code), count("call_edges", made.where("callee is not null").select("caller", "callee").distinct()),
        count("room_nodes", g.rooms), count("room_edges", resolve.room_transitions(g)), count("broken_script_refs", broken),
    ]
    return reduce(DataFrame.unionByName, parts + [count(metric, own.where(c("owner_type") == number)) for metric, number in typed.items()])


def degree_classes(e: Engine) -> DataFrame:
    """(node_id, class): isolated, source (no edge in) or sink (no edge out); all other nodes are left out."""
    i, o = F.col("in_degree"), F.col("out_degree")
    kind = F.when((i == 0) & (o == 0), "isolated").when(i == 0, "source").when(o == 0, "sink")
    return e.graph.degrees().select("node_id", kind.alias("class")).where("class is not null")


def graph_stats(e: Engine) -> DataFrame:
    """(metric, n) of the whole graph: nodes, edges, weak components (isolated nodes are one each) and isolated nodes."""
    graph, game = e.graph, e.graph.game
    if game is None:
        nodes, more = graph.nodes, graph.nodes.limit(0)
        links = cut(graph.edges.groupBy("src", "dst").agg(F.count("*").alias("n")))
    else:
        nodes, more = build_nodes(game, instances=False), resolve.kept(game, "_instances", lambda g: g.instances)
        links = build_links(game)
    ends = links.select(F.coalesce("src", "dst").alias("src"), F.coalesce("dst", "src").alias("dst")).where("src is not null")
    linked = weak_components(ends)
    # each node is there as often as it is told; instances with an id are all linked to something
    known = nodes.select("node_id").join(linked.select("node_id", F.lit(True).alias("linked")), "node_id", "left")
    key = "node_id" if game is None else "instance_id"
    seen = known.select("linked").union(more.select(F.when(F.col(key).isNotNull(), True)))
    told = seen.agg(F.count("*").alias("nodes"), F.count(F.when(F.col("linked").isNull(), 1)).alias("isolated"))
    told = told.join(F.broadcast(linked.agg(F.countDistinct("component").alias("groups")))).join(F.broadcast(links.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))))
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), n.cast("long").alias("n")) for m, n in (("nodes", F.col("nodes")), ("edges", F.col("edges")), ("components", F.col("groups") + F.col("isolated")), ("isolated", F.col("isolated")))])
    return told.select(F.explode(parts).alias("p")).select("p.metric", "p.n")


def graph_issues(e: Engine) -> DataFrame:
    """(category, severity, message): the views' sizes, and where they differ from what resolution found.

    Every code entry is a node of the call graph, so none can be missing there.
    """
    g, graph = e.game, e.graph

    def size(name: str) -> DataFrame:
        view = graph.view(name)
        ends = view.select("src").union(view.select("dst")).distinct()
        return view.agg(F.count("*").alias(f"{name}_edges")).join(F.broadcast(ends.agg(F.count("*").alias(f"{name}_nodes"))))

    moves = resolve.room_transitions(g).join(g.rooms.select(F.col("id").alias("room_id"), F.lit(1).alias("known")), "room_id", "left")
    found = moves.agg(F.count("*").alias("moves"), F.countDistinct(F.when(F.col("known") == 1, F.col("room_id"))).alias("targets"))
    made = resolve.calls(g).where("callee is not null").select("caller", "callee").distinct().agg(F.count("*").alias("made"))
    one = reduce(lambda a, b: a.join(F.broadcast(b)), [size("room"), size("call"), size("object"), size("flag"), found, made])  # one row a side

    def issue(when: Column, severity: str, *said: str | Column) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in said]).alias("message")))

    c = F.col
    issues = F.array(
        issue((c("moves") > 0) & (c("targets") == 0), "error", "Room moves were found, none to a room that exists"),
        issue((c("targets") > 0) & (c("room_edges") < c("targets")), "warning", "Room view has fewer edges than rooms are moved to: ", c("room_edges"), " of ", c("targets")),
        issue(c("made") != c("call_edges"), "warning", "Call view has ", c("call_edges"), " edges, resolution found ", c("made")),
        issue(F.lit(True), "info", "Object view: ", c("object_nodes"), " nodes, ", c("object_edges"), " edges"),
        issue(F.lit(True), "info", "Flag view: ", c("flag_nodes"), " nodes, ", c("flag_edges"), " edges"),
    )
    return one.select(F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("i")).select(F.lit("graph").alias("category"), "i.severity", "i.message")
