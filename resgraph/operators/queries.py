"""Questions over the graph: trace, uses, single objects and rooms, flags, reachability, dead and suspicious resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resgraph.operators import resolve
from resgraph.plans.graph import Graph, node, reachable, weak_components
from resgraph.schema import SUSPICIOUS_NAMES, Game
from resgraph.session import cut


def suspicious_name(name: Column) -> Column:
    """The first suspicious part that a name contains, or null."""
    low = F.lower(name)
    return F.try_element_at(F.filter(F.array(*map(F.lit, SUSPICIOUS_NAMES)), lambda p: low.contains(p)), F.lit(1))


def confidence(reasons_for: Column, reasons_against: Column) -> Column:
    raw = F.least(reasons_for * 15, F.lit(70)) - F.least(reasons_against * 20, F.lit(60))
    held = F.greatest(F.least(raw, F.lit(100)), F.lit(0))
    return F.when((reasons_against == 0) & (reasons_for > 0), F.greatest(held, F.lit(35))).otherwise(held).cast("int")


class Engine:
    def __init__(self, game: Game, graph: Graph | None = None):
        self.game = game
        self._graph = graph

    @property
    def graph(self) -> Graph:
        if self._graph is None:
            self._graph = Graph.of(self.game)
        return self._graph

    # -- lookups -----------------------------------------------------------------------------------------------------
    def matches(self, pattern: str) -> DataFrame:
        """(node_id, type, name): exact by name or id; only if there is none, by part of either, without case."""
        n = self.graph.nodes.select("node_id", "type", "name")
        exact = n.where((F.col("name") == pattern) | (F.col("node_id") == pattern))
        low = pattern.lower()
        loose = n.where(F.lower(F.coalesce("name", F.lit(""))).contains(low) | F.lower("node_id").contains(low))
        none = exact.agg(F.count("*").alias("n")).where("n = 0")  # one row at most
        return exact.union(loose.join(F.broadcast(none), F.lit(True), "left_semi"))

    def trace(self, pattern: str) -> DataFrame:
        """(node_id, type, name, edges, edge_count): all edges counted, the first 12 told, 100 nodes at most."""
        hit = self.matches(pattern).orderBy("node_id").limit(100)
        out = self.graph.outgoing(hit).select("node", F.lit(0).alias("side"), F.concat(F.lit("→ "), "relation", F.lit(" "), "name").alias("said"), "rule", "seq")
        into = self.graph.incoming(hit).select("node", F.lit(1), F.concat(F.lit("← "), "relation", F.lit(" "), "name"), "rule", "seq")
        w = Window.partitionBy("node").orderBy("side", "rule", "seq", "said")
        told = out.union(into).withColumn("nth", F.row_number().over(w))
        lines = told.groupBy("node").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("nth") <= 12, F.struct("nth", "said")))).alias("first"))
        joined = hit.join(lines, F.col("node_id") == F.col("node"), "left")
        text = F.array_join(F.transform("first", lambda x: x["said"]), "; ")
        return joined.select("node_id", "type", "name", F.coalesce(text, F.lit("Isolated node")).alias("edges"), F.coalesce("n", F.lit(0)).cast("long").alias("edge_count"))

    search = trace

    def who_uses(self, name: str) -> DataFrame:
        """(bucket, entry): what points to the resource, by the kind of what does; 30 of a bucket at most."""
        target = self.graph.nodes.where((F.col("name") == name) | (F.col("node_id") == name)).select("node_id")
        into = self.graph.incoming(target)
        kinds = {"object": "objects", "code": "bytecode", "room": "rooms", "sprite": "sprites", "script": "scripts", "function": "functions", "string": "strings", "flag": "flags", "instance": "creation_code"}
        bucket = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("type")), F.lit("bytecode"))
        said = F.concat("name", F.lit(" ("), "relation", F.lit(")"))
        out = self.graph.outgoing(target).where(F.col("type").isin("sprite", "sound", "code"))
        over = {"sprite": "sprites", "sound": "sounds", "code": "bytecode"}
        other = F.create_map(*[F.lit(x) for p in over.items() for x in p])[F.col("type")]
        rows = into.select(bucket.alias("bucket"), said.alias("entry")).union(out.select(other, said)).distinct()
        w = Window.partitionBy("bucket").orderBy("entry")
        return rows.withColumn("nth", F.row_number().over(w)).where("nth <= 30").drop("nth")

    def why_objects(self, name: str | None = None) -> DataFrame:
        """One row for each object (or the first of a name): where it is placed, what creates it, its family and degrees."""
        g = self.game
        objects = g.objects if name is None else g.objects.where(F.col("name") == name).orderBy("id").limit(1)
        o = objects.select("id", "name", node("object", "id").alias("node_id"), "sprite_index", "parent_index")
        rooms = g.instances.join(g.rooms.select(F.col("id").alias("room_id"), F.col("name").alias("room")), "room_id").groupBy(F.col("object_id").alias("id")).agg(F.count("*").alias("placed"), F.array_join(F.slice(F.array_sort(F.collect_set("room")), 1, 20), ", ").alias("rooms"))
        e = self.graph.edges
        made = e.where("relation = 'creates'").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("created_by"))
        kids = e.where("relation = 'inherits'").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("children"))
        events = g.object_events.groupBy(F.col("object_id").alias("id")).agg(F.count("*").alias("events"))
        sprite = g.sprites.select(F.col("id").alias("sprite_index"), F.col("name").alias("sprite"))
        parent = g.objects.select(F.col("id").alias("parent_index"), F.col("name").alias("parent"))
        out = o.join(rooms, "id", "left").join(made, "node_id", "left").join(kids, "node_id", "left").join(events, "id", "left").join(sprite, "sprite_index", "left").join(parent, "parent_index", "left").join(self.graph.degrees(), "node_id")
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("placed", "created_by", "children", "events", "in_degree", "out_degree")]
        return out.select("id", "name", F.coalesce("sprite", F.lit("None")).alias("sprite"), F.coalesce("parent", F.lit("None")).alias("parent"), F.coalesce("rooms", F.lit("")).alias("rooms"), *zero)

    def show_rooms(self) -> DataFrame:
        """One row for each room: size, speed, instances, creation code, whether it is reachable, edges in and out."""
        g = self.game
        counts = g.instances.groupBy(F.col("room_id").alias("id")).agg(F.count("*").alias("instances"), F.sum((F.col("creation_code_id") >= 0).cast("long")).alias("coded"), F.countDistinct("object_id").alias("objects"))
        lost = self.unreachable_rooms().select("id", F.lit(True).alias("lost"))
        r = g.rooms.withColumn("node_id", node("room", "id")).join(counts, "id", "left").join(lost, "id", "left").join(self.graph.degrees(), "node_id")
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("instances", "coded", "objects", "in_degree", "out_degree")]
        return r.select("id", "name", F.concat("width", F.lit("x"), "height").alias("size"), "speed", "persistent", (F.col("creation_code_id") >= 0).alias("has_creation_code"), F.col("lost").isNull().alias("reachable"), *zero)

    # -- flags -------------------------------------------------------------------------------------------------------
    def flag_users(self, flag: int | None = None) -> DataFrame:
        """(flag, nth, entry): writers before readers, 30 of a flag at most."""
        uses = resolve.flag_uses(self.game)
        uses = uses if flag is None else uses.where(F.col("flag") == flag)
        own = resolve.owners(self.game).select("code_id", "owner")
        rank = F.when(F.col("access") == "write", 0).otherwise(1)
        said = F.concat("owner", F.when(F.col("access") == "write", " — writes").otherwise(" — reads"))
        w = Window.partitionBy("flag").orderBy("rank", "code_id", "pos")
        return uses.join(own, "code_id").select("flag", rank.alias("rank"), said.alias("entry"), "code_id", "pos").withColumn("nth", F.row_number().over(w)).where("nth <= 30").select("flag", "nth", "entry")

    def flag_counts(self) -> DataFrame:
        """(flag, reads, writes, state) of each known flag: read_only, write_only or used."""
        sums = resolve.flag_uses(self.game).where("flag >= 0").groupBy("flag").agg(F.sum((F.col("access") == "read").cast("long")).alias("reads"), F.sum((F.col("access") == "write").cast("long")).alias("writes"))
        return sums.withColumn("state", F.when(F.col("writes") == 0, "read_only").when(F.col("reads") == 0, "write_only").otherwise("used"))

    def flag_analysis(self) -> DataFrame:
        """One row: flags, reads, writes, and how many are only read, only written; with the first 50 of each."""
        c = self.flag_counts()

        def first(state: str) -> Column:
            got = F.array_sort(F.collect_list(F.when(F.col("state") == state, F.col("flag"))))
            return F.array_join(F.slice(got, 1, 50), ",")

        return c.agg(F.count("*").alias("flags"), F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"), F.coalesce(F.sum("writes"), F.lit(0)).alias("writes"), F.coalesce(F.sum((F.col("state") == "read_only").cast("long")), F.lit(0)).alias("read_only"), F.coalesce(F.sum((F.col("state") == "write_only").cast("long")), F.lit(0)).alias("write_only"), first("read_only").alias("first_read_only"), first("write_only").alias("first_write_only"))

    # -- reachability ------------------------------------------------------------------------------------------------
    def unreachable_rooms(self) -> DataFrame:
        """(id, name): rooms that no source of the room view reaches; all rooms where the view is empty."""
        view = cut(self.graph.view("room"))
        rooms = self.game.rooms.select("id", "name", node("room", "id").alias("node_id"))
        sources = view.select(F.col("src").alias("node_id")).distinct().join(view.select(F.col("dst").alias("node_id")), "node_id", "left_anti")
        lost = rooms.join(reachable(view, sources), "node_id", "left_anti")
        # a view with edges but no source (cycles alone) has no unreachable rooms
        state = view.agg(F.count("*").alias("edges")).join(F.broadcast(sources.agg(F.count("*").alias("sources"))))
        gate = state.where("edges = 0 or sources > 0")
        return lost.join(F.broadcast(gate), F.lit(True), "left_semi").select("id", "name")

    def unused_strings(self, most: int = 200) -> DataFrame:
        """(node_id, label, text): strings that no code references."""
        used = self.graph.edges.where("relation = 'references'").select(F.col("dst").alias("node_id"))
        rows = self.graph.nodes.where("type = 'string'").join(used, "node_id", "left_anti")
        return rows.select("node_id", F.concat(F.lit("str["), "id", F.lit("]")).alias("label"), F.substring("name", 1, 80).alias("text"), F.col("id").cast("long").alias("n")).orderBy("n").limit(most).drop("n")

    def dead_resources(self) -> DataFrame:
        """(type, name, node_id): objects, rooms, sprites, sounds and scripts that no root reaches by any relation."""
        e, n = self.graph.edges, self.graph.nodes
        live = e.where("relation = 'has_event'").select(F.col("src").alias("node_id")).union(e.select("dst"))
        roots = n.where("type = 'object'").join(live, "node_id", "left_semi").select("node_id").union(n.where("type in ('room', 'script')").select("node_id"))
        kinds = n.where("type in ('object', 'room', 'sprite', 'sound', 'script')")
        return kinds.join(reachable(e, roots), "node_id", "left_anti").select("type", "name", "node_id")

    def suspicious(self) -> DataFrame:
        """(rank, node_id, name, resource_type, confidence, reasons, against), in order of rank and node_id."""
        return reduce(DataFrame.unionByName, [self._odd_objects(), self._odd_rooms(), self._odd_named("sprite", 2, "no object uses this sprite", self.graph.edges), self._odd_named("sound", 3, "sound never played", self.graph.edges.where("relation = 'references_sound'")), self._odd_scripts()])

    def _item(self, rows: DataFrame, rank: int, kind: str, reasons: Column, against: Column) -> DataFrame:
        score = confidence(F.size("r"), F.size("a"))
        kept = rows.withColumn("r", F.filter(reasons, lambda x: x.isNotNull())).withColumn("a", F.filter(against, lambda x: x.isNotNull()))
        kept = kept.where(F.size("r") + F.size("a") > 0).withColumn("confidence", score).where("confidence >= 20")
        return kept.select(F.lit(rank).alias("rank"), "node_id", "name", F.lit(kind).alias("resource_type"), "confidence", F.array_join(F.slice("r", 1, 3), "; ").alias("reasons"), F.array_join(F.slice("a", 1, 5), "; ").alias("against"))

    def _odd_objects(self) -> DataFrame:
        e = self.graph.edges
        into = e.where("relation in ('is_instance_of', 'creates', 'inherits', 'with_reference', 'references_object', 'references', 'asset_get_index_ref')").select(F.col("dst").alias("node_id"))
        out = e.where("relation in ('has_event', 'inherits', 'collision_reference')").select(F.col("src").alias("node_id"))
        rows = self.graph.nodes.where("type = 'object'").join(into.union(out), "node_id", "left_anti").join(self.graph.degrees(), "node_id")
        low, part = F.lower("name"), suspicious_name(F.col("name"))
        control = low.contains("controller") | low.contains("ctrl")
        plain = part.isNull() & ~control
        i, o = F.col("in_degree"), F.col("out_degree")
        reasons = F.array(
            F.when(part.isNotNull(), F.concat(F.lit("suspicious name pattern: '"), part, F.lit("'"))),
            F.when(plain & (i == 0) & (o == 0), "completely isolated (no edges)").when(plain & (i == 0), "no incoming references from graph"),
            F.when(plain & (o == 0), "no outgoing relationships"),
        )
        return self._item(rows, 0, "OBJECT", reasons, F.array(F.when(control, "controller naming (likely intentional)")))

    def _odd_rooms(self) -> DataFrame:
        counts = self.game.instances.groupBy(F.col("room_id").alias("id")).agg(F.count("*").alias("n"))
        rows = self.unreachable_rooms().join(self.game.rooms.select("id", "creation_code_id"), "id").join(counts, "id", "left").withColumn("node_id", node("room", "id"))
        against = F.array(F.when(F.col("creation_code_id") >= 0, "has creation code"), F.when(F.col("n") > 0, F.concat(F.lit("has "), "n", F.lit(" instances"))))
        return self._item(rows, 1, "ROOM", F.array(F.lit("no incoming room transitions")), against)

    def _odd_named(self, kind: str, rank: int, reason: str, uses: DataFrame) -> DataFrame:
        rows = self.graph.nodes.where(F.col("type") == kind).join(uses.select(F.col("dst").alias("node_id")), "node_id", "left_anti")
        rows = rows.withColumn("part", suspicious_name(F.col("name"))).where("part is not null")
        return self._item(rows, rank, kind.upper(), F.array(F.lit(reason), F.concat(F.lit("suspicious name: '"), "part", F.lit("'"))), F.array(F.lit(None).cast("string")))

    def _odd_scripts(self) -> DataFrame:
        e = self.graph.edges
        own = self.graph.nodes.where("type = 'script'").join(e.where("relation = 'owns'").select(F.col("src").alias("node_id"), F.col("dst").alias("code")), "node_id")
        called = e.where("relation = 'calls'").select(F.col("dst").alias("code")).distinct().withColumn("called", F.lit(True))
        quiet = own.join(called, "code", "left").groupBy("node_id", "name").agg(F.max(F.coalesce("called", F.lit(False))).alias("any")).where("not any")
        part = suspicious_name(F.col("name"))
        return self._item(quiet, 4, "SCRIPT", F.array(F.lit("no code calls this script"), F.when(part.isNotNull(), F.concat(F.lit("suspicious name: '"), part, F.lit("'")))), F.array(F.lit(None).cast("string")))

    # -- summaries ---------------------------------------------------------------------------------------------------
    def summary(self) -> DataFrame:
        """(metric, n): rows of each relation."""
        return reduce(DataFrame.union, [rows.agg(F.lit(name).alias("metric"), F.count("*").alias("n")) for name, rows in self.game.relations().items()])

    def graph_summary(self) -> DataFrame:
        """(metric, n): nodes, edges, and nodes, edges and weak components of the room and call views."""
        parts = [self.graph.nodes.agg(F.lit("nodes").alias("metric"), F.count("*").alias("n")), self.graph.edges.agg(F.lit("edges"), F.count("*"))]
        for name in ("room", "call"):
            view = cut(self.graph.view(name))
            ends = view.select("src").union(view.select("dst")).distinct()
            parts += [ends.agg(F.lit(f"{name}_nodes"), F.count("*")), view.agg(F.lit(f"{name}_edges"), F.count("*"))]
            if name == "room":
                parts.append(weak_components(view).agg(F.lit("room_components"), F.countDistinct("component")))
        return reduce(DataFrame.union, parts)

    def relation_counts(self) -> DataFrame:
        return self.graph.edges.groupBy("relation").agg(F.count("*").alias("n"))
