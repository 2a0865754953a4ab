"""The property multigraph of a package (nodes and a bag of edges), its read API, views and searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resgraph.operators import resolve
from resgraph.schema import OWNER_GLOBAL, OWNER_SEQUENCE, OWNER_TIMELINE, PASSED_OVER, PREFIX, Game
from resgraph.session import cut, drop


def node(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(PREFIX[kind] + "_"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _rule(rows: DataFrame, src: Column, dst: Column, relation: str | Column, number: int, seq: Column | None = None) -> DataFrame:
    """Edges of one rule; (rule, seq, dst) gives every cap a total order."""
    return rows.select(src.alias("src"), dst.alias("dst"), (F.lit(relation) if isinstance(relation, str) else relation).alias("relation"), F.lit(number).alias("rule"), (F.lit(0) if seq is None else seq).cast("long").alias("seq"))


def build_edges(game: Game) -> DataFrame:
    """All edges, one select for each rule; duplicates stay, as degrees count them."""
    return _placed_edges(game, resolve.kept(game, "_instances", lambda g: g.instances)).unionByName(_other_edges(game))


def _placed_edges(game: Game, instances: DataFrame) -> DataFrame:
    """Edges of instances, rules 1 to 4."""
    o_ids = game.objects.select(F.col("id").alias("o_id"))
    c_ids = resolve.owners(game).select(F.col("code_id").alias("c_id"))  # one row a code entry
    inst = F.col("instance_id")
    coded = instances.join(c_ids, (F.col("creation_code_id") >= 0) & (F.col("creation_code_id") == F.col("c_id")))
    out = [
        _rule(instances, node("room", "room_id"), node("instance", "instance_id"), "contains", 1, inst),
        _rule(instances.join(o_ids, F.col("object_id") == F.col("o_id"), "left_semi"), node("instance", "instance_id"), node("object", "object_id"), "is_instance_of", 2, inst),
        _rule(coded, node("instance", "instance_id"), node("code", "c_id"), "has_creation_code", 3, inst),
        _rule(coded, node("code", "c_id"), node("object", "object_id"), "creates", 4, inst),
    ]
    return reduce(DataFrame.unionByName, out)


def _other_edges(game: Game) -> DataFrame:
    """Edges of all rules from 5 on."""
    o_ids = game.objects.select(F.col("id").alias("o_id"))
    own = resolve.owners(game)
    c_ids, code = own.select(F.col("code_id").alias("c_id")), node("code", "code_id")
    out = [
        _rule(game.rooms.join(c_ids, F.col("creation_code_id") == F.col("c_id")), node("room", "id"), node("code", "c_id"), "has_creation_code", 5, F.col("id")),
        _rule(game.objects.join(o_ids, (F.col("parent_index") >= 0) & (F.col("parent_index") == F.col("o_id"))), node("object", "id"), node("object", "o_id"), "inherits", 6, F.col("id")),
        _rule(game.objects.join(game.sprites.select(F.col("id").alias("s_id")), (F.col("sprite_index") >= 0) & (F.col("sprite_index") == F.col("s_id"))), node("object", "id"), node("sprite", "s_id"), "uses_sprite", 7, F.col("id")),
        _rule(game.object_events.where("event_type = 4").join(o_ids, F.col("subtype") == F.col("o_id")), node("object", "object_id"), node("object", "o_id"), "collision_reference", 8, F.col("object_id")),
        _rule(own.where("object_id is not null"), node("object", "object_id"), code, "has_event", 9, F.col("code_id")),
    ]
    label = F.expr("substring(owner, instr(owner, '::') + 2)")
    for kind, prefix in ((OWNER_GLOBAL, "global_"), (OWNER_SEQUENCE, "seq_"), (OWNER_TIMELINE, "timeline_")):
        out.append(_rule(own.where(F.col("owner_type") == kind), F.concat(F.lit(prefix), label), code, "owns", 10, F.col("code_id")))
    out.append(_rule(resolve.entry_points(game), node("function", "func_id"), code, "entry_point", 11, F.col("func_id")))
    out.append(_rule(resolve.calls(game).where("callee is not null").select("caller", "callee").distinct(), node("code", "caller"), node("code", "callee"), "calls", 12))
    if not resolve.room_transitions(game).take(1):
        out.append(_rule(_stars(resolve.kept(game, "_instances", lambda g: g.instances)), node("room", "low"), node("room", "room_id"), "connected_to", 17, F.col("object_id")))
    return reduce(DataFrame.unionByName, [*out, _instruction_edges(game)])


def _stars(instances: DataFrame) -> DataFrame:
    """(object_id, room_id, low): without any transition by code, rooms that share an object hang together."""
    shared = instances.where("object_id >= 0").select("object_id", "room_id").distinct()
    low = shared.groupBy("object_id").agg(F.min("room_id").alias("low"))
    return shared.join(low, "object_id").where("room_id <> low")


def build_links(game: Game) -> DataFrame:
    """(src, dst, n): pairs that hang together as build_edges has them, with few instances; n sums up to the number of edges.

    An instance is one with its room, so instances that have a room and an id are counted by object, code and room, and their
    objects are hung to one room each before pairs are told apart. Instances stay nodes where several have one id or the
    room is null. A null end stands for none.
    """
    instances = resolve.kept(game, "_instances", lambda g: g.instances)
    whole = F.col("room_id").isNotNull() & F.col("instance_id").isNotNull()
    own_room, held = node("room", "room_id"), instances.where(whole)
    o_ids = game.objects.select(F.col("id").alias("object_id"))
    c_ids = resolve.owners(game).select(F.col("code_id").alias("creation_code_id")).where("creation_code_id >= 0")

    def link(rows: DataFrame, src: Column, dst: Column, n: Column) -> DataFrame:
        return rows.select(src.alias("src"), dst.alias("dst"), n.cast("long").alias("n"))

    def by(*keys: str) -> DataFrame:
        return held.groupBy(*keys).agg(F.count("*").alias("n"))

    n, none = F.col("n"), F.lit(0)
    hubs = cut(held.groupBy("object_id").agg(F.count("*").alias("n"), F.min("room_id").alias("hub")).join(o_ids, "object_id", "left_semi"))
    near = held.select("room_id", "object_id").join(hubs.select("object_id", "hub"), "object_id").where("room_id <> hub").select("room_id", "hub").distinct()
    out = [
        link(by("room_id"), own_room, own_room, n),
        link(hubs, node("room", "hub"), node("object", "object_id"), n),
        link(near, own_room, node("room", "hub"), none),
        link(by("creation_code_id", "room_id").join(c_ids, "creation_code_id"), own_room, node("code", "creation_code_id"), n),
        link(by("creation_code_id", "object_id").join(c_ids, "creation_code_id"), node("code", "creation_code_id"), node("object", "object_id"), n),
    ]
    # each is written alone, so that the shuffle files of one are gone before the next
    out = [cut(rows) for rows in out]
    shared = cut(instances.groupBy("instance_id").agg(F.count("*").alias("n")).where("n > 1 and instance_id is not null").select("instance_id"))
    if shared.take(1):
        out.append(cut(link(held.join(shared, "instance_id", "left_semi"), own_room, node("instance", "instance_id"), none)))
    odd = instances.where(~whole)
    if odd.take(1):
        out.append(cut(link(_placed_edges(game, odd), F.col("src"), F.col("dst"), F.lit(1))))
    out.append(cut(_other_edges(game).groupBy("src", "dst").agg(F.count("*").alias("n"))))
    return reduce(DataFrame.unionByName, out)


def room_edges(game: Game) -> DataFrame:
    """(room_id, part, kind, id, relation, rule, seq): build_edges at rooms without those to instances (rule 1), derived alone.

    part is incoming or outgoing; kind (room or code) and id are those of the other end.
    """
    told = cut(_room_instructions(game))
    moves = told.where(F.col("called") & F.col("room_id").isNotNull())
    made = resolve.function_classes(game.functions).where(F.col("creation") | F.col("execute")).select(F.col("func_id").alias("value_func_id"))
    c_ids = resolve.owners(game).select(F.col("code_id").alias("c_id"))

    def ends(rows: DataFrame, room: str, part: str, kind: str, other: str, relation: str, number: int, seq: str) -> DataFrame:
        return rows.select(F.col(room).alias("room_id"), F.lit(part).alias("part"), F.lit(kind).alias("kind"), F.col(other).alias("id"), F.lit(relation).alias("relation"), F.lit(number).alias("rule"), F.col(seq).cast("long").alias("seq"))

    if moves.take(1):
        number, seq, pairs = 15, "pos", moves.join(F.broadcast(game.rooms.agg(F.min("id").alias("low"))))  # one row
    else:
        number, seq, pairs = 17, "object_id", _stars(resolve.kept(game, "_instances", lambda g: g.instances))
    out = [
        ends(game.rooms.join(c_ids, F.col("creation_code_id") == F.col("c_id")), "id", "outgoing", "code", "c_id", "has_creation_code", 5, "id"),
        ends(pairs, "low", "outgoing", "room", "room_id", "connected_to", number, seq),
        ends(pairs, "room_id", "incoming", "room", "low", "connected_to", number, seq),
        ends(moves, "room_id", "incoming", "code", "code_id", "connected_to", 16, "pos"),
        ends(told.where(F.col("called") & F.col("arg_room").isNotNull()).join(made, "value_func_id", "left_anti"), "arg_room", "incoming", "code", "code_id", "connected_to", 22, "pos"),
        ends(told.where("own_room is not null"), "own_room", "incoming", "code", "code_id", "references", 25, "pos"),
    ]
    return reduce(DataFrame.unionByName, out)


def _room_instructions(game: Game) -> DataFrame:
    """(code_id, pos, value_func_id, called, room_id, arg_room, own_room): instructions that name rooms or look back to one.

    room_id and arg_room are those of looked (room_id and the room that arg7 names); own_room is the room that a listed
    string names where no object or sound has the name. Names turn into ids before the sort, so that it moves no text.
    """
    rooms = resolve.last_by_name(game.rooms).select(F.col("name").alias("r_name"), F.col("id").alias("named"))
    taken = game.objects.select("id", "name").union(game.sounds.select("id", "name")).where("id is not null").select(F.col("name").alias("r_name"))
    rooms = rooms.join(rooms.join(taken, "r_name", "left_anti").select("r_name", F.lit(True).alias("alone")), "r_name", "left")
    op = F.col("opcode")
    rows = game.instructions.join(rooms, (op == "PUSHSTR") & (F.col("value_str") == F.col("r_name")), "left")
    listed = F.when(F.col("value_str_id") >= 0, F.col("named"))
    rows = rows.select("code_id", "pos", "value_func_id", resolve.is_call(op).alias("called"), (~op.isin(*PASSED_OVER)).alias("shown"), "named", listed.alias("listed"), F.when(F.col("alone"), listed).alias("own_room"))
    w = Window.partitionBy("code_id").orderBy("pos")
    arg = F.last(F.when(F.col("shown"), F.struct("named")), ignorenulls=True).over(w.rowsBetween(-7, -1))
    rows = rows.select("code_id", "pos", "value_func_id", "called", F.last("listed", ignorenulls=True).over(w.rowsBetween(-14, -1)).alias("room_id"), arg["named"].alias("arg_room"), "own_room")
    return rows.where((F.col("called") & (F.col("room_id").isNotNull() | F.col("arg_room").isNotNull())) | F.col("own_room").isNotNull())


def _instruction_edges(game: Game) -> DataFrame:
    """Edges of single instructions, all by one pass: joins to maps of ids and names, then an array of what each row gives.

    Each map has one row a key, so rows stay as many; a map beyond the size that Spark broadcasts is joined by its key,
    and rows without the key, however many, are split by the adaptive skew join.
    """
    classes = resolve.function_classes(game.functions)
    functions = game.functions.select(F.col("id").alias("f_id")).join(classes, F.col("f_id") == F.col("func_id"), "left").join(resolve.entry_points(game).select(F.col("func_id").alias("e_id"), F.col("code_id").alias("callee")), F.col("f_id") == F.col("e_id"), "left")
    kinds = [rows.select("name", F.lit(kind).alias("kind"), "id") for kind, rows in (("object", game.objects), ("sound", game.sounds), ("room", game.rooms))]
    ids = [F.max(F.when(F.col("kind") == kind, F.col("id"))).alias(kind) for kind in ("object", "sound", "room")]
    named = reduce(DataFrame.union, kinds).groupBy("name").agg(*ids)  # of several of a name the last

    def names(prefix: str) -> DataFrame:
        return named.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("name", "object", "sound", "room")])

    op, arg = F.col("opcode"), F.col("arg7")
    called, pushed = resolve.is_call(op), (op == "PUSHSTR") & (F.col("value_str_id") >= 0)
    first = game.rooms.agg(F.min("id").alias("first_room"))  # one row
    rows = resolve.looked(game).join(game.objects.select(F.col("id").alias("o_id")), op.isin("INSTANTIATE", "PUSHI") & (F.col("value_int") == F.col("o_id")), "left")
    rows = rows.join(game.objects.select(F.col("id").alias("a_id")), (arg["opcode"] == "PUSHI") & (arg["value_int"] == F.col("a_id")), "left")
    rows = rows.join(names("a"), (arg["opcode"] == "PUSHSTR") & (arg["value_str"] == F.col("a_name")), "left")
    rows = rows.join(names("p"), pushed & (F.col("value_str") == F.col("p_name")), "left")
    rows = rows.join(game.strings.select(F.col("id").alias("s_id")), pushed & (F.col("value_str_id") == F.col("s_id")), "left")
    rows = rows.join(functions, called & (F.col("value_func_id") == F.col("f_id")), "left").join(F.broadcast(first))
    code, made, made_of = node("code", "code_id"), F.coalesce(F.col("creation") | F.col("execute"), F.lit(False)), F.coalesce("a_id", "a_object")
    told = F.when(F.col("p_object").isNotNull(), node("object", "p_object")).when(F.col("p_sound").isNotNull(), node("sound", "p_sound")).otherwise(node("room", "p_room"))
    told_as = F.when(F.col("p_object").isNull() & F.col("p_sound").isNotNull(), "references_sound").otherwise("references")
    moves = called & F.col("room_id").isNotNull()
    rules = [
        (called & F.col("f_id").isNotNull() & F.col("callee").isNull(), code, node("function", "f_id"), F.lit("calls_function"), 13),
        (called & F.col("flag").isNotNull(), code, node("flag", resolve.flag_index(F.col("arg4"))), F.when(F.col("flag") == "write", "writes_flag").otherwise("reads_flag"), 14),
        (moves, node("room", "first_room"), node("room", "room_id"), F.lit("connected_to"), 15),
        (moves, code, node("room", "room_id"), F.lit("connected_to"), 16),
        ((op == "INSTANTIATE") & F.col("o_id").isNotNull(), code, node("object", "o_id"), F.lit("creates"), 18),
        (called & made & made_of.isNotNull(), code, node("object", made_of), F.lit("creates"), 19),
        (called & F.col("asset") & F.col("a_object").isNotNull(), code, node("object", "a_object"), F.lit("asset_get_index_ref"), 20),
        (called & F.col("sound") & F.col("a_sound").isNotNull(), code, node("sound", "a_sound"), F.lit("references_sound"), 21),
        (called & ~made & F.col("a_room").isNotNull(), code, node("room", "a_room"), F.lit("connected_to"), 22),
        ((op == "WITH") & F.col("a_id").isNotNull(), code, node("object", "a_id"), F.lit("with_reference"), 23),
        ((op == "PUSHI") & F.col("o_id").isNotNull(), code, node("object", "o_id"), F.lit("references_object"), 24),
        (pushed & F.col("p_name").isNotNull(), code, told, told_as, 25),
        (pushed & F.col("s_id").isNotNull(), code, node("string", "s_id"), F.lit("references"), 26),
    ]
    given = F.array(*[F.when(when, F.struct(src.alias("src"), dst.alias("dst"), relation.alias("relation"), F.lit(number).alias("rule"))) for when, src, dst, relation, number in rules])
    edges = rows.select("pos", F.explode(F.filter(given, lambda e: e.isNotNull())).alias("e"))
    return edges.select("e.src", "e.dst", "e.relation", "e.rule", F.col("pos").cast("long").alias("seq"))


def build_nodes(game: Game, instances: bool = True) -> DataFrame:
    """(node_id, type, name, id, raw_name, x, y); on request without instances."""

    def kind(rows: DataFrame, of: str, name: Column, raw: Column | None = None, key: str = "id", x: Column | None = None, y: Column | None = None) -> DataFrame:
        null = F.lit(None)
        return rows.select(node(of, key).alias("node_id"), F.lit(of).alias("type"), name.cast("string").alias("name"), F.col(key).cast("string").alias("id"), (null if raw is None else raw).cast("string").alias("raw_name"), (null if x is None else x).cast("int").alias("x"), (null if y is None else y).cast("int").alias("y"))

    own = resolve.owners(game)
    flags = resolve.flag_uses(game).select("flag").distinct()
    out = [kind(rows, of, F.col("name")) for of, rows in (("object", game.objects), ("room", game.rooms), ("sprite", game.sprites), ("sound", game.sounds), ("variable", game.variables))]
    out.append(kind(game.code.join(own.select(F.col("code_id").alias("id"), "owner"), "id"), "code", F.col("owner"), F.col("name")))
    out.append(kind(game.functions, "function", F.when(F.col("name") != "", F.col("name")).otherwise(F.concat(F.lit("func_"), F.col("id")))))
    out.append(kind(game.strings, "string", F.substring("value", 1, 60)))
    if instances:
        out.append(kind(resolve.kept(game, "_instances", lambda g: g.instances), "instance", F.lit(None), key="instance_id", x=F.col("x"), y=F.col("y")))
    out.append(kind(flags, "flag", F.when(F.col("flag") < 0, "flag[?]").otherwise(F.concat(F.lit("flag["), F.col("flag"), F.lit("]"))), key="flag"))
    label = F.expr("substring(owner, instr(owner, '::') + 2)")
    prefix = F.when(F.col("owner_type") == OWNER_GLOBAL, "global").when(F.col("owner_type") == OWNER_SEQUENCE, "seq").otherwise("timeline")
    owned = own.where(F.col("owner_type").isin(OWNER_GLOBAL, OWNER_SEQUENCE, OWNER_TIMELINE)).select(F.concat(prefix, F.lit("_"), label).alias("node_id"), F.when(prefix == "global", "global_script").otherwise(prefix).alias("type"), label.alias("name")).distinct()
    null = F.lit(None)
    out.append(owned.select("node_id", "type", "name", null.cast("string").alias("id"), null.cast("string").alias("raw_name"), null.cast("int").alias("x"), null.cast("int").alias("y")))
    return reduce(DataFrame.unionByName, out)


class Graph:
    """Nodes and edges with the read API; edges may name nodes that don't exist, as in the package."""

    def __init__(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, game: Game | None = None):
        self._nodes, self._edges, self._game = nodes, edges, game

    @classmethod
    def of(cls, game: Game) -> Graph:
        """The graph of a package; nodes and edges are written once, when a query first reads them."""
        return cls(game=game)

    @property
    def nodes(self) -> DataFrame:
        if self._nodes is None:
            self._nodes = cut(build_nodes(self._game))
        return self._nodes

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = cut(build_edges(self._game))
        return self._edges

    @property
    def game(self) -> Game | None:
        """The package of a graph whose nodes and edges aren't made yet."""
        return self._game if self._nodes is None and self._edges is None else None

    def find(self, type: str, pattern: str | None = None) -> DataFrame:
        out = self.nodes.where(F.col("type") == type)
        return out if pattern is None else out.where(F.lower("name").contains(pattern.lower()))

    def _ends(self, out: DataFrame, *ends: str) -> DataFrame:
        for end in ends:
            about = self.nodes.select(F.col("node_id").alias(end), F.col("type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name"))
            out = out.join(about, end, "left")
        return out

    def find_edges(self, relation: str) -> DataFrame:
        return self._ends(self.edges.where(F.col("relation") == relation), "src", "dst")

    def incoming(self, nodes: DataFrame, relation: str | None = None) -> DataFrame:
        """(node, relation, source, type, name, rule, seq): one row for each edge into a node of nodes (node_id)."""
        return self._side(nodes, "dst", "src", relation)

    def outgoing(self, nodes: DataFrame, relation: str | None = None) -> DataFrame:
        """(node, relation, target, type, name, rule, seq)."""
        return self._side(nodes, "src", "dst", relation)

    def _side(self, nodes: DataFrame, at: str, other: str, relation: str | None) -> DataFrame:
        chosen = self.edges if relation is None else self.edges.where(F.col("relation") == relation)
        chosen = chosen.join(nodes.select(F.col("node_id").alias(at)).distinct(), at, "left_semi")
        rows = self._ends(chosen, other)
        return rows.select(F.col(at).alias("node"), "relation", F.col(other).alias("source" if other == "src" else "target"), F.coalesce(f"{other}_type", F.lit("?")).alias("type"), F.coalesce(f"{other}_name", other).alias("name"), "rule", "seq")

    def neighbors(self, nodes: DataFrame) -> DataFrame:
        a = self.incoming(nodes).select("node", F.col("source").alias("neighbor"))
        return a.union(self.outgoing(nodes).select("node", "target")).distinct()

    def degrees(self) -> DataFrame:
        """(node_id, in_degree, out_degree) of every node; repeated edges count."""
        ends = self.edges.select(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(self.edges.select("src", F.lit(0), F.lit(1)))
        sums = ends.groupBy("node_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        return self.nodes.select("node_id").join(sums, "node_id", "left").select("node_id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))

    def node_info(self) -> DataFrame:
        return self.nodes.select("node_id", "type", "name", "id").join(self.degrees(), "node_id")

    def roots(self) -> DataFrame:
        return self.nodes.join(self.edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")

    def leaves(self) -> DataFrame:
        return self.nodes.join(self.edges.select(F.col("src").alias("node_id")), "node_id", "left_anti")

    def view(self, name: str) -> DataFrame:
        """A simple digraph: one edge (src, dst) of a pair."""
        r = F.col("relation")
        rules = {
            "room": r == "connected_to",
            "call": (r == "calls") & F.col("src").startswith("code_") & F.col("dst").startswith("code_"),
            "object": r.isin("contains", "is_instance_of", "uses_sprite", "inherits", "placed_in"),
            "flag": r.isin("reads_flag", "writes_flag"),
        }
        return self.edges.where(rules[name]).select("src", "dst").distinct()

    def induced(self, nodes: DataFrame) -> DataFrame:
        """Edges between nodes of nodes (node_id)."""
        return self.edges.join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi").join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi")


def _seen(parts: list[DataFrame]) -> DataFrame:
    """The union of all levels' tables, which are only ever appended; every eighth level writes them as one."""
    if len(parts) >= 8:
        parts[:] = [cut(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node_id) of all nodes reached from roots (node_id), roots included: one semi-naive search for all roots."""
    edges = cut(edges.select("src", "dst").distinct())
    frontier = cut(roots.select("node_id").distinct())
    parts = [frontier]
    while frontier.take(1):
        near = edges.join(frontier.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("dst").alias("node_id")).distinct()
        frontier = cut(near.join(_seen(parts), "node_id", "left_anti"))
        parts.append(frontier)
    return _seen(parts)


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(node_id) of all nodes from which a target is reached, targets left out."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(back, targets).join(targets.select("node_id"), "node_id", "left_anti")


def shortest_path(edges: DataFrame, source: str, target: str) -> list[str]:
    """Nodes of a shortest path, of equal ones the one of least nodes; empty if there is none."""
    edges = cut(edges.select("src", "dst").distinct())
    frontier = cut(edges.sparkSession.createDataFrame([(source, None, 0)], "node_id string, parent string, dist int"))
    parts, step = [frontier], 0
    while frontier.take(1) and not frontier.where(F.col("node_id") == target).take(1):
        step += 1
        near = edges.join(frontier.select(F.col("node_id").alias("src")), "src").groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("parent"))
        frontier = cut(near.join(_seen(parts), "node_id", "left_anti").withColumn("dist", F.lit(step)))
        parts.append(frontier)
    seen = _seen(parts)
    path, at = [], target
    while at is not None:
        row = seen.where(F.col("node_id") == at).select("parent").first()
        if row is None:
            return []
        path.append(at)
        at = row["parent"]
    return path[::-1]


def weak_components(edges: DataFrame) -> DataFrame:
    """(node_id, component): the least node id that each node of edges is connected with."""
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = cut(edges.select(ends.alias("e")).select("e.*").distinct())
    comp = cut(both.groupBy(F.col("src").alias("node_id")).agg(F.min("dst").alias("m")).select("node_id", F.least("node_id", "m").alias("component")))
    while True:
        near = both.join(comp.withColumnRenamed("node_id", "dst"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.min("component").alias("m"))
        step = comp.join(near, "node_id").select("node_id", F.least("component", "m").alias("c"))
        # a node's label leads on to that label's own label, which halves long chains
        jump = step.select(F.col("node_id").alias("c"), F.col("c").alias("cc"))
        new = cut(step.join(jump, "c", "left").select("node_id", F.least("c", F.coalesce("cc", "c")).alias("component")))
        changed = new.join(comp.withColumnRenamed("component", "was"), "node_id").where("component <> was").take(1)
        drop(comp)
        if not changed:
            drop(both)
            return new
        comp = new


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """Simple cycles of at most ``longest`` nodes as (length, cycle), each once, from its least node on."""
    edges = cut(edges.select("src", "dst").distinct())
    paths = edges.where("dst >= src").select(F.array("src", "dst").alias("path"))
    found = [paths.where("path[0] = path[1]")]
    paths = paths.where("path[0] < path[1]")
    for _ in range(longest - 1):
        step = paths.join(edges, F.element_at("path", -1) == F.col("src")).where("dst >= path[0]")
        closed = step.where("dst = path[0]").select(F.concat("path", F.array("dst")).alias("path"))
        found.append(closed)
        paths = step.where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    every = reduce(DataFrame.union, found)
    return every.select((F.size("path") - 1).alias("length"), F.array_join("path", " > ").alias("cycle"))
