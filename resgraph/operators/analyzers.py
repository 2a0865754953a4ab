"""Analyzers of a source-text project: what is never used, never reached or inconsistent, each with a score.

All read one table of code units (object events, scripts, rooms with creation code) and one table of references, so the
order in which they run doesn't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resgraph.functions import text as T
from resgraph.session import cut

DEAD_AFTER = (r"exit\s*\(\s*\)", r"return\b(?!\s*\()", r"room_goto\s*\(", r"room_restart\s*\(\s*\)", r"game_end\s*\(\s*\)", r"game_restart\s*\(\s*\)", r"show_debug_message\s*\(", r"show_error\s*\(")
NEVER_TRUE = (r"global\.flag\[\d+\]\s*==\s*-1", r"global\.flag\[\d+\]\s*<\s*0", r"global\.plot\s*==\s*-1", r"false\s*(?:&&|\|\|)\s*true", r"true\s*&&\s*false")
#: Prefixes whose words are not taken for function names.
NOT_CALLS = ("if", "for", "while", "switch", "case", "var", "global", "self", "other", "with", "return", "break", "continue", "enum", "try", "catch", "throw", "new", "delete")

#: Columns of a project's relations, as Spark DDL.
DDL = {
    "objects": "name string, sprite string, parent string",
    "events": "object string, key string, code string",
    "rooms": "name string, creation_code string",
    "room_instances": "room string, object string",
    "scripts": "name string, code string, is_anonymous boolean",
    "sprites": "name string",
    "sounds": "name string",
    "fonts": "name string",
    "dialogues": "id string, text string",
}


def _has_key(word: str) -> Column:
    return F.coalesce(F.exists("keys", lambda key: key.contains(word)), F.lit(False))


@dataclass
class Project:
    objects: DataFrame
    events: DataFrame
    rooms: DataFrame
    room_instances: DataFrame
    scripts: DataFrame
    sprites: DataFrame
    sounds: DataFrame
    fonts: DataFrame
    dialogues: DataFrame


def _rows(rows: DataFrame, analyzer: str, name: Column, kind: str, score: Column | int, *reasons: Column | str) -> DataFrame:
    said = F.array_join(F.filter(F.array(*[F.lit(r) if isinstance(r, str) else r for r in reasons]), lambda x: x.isNotNull()), "; ")
    points = (F.lit(score) if isinstance(score, int) else score).cast("int")
    return rows.select(F.lit(analyzer).alias("analyzer"), name.alias("name"), F.lit(kind).alias("resource_type"), points.alias("score"), T.level(points).alias("level"), said.alias("reasons"))


class Analyzers:
    def __init__(self, project: Project):
        self.p = project

    @cached_property
    def units(self) -> DataFrame:
        """(kind, name, context, code)."""
        p = self.p
        events = p.events.select(F.lit("OBJECT").alias("kind"), F.col("object").alias("name"), F.concat(F.lit("Event: "), "key").alias("context"), "code")
        scripts = p.scripts.select(F.lit("SCRIPT"), "name", F.lit(""), "code")
        rooms = p.rooms.where("creation_code <> ''").select(F.lit("ROOM"), "name", F.lit(""), "creation_code")
        return cut(events.union(scripts).union(rooms))

    @cached_property
    def refs(self) -> DataFrame:
        """(kind, name, context, what, target): every match of every pattern."""
        return cut(T.extract(self.units))

    @cached_property
    def targets(self) -> DataFrame:
        """(kind, source, target, ref_type) of the call graph."""
        what, t = F.col("what"), F.col("target")
        kind = F.when(what.isin("script_call", "script_execute", "method"), "CALL").when((what == "create") & ~t.rlike("^[0-9]"), "DYNAMIC").when((what == "with") & ~t.isin(*T.PRONOUNS), "DYNAMIC").when(what == "room_goto", "TRANSITION").when(what == "play", "REFERENCE").when((what == "object_index") & ~t.isin(*T.PRONOUNS, "instance"), "REFERENCE")
        return self.refs.select("kind", F.col("name").alias("source"), "target", kind.alias("ref_type")).where("ref_type is not null")

    @cached_property
    def transitions(self) -> DataFrame:
        """(source, target, transition): named targets each, next/previous/restart once a unit."""
        u, code = self.units, F.col("code")
        named = self.refs.where("what = 'room_goto' and target <> 'room'").select(F.col("name").alias("source"), "target", F.lit("room_goto").alias("transition"))
        once = [u.where(code.rlike(rf"{f}\s*\(\s*\)")).select(F.col("name").alias("source"), F.lit(t).alias("target"), F.lit(f).alias("transition")) for f, t in (("room_goto_next", "__next__"), ("room_goto_previous", "__previous__"), ("room_restart", "__current__"))]
        return reduce(DataFrame.union, once, named)

    def _of(self, *what: str, kinds: tuple[str, ...] = ("OBJECT", "SCRIPT", "ROOM")) -> DataFrame:
        return self.refs.where(F.col("what").isin(*what) & F.col("kind").isin(*kinds)).select(F.col("target").alias("name")).distinct()

    # -- the sets ----------------------------------------------------------------------------------------------------
    @cached_property
    def dead_objects(self) -> DataFrame:
        p = self.p
        created = self._of("create", kinds=("OBJECT", "SCRIPT")).union(self._of("create_layer", kinds=("OBJECT",)))
        used = p.room_instances.select(F.col("object").alias("name")).union(created).union(p.objects.select("parent"))
        return p.objects.join(used, "name", "left_anti")

    @cached_property
    def dead_rooms(self) -> DataFrame:
        used = self.transitions.select(F.col("target").alias("name")).union(self.targets.select("target"))
        return self.p.rooms.join(used, "name", "left_anti")

    @cached_property
    def dead_scripts(self) -> DataFrame:
        called = self._of("script_call").union(self._of("script_execute", "method")).union(self.targets.where("ref_type in ('CALL', 'REFERENCE')").select("target"))
        return self.p.scripts.where("not is_anonymous").join(called, "name", "left_anti")

    @cached_property
    def dead_sounds(self) -> DataFrame:
        return self.p.sounds.join(self._of("play", "play_at", "sound_play", kinds=("OBJECT", "SCRIPT")), "name", "left_anti")

    @cached_property
    def dead_sprites(self) -> DataFrame:
        used = self._of("sprite_index", "draw_sprite", kinds=("OBJECT", "SCRIPT")).union(self._of("mask_index", kinds=("OBJECT",))).union(self.p.objects.where("sprite is not null").select("sprite"))
        return self.p.sprites.join(used, "name", "left_anti")

    @cached_property
    def dead_dialogues(self) -> DataFrame:
        said = self._of("dialogue_text", "dialogue_id", "message_id", "show_message")
        hashed = self._of("dialogue_text", "show_message").select(F.concat(F.lit("msg_"), F.lpad(F.lower(F.hex(F.crc32(F.col("name").cast("binary")))), 8, "0")))
        return self.p.dialogues.join(said.union(hashed).withColumnRenamed("name", "id"), "id", "left_anti")

    def dead(self) -> DataFrame:
        """(kind, name) of every set; kept, as reports read it again."""
        return self._dead

    @cached_property
    def _dead(self) -> DataFrame:
        sets = {"object": self.dead_objects, "room": self.dead_rooms, "script": self.dead_scripts, "sound": self.dead_sounds, "sprite": self.dead_sprites}
        rows = [rows.select(F.lit(kind).alias("kind"), "name") for kind, rows in sets.items()]
        return cut(reduce(DataFrame.union, [*rows, self.dead_dialogues.select(F.lit("dialogue"), "id")]))

    # -- the analyzers -----------------------------------------------------------------------------------------------
    def callgraph(self) -> DataFrame:
        t = self.targets
        pairs = t.select("source", "target").distinct()
        mutual = pairs.join(pairs.select(F.col("target").alias("source"), F.col("source").alias("target")), ["source", "target"])
        names = t.select(F.col("target").alias("name")).distinct()
        callers = t.select(F.col("source").alias("name")).distinct()
        return reduce(DataFrame.unionByName, [
            _rows(mutual, "callgraph", F.concat(F.lit("recursion_"), "source", F.lit("_"), "target"), "UNKNOWN", 30, F.concat(F.lit("Mutual recursion between "), "source", F.lit(" and "), "target")),
            _rows(names.where(F.col("name").startswith("scr_")).join(self.p.scripts, "name", "left_anti"), "callgraph", F.col("name"), "SCRIPT", 40, F.concat(F.lit("'"), "name", F.lit("' is called but does not exist as a script resource"))),
            _rows(names.where(F.col("name").startswith("obj_")).join(self.p.objects, "name", "left_anti"), "callgraph", F.col("name"), "OBJECT", 25, F.concat(F.lit("'"), "name", F.lit("' is referenced but does not exist as an object resource"))),
            _rows(callers.join(names, "name", "left_anti").join(self.p.objects, "name", "left_anti"), "callgraph", F.col("name"), "UNKNOWN", 10, F.concat(F.lit("'"), "name", F.lit("' has no callers (orphan caller)"))),
        ])

    def top_called(self, n: int = 20) -> DataFrame:
        return self.targets.groupBy("target").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "target").limit(n)

    @cached_property
    def code_lines(self) -> DataFrame:
        return T.lines(self.units)

    def deadcode(self) -> DataFrame:
        keys = ["kind", "name", "context"]
        text, line = F.col("text"), F.col("line")
        shown = (text != "") & ~text.startswith("//")
        ends = reduce(Column.__or__, [text.rlike(p) for p in DEAD_AFTER])
        after = self.code_lines.withColumn("next", T.next_line(keys, shown)).where(shown & ends & (F.col("next.text") != "}"))
        counts = after.groupBy(*keys).agg(F.count("*").alias("k"))
        stop = (line.rlike(r"\breturn\b") & ~line.rlike(r'return\s*"')) | line.contains("room_goto") | line.contains("room_restart") | line.contains("game_end")
        plain = shown & ~(text.contains("if") | text.contains("switch") | text.contains("{"))
        blocks = self.code_lines.withColumn("next", T.next_line(keys, plain)).where(stop & ~F.col("next.text").startswith("}"))
        cond = F.regexp_extract("text", r"^\s*if\s*\(\s*(.+?)\s*\)", 1)
        unequal = cond.rlike(r"^\d+\s*==\s*\d+$") & (F.regexp_extract(cond, r"^(\d+)", 1) != F.regexp_extract(cond, r"(\d+)$", 1))
        never = unequal | reduce(Column.__or__, [cond.rlike(p) for p in NEVER_TRUE])
        w = Window.partitionBy(*keys).orderBy("n")
        false = self.code_lines.withColumn("cond", cond).where(never).withColumn("nth", F.row_number().over(w)).where("nth <= 5")
        uncalled = self.p.scripts.where(F.col("name").startswith("gml_")).join(self.targets.select(F.col("target").alias("name")), "name", "left_anti").orderBy("name").limit(50)
        return reduce(DataFrame.unionByName, [
            _rows(counts, "deadcode", F.concat(F.lit("deadcode_"), "name", F.lit("_"), F.substring("context", 1, 20)), "UNKNOWN", F.col("k") * 5, F.concat(F.lit("Found "), "k", F.lit(" lines of dead code after return/goto at "), "name")),
            _rows(blocks, "deadcode", F.concat(F.lit("unreachable_"), "name", F.lit("_code after return/goto")), "UNKNOWN", 30, F.concat(F.lit("Unreachable code after return/goto block at line ~"), F.col("next.n") - 1)),
            _rows(false, "deadcode", F.concat(F.lit("never_true_"), "name"), "UNKNOWN", 35, F.concat(F.lit("Condition likely never true: '"), F.when(F.col("cond").rlike(r"^\d+\s*==\s*\d+$"), F.concat(F.lit("if("), "cond", F.lit(")"))).otherwise(F.col("cond")), F.lit("' at line ~"), "n")),
            _rows(uncalled, "deadcode", F.col("name"), "SCRIPT", 20, F.concat(F.lit("Anonymous/builtin script '"), "name", F.lit("' has no callers"))),
        ])

    def flag_counts(self) -> DataFrame:
        """(flag, sets, gets)."""
        return T.flag_accesses(self.units).groupBy("flag").agg(F.sum(F.col("is_write").cast("long")).alias("sets"), F.sum((~F.col("is_write")).cast("long")).alias("gets"))

    def flags(self) -> DataFrame:
        c = self.flag_counts()
        name = F.concat(F.lit("flag["), "flag", F.lit("]"))
        unset = _rows(c.where("sets = 0"), "flags", name, "UNKNOWN", F.when(F.col("gets") == 0, 70).otherwise(50), F.concat(F.lit("Flag "), "flag", F.lit(" is never set")), F.when(F.col("gets") == 0, "Flag is also never read (completely dead)"))
        return unset.unionByName(_rows(c.where("gets = 0 and sets > 0"), "flags", name, "UNKNOWN", 30, F.concat(F.lit("Flag "), "flag", F.lit(" is set but never read"))))

    def objects(self) -> DataFrame:
        keys = self.p.events.groupBy(F.col("object").alias("name")).agg(F.collect_set(F.lower("key")).alias("keys"))
        asked = self.targets.where("kind = 'OBJECT' and ref_type in ('DYNAMIC', 'REFERENCE')").select(F.col("target").alias("name")).distinct().withColumn("asked", F.lit(True))
        d = self.dead_objects.join(keys, "name", "left").join(asked, "name", "left")
        part = [(F.col("keys").isNotNull(), 40, F.lit("Has events but never instantiated"))]
        part += [(_has_key(w), n, F.lit(f"Has {w.title()} event but never instantiated")) for w, n in (("step", 20), ("draw", 15), ("alarm", 10))]
        part.append((F.coalesce(F.col("sprite"), F.lit("")) != "", 10, F.concat(F.lit("Has sprite ("), F.col("sprite"), F.lit(") but never instantiated"))))
        part.append((F.col("asked").isNull(), 20, F.lit("Not placed in any room, not created dynamically, not referenced")))
        score = reduce(Column.__add__, [F.when(c, n).otherwise(0) for c, n, _ in part])
        bare = self.p.objects.join(keys, "name", "left_anti").join(self.p.room_instances.select(F.col("object").alias("name")), "name", "left_anti")
        return _rows(d, "objects", F.col("name"), "OBJECT", score, *[F.when(c, r) for c, _, r in part]).unionByName(_rows(bare, "objects", F.col("name"), "OBJECT", 5, "Object has no events and is not placed in any room"))

    def rooms(self) -> DataFrame:
        full = self.p.room_instances.select(F.col("room").alias("name")).distinct().withColumn("full", F.lit(True))
        coded = F.coalesce(F.col("creation_code"), F.lit("")) != ""
        d = self.dead_rooms.join(full, "name", "left")
        score = F.lit(80) - F.when(F.col("full"), 10).otherwise(0) - F.when(coded, 5).otherwise(0)
        out = _rows(d, "rooms", F.col("name"), "ROOM", score, "No incoming room transitions", "Not referenced in any code", F.when(F.col("full"), "Has instances placed (may be start room)"), F.when(coded, "Has creation code"))
        leaving = self.transitions.select(F.col("source").alias("name"))
        ends = self.p.rooms.join(leaving, "name", "left_anti").join(self.dead_rooms.select("name"), "name", "left_anti").join(full, "name", "left")
        return out.unionByName(_rows(ends, "rooms", F.col("name"), "ROOM", F.when(F.col("full"), 20).otherwise(30), "No outgoing room transitions", F.when(F.col("full").isNull(), "No instances placed")))

    def scripts(self) -> DataFrame:
        return _rows(self.dead_scripts, "scripts", F.col("name"), "SCRIPT", 60, "Script never called from any code path")

    def sounds(self) -> DataFrame:
        return _rows(self.dead_sounds, "sounds", F.col("name"), "SOUND", 15, "Sound never played")

    def sprites(self) -> DataFrame:
        return _rows(self.dead_sprites, "sprites", F.col("name"), "SPRITE", 15, "Sprite never used")

    def dialogues(self) -> DataFrame:
        return _rows(self.dead_dialogues, "dialogues", F.col("id"), "UNKNOWN", 35, F.concat(F.lit("Dialogue never shown: "), F.substring("text", 1, 80)))

    def transition_findings(self) -> DataFrame:
        r = self.p.rooms.select("name")
        into = self.transitions.where(~F.col("target").isin("__next__", "__previous__", "__current__")).select(F.col("target").alias("name"))
        hidden = r.join(into, "name", "left_anti")
        terminal = r.join(self.transitions.select(F.col("source").alias("name")), "name", "left_anti").join(hidden, "name", "left_anti")
        own = self.refs.where((F.col("what") == "bare_call") & (F.col("target").startswith("goto_") | F.col("target").startswith("trans_")))
        return reduce(DataFrame.unionByName, [
            _rows(hidden, "transitions", F.col("name"), "ROOM", 50, "Room has no incoming transitions"),
            _rows(terminal, "transitions", F.col("name"), "ROOM", 20, "Room has no outgoing transitions"),
            _rows(own, "transitions", F.concat(F.lit("transition_"), "name", F.lit("_to_"), "target"), "UNKNOWN", 25, F.concat(F.lit("Custom transition function used to go to '"), "target", F.lit("' from '"), "name", F.lit("'"))),
        ])

    def plots(self) -> DataFrame:
        """Plot states read but never written, or that no switch handles."""
        n = self.code_lines
        keys = ["kind", "name", "context"]
        w = Window.partitionBy(*keys).orderBy("n")
        head = F.col("line").rlike(r"switch\s*\(\s*global\.plot\s*\)")
        inside = n.withColumn("sw", F.sum(head.cast("int")).over(w)).where("sw > 0")
        ws = Window.partitionBy(*keys, "sw").orderBy("n")
        inside = inside.withColumn("open", F.max(F.col("line").contains("{").cast("int")).over(ws))
        ended = (F.col("line").contains("}") & (F.col("open") == 1)).cast("int")
        inside = inside.withColumn("shut", F.coalesce(F.max(ended).over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        case = F.regexp_extract("line", r"^\s*case\s+(-?\d+)\s*:", 1)
        cases = inside.where((F.col("open") == 1) & (F.col("shut") == 0) & (case != "")).select(case.cast("long").alias("plot"))
        refs = self.refs.where("what in ('plot_write', 'plot_read')").select(F.col("target").cast("long").alias("plot"), (F.col("what") == "plot_write").alias("is_write"), F.lit(False).alias("handled"))
        every = refs.union(cases.select("plot", F.lit(False), F.lit(True)))
        c = every.groupBy("plot").agg(F.max("is_write").alias("written"), F.max("handled").alias("handled"), F.sum((~F.col("is_write")).cast("int")).alias("reads"))
        score = F.when(F.col("handled"), 0).otherwise(40) + F.when(F.col("written"), 0).otherwise(F.col("reads") * 20)
        rows = c.withColumn("score", score).where("score > 0")
        return _rows(rows, "plots", F.concat(F.lit("plot_state_"), "plot"), "UNKNOWN", F.col("score"), F.when(~F.col("handled"), F.concat(F.lit("Plot state "), "plot", F.lit(" referenced but no code handles it"))), F.when(~F.col("written") & (F.col("reads") > 0), F.concat(F.lit("Plot state "), "plot", F.lit(" read but never written"))))

    def suspicious(self) -> DataFrame:
        """(analyzer, name, resource_type, score, level, reasons) of all analyzers; kept, as reports read it again."""
        return self._suspicious

    @cached_property
    def _suspicious(self) -> DataFrame:
        return cut(reduce(DataFrame.unionByName, [f() for f in (self.callgraph, self.deadcode, self.flags, self.objects, self.rooms, self.scripts, self.sounds, self.sprites, self.dialogues, self.transition_findings, self.plots)]))

    def top(self, n: int = 100) -> DataFrame:
        return self.suspicious().orderBy(F.desc("score"), "analyzer", "name").limit(n)

    # -- the dependency graph ----------------------------------------------------------------------------------------
    def nodes(self) -> DataFrame:
        """(node_id, type)."""
        p = self.p
        kinds = {"object": p.objects, "room": p.rooms, "script": p.scripts, "sprite": p.sprites, "sound": p.sounds, "font": p.fonts}
        return reduce(DataFrame.union, [rows.select(F.col("name").alias("node_id"), F.lit(kind).alias("type")) for kind, rows in kinds.items()]).distinct()

    def edges(self) -> DataFrame:
        """(src, dst, label): one edge of a pair, the label of the last rule that gives one."""
        return self._edges

    @cached_property
    def _edges(self) -> DataFrame:
        p = self.p
        call = self.refs.where((F.col("what") == "function") & (F.length("target") > 1) & ~reduce(Column.__or__, [F.col("target").startswith(x) for x in NOT_CALLS]))
        key = F.substring_index("context", "Event: ", -1)
        rules = [
            p.objects.where("sprite is not null").select("name", "sprite", F.lit("uses_sprite")),
            p.objects.where("parent is not null").select("name", "parent", F.lit("inherits")),
            p.room_instances.select("room", "object", F.lit("contains")),
            p.room_instances.select("object", "room", F.lit("placed_in")),
            self.transitions.select("source", "target", F.concat(F.lit("transitions_"), "transition")),
            self.targets.select("source", "target", F.lower("ref_type")),
            call.where("kind = 'SCRIPT'").join(p.scripts.select(F.col("name").alias("target")), "target", "left_semi").select("name", "target", F.lit("calls")),
            call.where("kind = 'SCRIPT'").join(p.objects.select(F.col("name").alias("target")), "target", "left_semi").select("name", "target", F.lit("references")),
            call.where("kind = 'OBJECT'").join(p.scripts.select(F.col("name").alias("target")), "target", "left_semi").select("name", "target", F.concat(F.lit("event_"), key, F.lit("_calls"))),
            call.where("kind = 'OBJECT'").join(p.objects.select(F.col("name").alias("target")), "target", "left_semi").select("name", "target", F.concat(F.lit("event_"), key, F.lit("_references"))),
        ]
        every = reduce(DataFrame.union, [r.toDF("src", "dst", "label").withColumn("rule", F.lit(k)) for k, r in enumerate(rules)])
        last = every.groupBy("src", "dst").agg(F.max(F.struct("rule", "label")).alias("last"))
        known = self.nodes().select("node_id").distinct()
        last = last.join(known.withColumnRenamed("node_id", "src"), "src", "left_semi").join(known.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        return cut(last.select("src", "dst", "last.label"))
