"""Binary packages: chunk directory, string table, resource tables and bytecode, decoded into relations.

A package is one byte string with absolute pointers, so one task decodes one package, once: the rows of all relations
leave that pass in batches and are written in folders by relation. Packages spread over tasks. Layout (little-endian): a FORM (8 bytes) or WAD (12 bytes) header, then chunks
of tag, size and body, aligned to 4. Damaged entries are left out, as far as the layout lets a reader tell.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resgraph.functions.opcodes import opcode_name
from resgraph.schema import DDL, DETAIL_DDL, Game
from resgraph.session import cut

#: Bytes after the 6-byte head of an instruction, by opcode; jumps and strings have 4 unused bytes after their operand.
OPERAND = {1: 4, 2: 4, 3: 4, 4: 4, 5: 4, 6: 4, 7: 4, 8: 8, 9: 8, 14: 4, 15: 4, 16: 4, 17: 8, 18: 8, 46: 4, 59: 4}
MOST_ENTRIES, MOST_CODE = 100_000, 1 << 20
MOST_FRAMES, MOST_BACKGROUNDS, MOST_VIEWS, MOST_LAYERS = 500, 100, 32, 1000
CHUNKS = "pkg string, tag string, offset long, size long"
#: Kinds of variables in order of their numbers, from 0 on; another number stands for GLOBAL.
VARIABLE_KINDS = ("LOCAL", "GLOBAL", "INSTANCE", "BUILTIN")
#: Fields of entries in their order in the file (i, I numbers of 4 bytes, f floats, B flags of one byte, x unused).
ACTION = struct.Struct("<3i3Bx3i4xii4x2B")
SPRITE, FRAME = struct.Struct("<10i3Bxi3i"), struct.Struct("<11i")
BACKGROUND, VIEW = struct.Struct("<2B2x7iB"), struct.Struct("<B3x12i")
PLACED = struct.Struct("<3fiIf")
BATCH = 10_000
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


class Bytes:
    """Bounds-checked reads; what lies outside reads as 0 or an empty string."""

    def __init__(self, data: bytes):
        self.data = data

    def int(self, at: int, kind: str = "<i") -> int:
        return struct.unpack_from(kind, self.data, at)[0] if 0 <= at <= len(self.data) - struct.calcsize(kind) else 0

    def uint(self, at: int) -> int:
        return self.int(at, "<I")

    def text(self, at: int, most: int = 4096) -> str:
        if not 0 < at < len(self.data):
            return ""
        end = self.data.find(b"\0", at, at + most)
        return self.data[at : end if end >= 0 else at + most].decode("utf-8", "replace")


def chunks(data: bytes) -> dict[str, tuple[int, int]]:
    """tag -> (offset of the body, size); a repeated tag keeps its last place, texture pages end the walk."""
    start = {b"FORM": 8, b"WAD ": 12, b"WAD2": 12}.get(data[:4])
    if start is None:
        raise ValueError("compressed package" if data[:3] == b"PK\x03" or data[:2] == b"\x1f\x8b" else f"unknown package format {data[:4]!r}")
    b, out, at = Bytes(data), {}, start
    while at < len(data) - 8:
        tag, size = data[at : at + 4].decode("ascii", "replace"), b.uint(at + 4)
        if tag == "TXTR":
            out[tag] = (at, size + 8)
            break
        out[tag] = (at + 8, size)
        at = (at + 8 + size + 3) & ~3
    return out


def _pointers(b: Bytes, where: tuple[int, int] | None) -> list[int]:
    if where is None or (n := b.uint(where[0])) > MOST_ENTRIES:
        return []
    return [b.uint(where[0] + 4 + 4 * k) for k in range(n)]


def strings(b: Bytes, where: tuple[int, int] | None) -> list[str]:
    """Length-prefixed texts after an index that is passed over; without room for one they follow the count."""
    if where is None:
        return []
    begin, end, n = where[0], where[0] + where[1], b.uint(where[0])
    indexed = begin + 4 + 4 * n < end
    at, out = begin + 4 + (4 * n if indexed else 0), []
    for _ in range(n):
        if at + 4 > end:
            break
        size = b.uint(at)
        if size == 0 or size > (end - at - 4 if indexed else 4096):
            if indexed:
                out.append("")
            at += 4
            continue
        out.append(b.data[at + 4 : at + 4 + size].decode("utf-8", "replace"))
        at = (at + 4 + size + 3) & ~3
    return out


def instructions(b: Bytes, begin: int, size: int, table: list[str]) -> Iterator[tuple]:
    """(pos, opcode, value_int, value_str, value_str_id, value_func_id, value_variable_id, arg_count) of one code entry."""
    at, pos, end = begin, 0, min(begin + size, len(b.data))
    while 0 <= at <= end - 6:
        op, argc = b.data[at], b.data[at + 4]
        at += 6
        has = OPERAND.get(op, 0) and at + 4 <= end
        value = b.int(at) if has else None
        name = opcode_name(op)
        said = None
        if name == "PUSHSTR" and has:
            said = table[value] if 0 <= value < len(table) else f"<str_{value}>"
        yield (
            pos, name, value if name in ("PUSHI", "PUSHENV", "POPENV", "INSTANTIATE") else None, said, value if said is not None else -1,
            value if has and name in ("CALL", "CALLV", "CALLVN", "NEW_OBJECT") else -1, value if has and name in ("PUSH", "PUSHLOC", "PUSHGLB", "PUSHBLTN") else -1,
            argc if name in ("CALL", "CALLV", "CALLVN") else 0,
        )
        at += OPERAND.get(op, 0)
        pos += 1


def decode(data: bytes) -> Iterator[tuple[str, tuple]]:
    """(relation, row) for every row of the relations of schema.DDL and schema.DETAIL_DDL that a package holds."""
    b, where = Bytes(data), chunks(data)
    table = strings(b, where.get("STRG"))

    def said(i: int, other: str) -> str:
        return table[i] if 0 <= i < len(table) else other

    for i, text in enumerate(table):
        yield "strings", (i, text)
    for i, at in _entries(b, where.get("SPRT"), 80):
        yield "sprites", (i, b.text(b.uint(at)) or f"<spr_{i}>")
        *sizes, transparent, smooth, preload, frames, group, x, y = SPRITE.unpack_from(data, at + 4)
        frames = frames if 0 <= frames <= MOST_FRAMES else 0
        yield "sprite_fields", (i, *sizes, transparent != 0, smooth != 0, preload != 0, frames, group, x, y)
        for nth in range(frames):
            if (place := at + 64 + FRAME.size * nth) + 48 > len(data):
                break
            yield "sprite_frames", (i, nth, *FRAME.unpack_from(data, place))
    for i, at in _entries(b, where.get("SOND"), 40):
        yield "sounds", (i, b.text(b.uint(at)) or f"<snd_{i}>")
        # the file's string id and the pitch are two readings of one field
        yield "sound_fields", (i, b.int(at + 4), said(b.int(at + 12), ""), b.int(at + 8, "<f"), b.int(at + 12, "<f"), b.int(at + 16, "<b") != 0, b.int(at + 20), b.int(at + 24), b.int(at + 28))
    for i, at in _entries(b, where.get("OBJT"), 68):
        yield "objects", (i, b.text(b.uint(at)) or f"<obj_{i}>", b.int(at + 4), b.int(at + 32), b.int(at + 28))
        yield "object_fields", (i, b.int(at + 8) != 0, b.int(at + 16) != 0, b.int(at + 20), b.int(at + 24) != 0, b.int(at + 36) != 0)
        yield from _events(b, i, at)
    yield from _rooms(b, where.get("ROOM"))
    if (f := where.get("FUNC")) is not None:
        n = b.uint(f[0])
        for i in range(min(n, (min(sum(f), len(data)) - f[0] - 4) // 12) if n <= MOST_ENTRIES else 0):
            yield "functions", (i, said(b.int(f[0] + 4 + 12 * i + 4), f"<func_{i}>"), b.int(f[0] + 4 + 12 * i + 8))
    for i, at in _entries(b, where.get("VARI"), 16):
        yield "variables", (i, said(b.int(at + 4), f"<var_{i}>"))
        kind = b.int(at + 8)
        yield "variable_fields", (i, VARIABLE_KINDS[kind if 0 <= kind < len(VARIABLE_KINDS) else 1], b.int(at + 12, "<b") != 0, said(b.int(at + 16), ""))
    strg = where.get("STRG", (0, 0))
    for i, at in _entries(b, where.get("CODE"), 20):
        name, size, packed, rel, off = b.uint(at), b.uint(at + 4), b.uint(at + 8), b.int(at + 12), b.uint(at + 16)
        begin, size = at + 20 + rel + off, size - off
        yield "code", (i, b.text(name) if strg[0] <= name < strg[0] + strg[1] else "", begin, size)
        yield "code_fields", (i, packed & 0xFFFF, packed >> 16 & 0x7FFF)
        if 0 < size <= MOST_CODE:
            for row in instructions(b, begin, size, table):
                yield "instructions", (i, *row)


def _entries(b: Bytes, where: tuple[int, int] | None, least: int) -> Iterator[tuple[int, int]]:
    """(number, place) of a chunk's entries that have room for as many bytes."""
    return ((i, at) for i, at in enumerate(_pointers(b, where)) if 0 < at <= len(b.data) - least)


def _events(b: Bytes, object_id: int, at: int) -> Iterator[tuple[str, tuple]]:
    start = at + 84 + 8 * b.int(at + 68)
    kinds = b.uint(start)
    for kind in range(kinds if 0 < kinds <= 16 else 0):
        listed = b.uint(start + 4 + 4 * kind)
        n = b.uint(listed) if listed else 0
        for k in range(n if n <= 100 else 0):
            event = b.uint(listed + 4 + 4 * k)
            actions = b.uint(event + 4) if event else 0
            if not 0 < actions <= 100:
                continue
            code = -1
            for nth in range(actions):
                place = b.uint(event + 8 + 4 * nth)
                if 0 < place <= len(b.data) - 56:
                    row = ACTION.unpack_from(b.data, place)
                    code = row[9] if code < 0 else code
                    yield "event_actions", (object_id, kind, b.int(event), nth, *row[:3], *(x != 0 for x in row[3:6]), *row[6:11], *(x != 0 for x in row[11:]))
            yield "object_events", (object_id, kind, b.int(event), max(code, -1))


def _rooms(b: Bytes, where: tuple[int, int] | None) -> Iterator[tuple[str, tuple]]:
    """Rooms and what they hold; of their placed objects those that a layer of instances lists."""
    places = _pointers(b, where)
    for i, at in _entries(b, where, 96):
        end = min(places[i + 1] if i + 1 < len(places) else sum(where), len(b.data))

        def held(pointer: int, most: int, size: int, end: int = end) -> Iterator[tuple[int, int]]:
            """The listed entries up to the first that doesn't fit the room."""
            for nth, p in enumerate(_listed(b, b.uint(pointer), most)):
                if p + size > end:
                    return
                yield nth, p

        yield "rooms", (i, b.text(b.uint(at)) or f"<room_{i}>", b.int(at + 8), b.int(at + 12), b.int(at + 16), b.int(at + 20, "<b") != 0, b.int(at + 32))
        yield "room_fields", (i, b.text(b.uint(at + 4)), b.uint(at + 24), b.uint(at + 36), *(b.uint(at + k) for k in (60, 64, 68, 72)), *(b.int(at + k, "<f") for k in (76, 80, 84)))
        for nth, p in held(at + 40, MOST_BACKGROUNDS, 40):
            enabled, foreground, shown, x, y, tile_x, tile_y, across, down, stretch = BACKGROUND.unpack_from(b.data, p)
            yield "room_backgrounds", (i, nth, enabled != 0, foreground != 0, shown, x, y, tile_x != 0, tile_y != 0, across, down, stretch != 0)
        for nth, p in held(at + 44, MOST_VIEWS, 56):
            enabled, *numbers = VIEW.unpack_from(b.data, p)
            yield "room_views", (i, nth, enabled != 0, *numbers)
        placed = {b.uint(p + 12): p for _, p in held(at + 48, MOST_ENTRIES, 48)}
        for nth, layer in held(at + 88, MOST_LAYERS, 36):
            kind, depth = b.uint(layer + 8), b.int(layer + 12)
            yield "room_layers", (i, nth, b.text(b.uint(layer)), kind, depth, b.int(layer + 32, "<b") != 0)
            n = b.uint(layer + 48) if kind == 2 and layer + 52 <= end else 0
            for k in range(n if n <= MOST_ENTRIES else 0):
                if layer + 56 + 4 * k > end:
                    break
                key = b.uint(layer + 52 + 4 * k)
                if (p := placed.get(key)) is not None:
                    yield "instances", (i, key, b.int(p + 8), b.int(p), b.int(p + 4), b.int(p + 16))
                    yield "instance_fields", (i, key, *PLACED.unpack_from(b.data, p + 20), depth)


def _listed(b: Bytes, at: int, most: int) -> list[int]:
    """The entries of a counted list of absolute pointers."""
    n = b.uint(at) if at > 0 else 0
    return [p for k in range(n if n <= most else 0) if 0 < (p := b.uint(at + 4 + 4 * k)) < len(b.data)]


def _columns(ddl: str) -> dict[str, str]:
    return dict(c.split() for c in ddl.split(", "))


def _batch(file: str, name: str, rows: list[tuple], wide: dict[str, str]) -> pa.RecordBatch:
    """Rows of one relation in the columns of all; those of other relations are null."""
    told = dict(zip(_columns((DDL | DETAIL_DDL)[name]), zip(*rows, strict=True), strict=True))
    columns = [pa.array(told[c], ARROW[t]) if c in told else pa.nulls(len(rows), ARROW[t]) for c, t in wide.items()]
    return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([name] * len(rows)), *columns], ["pkg", "relation", *wide])


def read_package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Relations of schema.DDL and schema.DETAIL_DDL with the package's path as pkg, from one or many files, each decoded once."""
    every = DDL | DETAIL_DDL
    wide = {c: t for ddl in every.values() for c, t in _columns(ddl).items()}

    def run(batches):
        for part in batches:
            for file, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                held: dict[str, list[tuple]] = {}
                for name, row in decode(data.as_py()):
                    held.setdefault(name, []).append(row)
                    if len(held[name]) == BATCH:
                        yield _batch(file, name, held.pop(name), wide)
                for name, rows in held.items():
                    yield _batch(file, name, rows, wide)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = cut(files.mapInArrow(run, "pkg string, relation string, " + ", ".join(f"{c} {t}" for c, t in wide.items())), "relation")
    return {name: rows.where(F.col("relation") == name).select("pkg", *_columns(ddl)) for name, ddl in every.items()}


def package_game(spark: SparkSession, path: str) -> Game:
    """The relations of one package that its graph is built of."""
    told = read_package(spark, path)
    return Game(**{name: told[name].drop("pkg") for name in DDL})


def chunk_directory(spark: SparkSession, path: str) -> DataFrame:
    """(pkg, tag, offset, size) of every chunk."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for part in batches:
            for file, data in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(file, t, o, s) for t, (o, s) in chunks(bytes(data)).items()], columns=["pkg", "tag", "offset", "size"])

    return files.mapInPandas(run, CHUNKS)


def string_at(strings: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """wanted with the value of each id; an id outside the table reads as <string_id>."""
    known = strings.select(F.col("id").alias("_id"), F.col("value").alias("_value"))
    named = wanted.join(known, F.col(f"`{key}`") == F.col("_id"), "left")
    return named.withColumn("value", F.coalesce("_value", F.concat(F.lit("<string_"), F.col(f"`{key}`").cast("string"), F.lit(">")))).drop("_id", "_value")


def string_id(strings: DataFrame, wanted: DataFrame, key: str = "value") -> DataFrame:
    """wanted with the least id of each text; -1 where the table lacks it."""
    first = strings.groupBy(F.col("value").alias("_value")).agg(F.min("id").alias("_id"))
    return wanted.join(first, F.col(f"`{key}`") == F.col("_value"), "left").withColumn("id", F.coalesce("_id", F.lit(-1))).drop("_id", "_value")


def strings_like(strings: DataFrame, part: str = "", prefix: str = "", suffix: str = "") -> DataFrame:
    """Rows of a string table by part of the text (without case), prefix and suffix."""
    v = F.col("value")
    return strings.where(F.lower(v).contains(part.lower()) & v.startswith(prefix) & v.endswith(suffix))
