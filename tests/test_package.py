"""A synthetic package, written byte by byte from the fixture, decodes to the fixture's relations."""

from __future__ import annotations

import struct

import pytest

from resgraph.operators.queries import Engine
from resgraph.sources import package
from resgraph.functions.opcodes import OPCODES
from resgraph.schema import DDL, DETAIL_DDL
from resgraph.sources.package import decode
from tests.fixture import ROWS

NUMBER = {name: n for n, name in enumerate(OPCODES)}


def u(*values: int) -> bytes:
    return struct.pack(f"<{len(values)}i", *values)


def op(row: tuple) -> bytes:
    _, _, name, value, _, string, function, variable, argc = row
    raw = bytes([NUMBER[name], 0, 0, 0, argc, 0])
    if name == "PUSHI":
        return raw + u(value)
    if name == "PUSHSTR":
        return raw + u(string, 0)
    if name == "CALL":
        return raw + u(function)
    return raw + (u(variable) if name == "PUSHBLTN" else b"")


def write() -> bytes:
    """FORM, STRG (with names as C strings after the table), then the other chunks with absolute pointers."""
    texts = [v for _, v in ROWS["strings"]] + [n for _, n, _ in ROWS["functions"]]
    body = u(len(texts), *[0] * len(texts))
    for t in texts:
        body += u(len(t)) + t.encode()
        body += b"\0" * (-len(body) % 4)
    at: dict[str, int] = {}
    names = [r[1] for k in ("objects", "rooms", "sprites", "sounds", "code") for r in ROWS[k]]
    for n in names:
        at[n] = 16 + len(body)
        body += n.encode() + b"\0"
    body += b"\0" * (-len(body) % 4)
    out = b"FORM" + u(0) + b"STRG" + u(len(body)) + body

    def table(tag: str, entries: list) -> None:
        """entries: functions of their own place that give their bytes."""
        nonlocal out
        start = len(out) + 8
        body, places = b"", []
        for e in entries:
            places.append(start + 4 + 4 * len(entries) + len(body))
            body += e(places[-1])
            body += b"\0" * (-len(body) % 4)
        body = u(len(entries), *places) + body
        out += tag.encode() + u(len(body)) + body

    def obj(row: tuple):
        def entry(place: int) -> bytes:
            i, name, sprite, mask, parent = row
            head = u(at[name], sprite, 1, 0, 0, 0, 0, parent, mask, *[0] * 12)  # 84 bytes
            events = [r for r in ROWS["object_events"] if r[0] == i]
            kinds = sorted({r[1] for r in events})
            if not kinds:
                return head + u(0)
            slots = kinds[-1] + 1
            raw, pointers = b"", [0] * slots
            base = place + 84 + 4 + 4 * slots
            for k in kinds:
                mine = [r for r in events if r[1] == k]
                pointers[k] = base + len(raw)
                first = base + len(raw) + 4 + 4 * len(mine)
                raw += u(len(mine), *[first + 68 * j for j in range(len(mine))])
                for j, r in enumerate(mine):
                    raw += u(r[2], 1, first + 68 * j + 12) + u(*[0] * 8, r[3], *[0] * 5)
            return head + u(slots, *pointers) + raw

        return entry

    def room(row: tuple):
        def entry(place: int) -> bytes:
            i, name, width, height, speed, _, code = row
            mine = [r for r in ROWS["instances"] if r[0] == i]
            objects = place + 96
            first = objects + 4 + 4 * len(mine)
            layers = first + 48 * len(mine)
            head = u(at[name], 0, width, height, speed, 0, 0, 0, code, 0, 0, 0, objects, *[0] * 9, layers, 0)
            raw = u(len(mine), *[first + 48 * k for k in range(len(mine))])
            for _, key, o, x, y, c in mine:
                raw += u(x, y, o, key, c, *[0] * 7)
            return head + raw + u(1, layers + 8) + u(0, 0, 2, *[0] * 9, len(mine), *[r[1] for r in mine])

        return entry

    def code(row: tuple):
        raw = b"".join(op(r) for r in ROWS["instructions"] if r[0] == row[0])
        return lambda place: u(at[row[1]], len(raw), 0, 0, 0) + raw

    for tag, kind in (("SPRT", "sprites"), ("SOND", "sounds")):
        table(tag, [lambda place, r=r: u(at[r[1]], *[0] * 15) for r in ROWS[kind]])
    table("OBJT", [obj(r) for r in ROWS["objects"]])
    table("ROOM", [room(r) for r in ROWS["rooms"]])
    functions = b"".join(u(0, len(ROWS["strings"]) + k, 0) for k in range(len(ROWS["functions"])))
    out += b"FUNC" + u(4 + len(functions)) + u(len(ROWS["functions"])) + functions
    table("CODE", [code(r) for r in ROWS["code"]])
    return out + b"\0" * 16


def relations(data: bytes) -> dict[str, list]:
    got: dict[str, list] = {name: [] for name in DDL | DETAIL_DDL}
    for name, row in decode(data):
        got[name].append(row)
    return got


def test_decode():
    got = relations(write())
    for name in ("objects", "rooms", "instances", "sprites", "sounds", "functions"):
        assert sorted(got[name]) == sorted(ROWS[name]), name
    assert sorted(got["object_events"]) == sorted(ROWS["object_events"])
    assert [s for _, s in got["strings"]][:3] == [s for _, s in ROWS["strings"]]
    assert [r[:2] for r in got["code"]] == [r[:2] for r in ROWS["code"]]
    assert got["instructions"] == [tuple(r) for r in ROWS["instructions"]]


def test_formats():
    assert package.chunks(b"WAD " + u(0, 0) + b"STRG" + u(4) + u(0) + b"\0" * 12)["STRG"] == (20, 4)
    for bad in (b"PK\x03\x04....", b"\x1f\x8b......", b"????????"):
        with pytest.raises(ValueError):
            package.chunks(bad)


def test_engine_from_file(spark, tmp_path):
    path = tmp_path / "data.win"
    path.write_bytes(write())
    engine = Engine(package.package_game(spark, str(path)))
    assert engine.unreachable_rooms().collect()[0].name == "room_void"
    assert {r.tag for r in package.chunk_directory(spark, str(path)).collect()} >= {"STRG", "OBJT", "ROOM", "CODE"}
    assert package.strings_like(engine.game.strings, part="NEVER").count() == 1


def chunk(data: bytes, tag: str, entry) -> bytes:
    """data with one more chunk of one entry, which is made from its own place."""
    raw = entry(len(data) + 16)
    return data + tag.encode() + u(8 + len(raw), 1, len(data) + 16) + raw


def f(*values: float) -> bytes:
    return struct.pack(f"<{len(values)}f", *values)


def test_fields_of_entries(spark, tmp_path):
    texts = b"FORM" + u(0) + b"STRG" + u(28) + u(1, 0) + u(4) + b"a.ogg"[:4] + b"\0" * 12
    sprite = u(0, 32, 16, *range(1, 9)) + bytes([1, 0, 1, 0]) + u(2, 7, 3, 4) + u(*range(11)) + u(*range(20, 31)) + b"\0" * 24
    data = chunk(texts, "SPRT", lambda at: sprite)
    data = chunk(data, "SOND", lambda at: u(0, 5) + f(0.5) + u(0) + bytes([1, 0, 0, 0]) + u(6, 700, 80) + b"\0" * 16)

    def room(at: int) -> bytes:
        head = [0, 0, 320, 240, 30, 1, 255, 0, -1, 3, at + 96, at + 144, at + 208, *[0] * 9, at + 264, 0]
        background = u(1, at + 104) + bytes([1, 0, 0, 0]) + u(9, 10, 11, 1, 0, 2, -2) + bytes([1, 0, 0, 0]) + b"\0" * 4
        view = u(1, at + 152) + bytes([1, 0, 0, 0]) + u(*range(12)) + b"\0" * 4
        thing = u(1, at + 216) + u(10, 20, 4, 900, -1) + f(1.5, 2.0, 0.25) + u(3, 77) + f(90.0) + u(0)
        layer = u(1, at + 272) + u(0, 0, 2, -50, 0, 0, 0, 0, 1, 0, 0, 0, 2, 900, 901)
        return u(*head) + background + view + thing + layer + b"\0" * 16

    data = chunk(data, "ROOM", room)
    data = chunk(data, "VARI", lambda at: u(0, 0, 3, 1, 0, 0))
    data = chunk(data, "CODE", lambda at: u(0, 0, 2 - (0x7FFD << 16), 0, 0)) + b"\0" * 16
    path = tmp_path / "data.win"
    path.write_bytes(data)
    told = {name: [tuple(r)[1:] for r in rows.collect()] for name, rows in package.read_package(spark, str(path)).items()}
    assert told["sprite_fields"] == [(0, 32, 16, *range(1, 9), True, False, True, 2, 7, 3, 4)]
    assert sorted(told["sprite_frames"]) == [(0, 0, *range(11)), (0, 1, *range(20, 31))]
    assert told["sound_fields"] == [(0, 5, "a.og", 0.5, 0.0, True, 6, 700, 80)]
    assert told["room_backgrounds"] == [(0, 0, True, False, 9, 10, 11, True, False, 2, -2, True)]
    assert told["room_views"] == [(0, 0, True, *range(12))]
    assert told["room_layers"] == [(0, 0, "", 2, -50, True)]
    assert told["instances"] == [(0, 900, 4, 10, 20, -1)] and told["instance_fields"] == [(0, 900, 1.5, 2.0, 0.25, 3, 77, 90.0, -50)]
    assert told["room_fields"][0][:4] == (0, "", 255, 3)
    assert told["variable_fields"] == [(0, "BUILTIN", True, "a.og")] and told["code_fields"] == [(0, 2, 3)]
    strings = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "id long, value string")
    asked = spark.createDataFrame([(1, "x"), (9, "z")], "key long, text string")
    assert {r.key: r.value for r in package.string_at(strings, asked, "key").collect()} == {1: "y", 9: "<string_9>"}
    assert {r.text: r.id for r in package.string_id(strings, asked, "text").collect()} == {"x": 0, "z": -1}


def test_actions_and_flags_of_objects():
    got = relations(write())
    assert {(r[0], r[1], r[2], r[3], r[13]) for r in got["event_actions"]} == {(o, t, s, 0, c) for o, t, s, c in ROWS["object_events"]}
    assert got["object_fields"][0] == (0, True, False, 0, False, False)


def test_damaged_packages_end_quietly():
    whole = write()
    for n in range(8, len(whole), 97):
        for _ in decode(whole[:n]):
            pass
