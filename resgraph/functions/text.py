"""References in source text, extracted by regular expressions in one scan of the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that stand for instances at hand, not for resources.
PRONOUNS = ("self", "other", "all", "noone")

#: What each pattern finds; \w is Unicode's.
PATTERNS = {
    "script_call": r"(?U)(scr_\w+)\s*\(",
    "script_execute": r"(?U)script_execute\s*\(\s*(\w+)",
    "method": r"(?U)method\s*\(\s*(\w+)",
    "create": r"(?U)instance_create[_\w]*\s*\([^,]+,[^,]+,\s*(\w+)\s*\)",
    "create_layer": r"(?U)instance_create_layer\s*\([^,]+,[^,]+,[^,]+,\s*(\w+)\s*\)",
    "with": r"(?U)with\s*\(\s*(\w+)",
    "room_goto": r"(?U)room_goto\s*\(\s*(\w+)",
    "play": r"(?U)audio_play_sound\s*\(\s*(\w+)",
    "play_at": r"(?U)audio_play_sound_at\s*\(\s*(\w+)",
    "sound_play": r"(?U)sound_play\s*\(\s*(\w+)",
    "object_index": r"(?U)(\w+)\.object_index\b",
    "sprite_index": r"(?U)sprite_index\s*=\s*(\w+)",
    "mask_index": r"(?U)mask_index\s*=\s*(\w+)",
    "draw_sprite": r"(?U)draw_sprite\s*\(\s*(\w+)",
    "function": r"(?U)(\w+)\s*\(",
    "bare_call": r"(?U)(\w+)\s*\(\s*\)",
    "string": r'"((?:[^"\\]|\\.)*)"',
    "case": r"case\s+(-?\d+)\s*:",
    "plot_write": r"global\.plot\s*=\s*(\d+)",
    "plot_read": r"global\.plot\s*==\s*(\d+)",
    "flag_get": r"scr_flag_get\s*\(\s*(\d+)",
    "flag_set": r"scr_flag_set\s*\(\s*(\d+)\s*,",
    "global_set": r"(?U)global\.(\w+)\s*=",
    "global_get": r"(?U)global\.(\w+)\b(?!\s*=)",
    "dialogue_text": r'scr_Dialogue(?:_String|_Name)?\s*\(\s*"((?:[^"\\]|\\.)*)"',
    "dialogue_id": r"(?U)scr_Dialogue\s*\(\s*(\w+)",
    "message_id": r'(?U)"((?:msg_|str_|txt_|#)\w+)"',
    "show_message": r'show_message\s*\(\s*"((?:[^"\\]|\\.)*)"',
}


def extract(units: DataFrame, *kinds: str, code: str = "code") -> DataFrame:
    """units' other columns with (what, target) for each match of the patterns named (all by default)."""
    chosen = kinds or tuple(PATTERNS)

    def found(kind: str) -> Column:
        matches = F.regexp_extract_all(F.col(code), F.lit(PATTERNS[kind]), F.lit(1))
        return F.transform(matches, lambda target: F.struct(F.lit(kind).alias("what"), target.alias("target")))

    keep = [F.col(c) for c in units.columns if c != code]
    return units.select(*keep, F.explode(F.flatten(F.array(*map(found, chosen)))).alias("m")).select(*keep, "m.what", "m.target")


def flag_accesses(units: DataFrame, code: str = "code") -> DataFrame:
    """units' other columns with (flag, is_write) for each flag access in the text.

    An indexed flag is written where an assignment or increment follows (within 20 characters, as stripped), or where
    what stands before ends in a single equals sign.
    """
    keep = [F.col(c) for c in units.columns if c != code]
    # matches may overlap each other's context, so cut the text at each flag; an access has 14 characters at least, so
    # two parts on either side hold the 20 characters that count
    parts = F.split(F.col(code), r"(?=global\.flag\s*\[\s*\d+\s*\])")

    def at(i: Column) -> Column:
        return F.coalesce(F.get("_parts", i), F.lit(""))

    cut = F.transform("_parts", lambda p, i: F.struct(p.alias("_part"), F.concat(at(i - 2), at(i - 1)).alias("_before"), F.concat(p, at(i + 1), at(i + 2)).alias("_on")))
    rows = units.withColumn("_parts", parts).select(*keep, F.explode(cut).alias("_cut")).select(*keep, "_cut.*")
    rows = rows.where(F.col("_part").rlike(r"^global\.flag\s*\[\s*\d+\s*\]"))
    before = F.regexp_replace(F.right("_before", F.lit(20)), r"^\s+|\s+$", "")
    after = F.regexp_replace(F.substring(F.regexp_replace("_on", r"^global\.flag\s*\[\s*\d+\s*\]", ""), 1, 20), r"^\s+|\s+$", "")
    writes = (after.startswith("=") & ~after.startswith("==")) | after.rlike(r"^(\+=|-=|\*=|/=|\+\+)") | (before.endswith("=") & ~before.endswith("=="))
    index = F.regexp_extract("_part", r"^global\.flag\s*\[\s*(\d+)\s*\]", 1)
    direct = rows.select(*keep, index.alias("target"), writes.alias("is_write"))
    calls = extract(units, "flag_get", "flag_set", code=code).select(*keep, "target", (F.col("what") == "flag_set").alias("is_write"))
    return direct.union(calls).select(*keep, F.col("target").try_cast("long").alias("flag"), "is_write")


def lines(units: DataFrame, code: str = "code") -> DataFrame:
    """units' other columns with (n, line, text): each line of the code, from 1, and without white space around."""
    keep = [F.col(c) for c in units.columns if c != code]
    rows = units.select(*keep, F.posexplode(F.split(F.col(code), "\n")).alias("k", "line"))
    return rows.select(*keep, (F.col("k") + 1).alias("n"), "line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("text"))


def next_line(keys: list[str], shown: Column) -> Column:
    """(n, text) of the first later line of a unit where shown holds."""
    # from the last line back the frame only grows, so each line is looked at once
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(shown, F.struct("n", "text")), ignorenulls=True).over(w)


def level(score: Column) -> Column:
    """The level of a score."""
    return F.when(score >= 100, "CRITICAL").when(score >= 60, "VERY_HIGH").when(score >= 30, "HIGH").when(score >= 10, "MEDIUM").when(score >= 1, "LOW").otherwise("NONE")
