"""Relations of a package, the vocabulary of the graph, and values that are fixed by the data format."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

#: Node id prefixes by node type.
PREFIX = {
    "object": "obj", "room": "room", "sprite": "spr", "sound": "snd", "code": "code", "function": "func", "variable": "var",
    "string": "str", "script": "script", "timeline": "timeline", "path": "path", "font": "font", "sequence": "seq",
    "background": "bg", "instance": "inst", "flag": "flag", "global_script": "global",
}

#: Names that mark a resource as suspicious; the first that a name contains counts.
SUSPICIOUS_NAMES = (
    "test", "debug", "proto", "wip", "placeholder", "tmp", "temp", "sandbox", "unused", "legacy", "old_", "backup", "deprecated",
    "hidden", "secret", "easteregg", "bonus", "beta", "unimplemented",
)

#: Parts of function names by class; a function may be in several classes.
FUNCTION_CLASSES = {
    "creation": ("instance_create", "instance_change", "layer_instance_create", "instance_create_region", "instance_copy"),
    "execute": ("event_execute_object", "event_user"),
    "asset": ("asset_get_index", "object_get_name"),
    "sound": ("audio_play_sound", "audio_play_sound_at", "audio_stop_sound"),
}

#: Event keywords in code names, with their event type.
EVENT_TYPES = {
    "Create": 0, "Destroy": 1, "Alarm": 2, "Step": 3, "Collision": 4, "Keyboard": 5, "Mouse": 6, "Other": 7, "Draw": 8, "DrawGUI": 9,
    "KeyRelease": 10, "MouseRelease": 11, "KeyPress": 12, "MousePress": 13, "User": 14, "RoomStart": 15, "RoomEnd": 16,
    "AnimationEnd": 17, "AnimationStart": 18, "Cleanup": 19, "StepBegin": 20, "StepMiddle": 21, "StepEnd": 22, "PreDraw": 23,
    "DrawBegin": 24, "DrawEnd": 25, "DrawGUIBegin": 26, "DrawGUIEnd": 27, "GameStart": 28, "GameEnd": 29, "PreCreate": 30,
}

#: Names of event types in order of their numbers, from 0 on.
EVENT_NAMES = (
    "Create", "Destroy", "Alarm", "Step", "Collision", "Keyboard", "Mouse", "Other", "Draw", "Draw GUI", "Key Release", "Mouse Release", "Key Press",
    "Mouse Press", "User", "Room Start", "Room End", "Animation End", "Animation Start", "Cleanup", "Step Begin", "Step Middle", "Step End", "Pre Draw",
    "Draw Begin", "Draw End", "Draw GUI Begin", "Draw GUI End", "Game Start", "Game End",
)

#: Opcodes that call.
CALLS = ("CALL", "CALLV", "CALLVN", "NEW_OBJECT")
#: Opcodes that a backward look for an argument passes over.
PASSED_OVER = ("PUSHENV", "POPENV", "PUSHBLTN")
#: Owner types of code, by the form of its name.
OWNER_SCRIPT, OWNER_EVENT, OWNER_ROOM, OWNER_GLOBAL, OWNER_SEQUENCE, OWNER_TIMELINE, OWNER_UNKNOWN = 0, 1, 2, 3, 4, 5, -1


@dataclass
class Game:
    """The relations of one package; -1 stands for no id."""

    objects: DataFrame  # id, name, sprite_index, mask_index, parent_index
    object_events: DataFrame  # object_id, event_type, subtype, code_id
    rooms: DataFrame  # id, name, width, height, speed, persistent, creation_code_id
    instances: DataFrame  # room_id, instance_id, object_id, x, y, creation_code_id
    sprites: DataFrame  # id, name
    sounds: DataFrame  # id, name
    strings: DataFrame  # id, value
    functions: DataFrame  # id, name, code_offset
    variables: DataFrame  # id, name
    code: DataFrame  # id, name, offset, length
    instructions: DataFrame  # code_id, pos, opcode, value_int, value_str, value_str_id, value_func_id, value_variable_id, arg_count

    def relations(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


#: Columns of each relation, as Spark DDL.
DDL = {
    "objects": "id long, name string, sprite_index long, mask_index long, parent_index long",
    "object_events": "object_id long, event_type int, subtype int, code_id long",
    "rooms": "id long, name string, width int, height int, speed int, persistent boolean, creation_code_id long",
    "instances": "room_id long, instance_id long, object_id long, x int, y int, creation_code_id long",
    "sprites": "id long, name string",
    "sounds": "id long, name string",
    "strings": "id long, value string",
    "functions": "id long, name string, code_offset long",
    "variables": "id long, name string",
    "code": "id long, name string, offset long, length long",
    "instructions": "code_id long, pos long, opcode string, value_int long, value_str string, value_str_id long, value_func_id long, value_variable_id long, arg_count int",
}

#: Columns of the relations that a package tells beside those of a Game, as Spark DDL.
DETAIL_DDL = {
    "object_fields": "id long, visible boolean, solid boolean, depth int, persistent boolean, physics boolean",
    "event_actions": "object_id long, event_type int, subtype int, nth int, lib_id int, action_id int, action_kind int, use_relative boolean, is_question boolean, use_apply_to boolean, exe_type int, action_name int, args_count int, code_id long, who int, relative boolean, is_not boolean",
    "sprite_fields": "id long, width int, height int, margin_left int, margin_right int, margin_top int, margin_bottom int, bbox_left int, bbox_right int, bbox_top int, bbox_bottom int, transparent boolean, smooth boolean, preload boolean, frame_count int, texture_group int, origin_x int, origin_y int",
    "sprite_frames": "sprite_id long, nth int, texture_page int, texture_x int, texture_y int, texture_w int, texture_h int, offset_x int, offset_y int, source_x int, source_y int, source_w int, source_h int",
    "sound_fields": "id long, sound_type int, file string, volume double, pitch double, preload boolean, audio_group int, data_offset int, data_size int",
    "room_fields": "id long, caption string, colour long, flags long, physics_top long, physics_left long, physics_right long, physics_bottom long, gravity_x double, gravity_y double, meters_per_pixel double",
    "room_backgrounds": "room_id long, nth int, enabled boolean, foreground boolean, background_id int, x int, y int, tile_x boolean, tile_y boolean, hspeed int, vspeed int, stretch boolean",
    "room_views": "room_id long, nth int, enabled boolean, x int, y int, width int, height int, port_x int, port_y int, port_w int, port_h int, border_x int, border_y int, speed int, follow_object_id int",
    "room_layers": "room_id long, nth int, name string, layer_type long, depth int, visible boolean",
    "instance_fields": "room_id long, instance_id long, scale_x double, scale_y double, image_speed double, image_index int, colour long, rotation double, layer_depth int",
    "code_fields": "id long, locals int, arguments int",
    "variable_fields": "id long, variable_kind string, is_array boolean, init_value string",
}
