"""Opcodes of the bytecode by number, the groups that operators ask for, and the other numbered kinds of its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

#: Opcode names in order of their numbers, from 0 on.
OPCODES = (
    "NOP", "PUSHENV", "POPENV", "PUSH", "PUSHLOC", "PUSHGLB", "PUSHBLTN", "PUSHI", "PUSHF", "PUSHSTR",
    "DUP", "POP", "POPZ", "CONV", "CALL", "CALLV", "CALLVN", "IF", "GOTO", "SWITCH",
    "CASE", "BREAK", "CONTINUE", "EXIT", "RET", "NOT", "NEG", "ADD", "SUB", "MUL",
    "DIV", "MOD", "AND", "OR", "XOR", "SHL", "SHR", "EQ", "NEQ", "LT",
    "GT", "LTE", "GTE", "ARRAY_PUSH", "ARRAY_POP", "CHKINDEX", "INSTANTIATE", "WITH", "POPEV", "PUSHTAG",
    "POPTG", "PUSHENVVAR", "PUSHENVREF", "ARRAY_GET", "ARRAY_SET", "ARRAY_PUSH_BACK", "ARRAY_POP_BACK", "ARRAY_GET_REF", "ARRAY_SET_REF", "NEW_OBJECT",
    "STRUCT_GET", "STRUCT_SET", "IS_INSTANCE_OF", "IS_NULL", "IS_UNDEFINED", "TYPEOF", "CHKNULL", "THROW", "TRY", "CATCH",
    "ENDTRY", "PUSHLOCREF", "PUSHGLBREF", "PUSHBLTNREF", "ITERATOR", "ITERABLE", "ITER_NEXT", "ITER_END", "PUSH_VARREF", "ARRAY_GET_REF_ID",
    "ARRAY_SET_REF_ID", "STRUCT_GET_REF", "STRUCT_SET_REF", "STRING_SET", "STRING_GET", "ARRAY_GET_OWNER", "CACHE_TARGET_SELF", "CACHE_TARGET_OTHER", "CACHE_TARGET_GLOBAL", "ASSIGN_REG",
    "ASSIGN_VAR", "ASSIGN_ARRAY", "ASSIGN_STRUCT", "MULMAT4", "NEWMAT4", "PUSHV", "UNKNOWN_96", "UNKNOWN_97", "PUSH_LOCAL_ARRAY", "PUSH_GLOBAL_ARRAY",
    "PUSH_BUILTIN_ARRAY", "REF_TO_INSTANCE", "INSTANCE_TO_REF", "IS_VALID_REF", "PUSH_REF", "POP_REF", "ASSIGN_REF", "ARRAY_GET_REF_B", "UNKNOWN_108", "UNKNOWN_109",
)
#: Groups of opcodes.
GROUPS = {
    "is_call": ("CALL", "CALLV", "CALLVN", "NEW_OBJECT"),
    "is_push": ("PUSH", "PUSHLOC", "PUSHGLB", "PUSHBLTN", "PUSHI", "PUSHF", "PUSHSTR", "PUSHV"),
    "is_pop": ("POP", "POPZ", "POPEV", "POPTG"),
    "is_conditional_jump": ("IF",),
    "is_unconditional_jump": ("GOTO",),
    "is_jump": ("IF", "GOTO"),
}
#: Names of the other numbered kinds, in order of their numbers, from 0 on.
KINDS = {
    "variable_type": ("LOCAL", "GLOBAL", "BUILTIN", "INSTANCE", "SELF", "OTHER", "ARGUMENT"),
    "conversion": ("DOUBLE", "FLOAT", "INT32", "INT64", "BOOL", "STRING", "ARRAY", "PTR"),
    "call_kind": ("NORMAL", "BUILTIN", "SCRIPT", "METHOD", "FUNCTION", "ANONYMOUS", "CONSTRUCTOR"),
    "if_kind": ("IF_EQ", "IF_NEQ", "IF_LT", "IF_GT", "IF_LTE", "IF_GTE", "IF_TRUE", "IF_FALSE", "IF_REF", "IF_UNDEFINED"),
    "variable_access": ("READ", "WRITE", "READ_WRITE", "PUSH_ENV", "POP_ENV"),
}


def opcode_name(number: int) -> str:
    return OPCODES[number] if 0 <= number < len(OPCODES) else f"UNKNOWN_{number}"


def in_group(opcode: Column, group: str) -> Column:
    """Whether the opcode's name is of the group, such as is_push."""
    return opcode.isin(*GROUPS[group])


def catalogue(spark: SparkSession) -> DataFrame:
    """(kind, number, name) of opcodes and all other kinds."""
    rows = [(kind, n, name) for kind, names in ({"opcode": OPCODES} | KINDS).items() for n, name in enumerate(names)]
    return spark.createDataFrame(rows, "kind string, number int, name string")
