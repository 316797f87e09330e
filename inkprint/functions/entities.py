"""Decoding of HTML character references as column expressions.

The name table is the standard one that ships with Python (``html.entities``);
it reaches Spark as one constant string, so no table is spelled out here.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkprint.functions.binding import let
from inkprint.functions.patterns import ENTITY

# One string, name and text between marks that no name contains: a constant this size is
# cheaper to plan with than a map. It is searched from its start, so frequent names lead.
_START, _TEXT = "\x01", "\x02"
_FREQUENT = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;"]
_NAMES = dict.fromkeys(_FREQUENT) | dict.fromkeys(sorted(html5, key=lambda n: (len(n), n)))
_NAME_TABLE = "".join(f"{_START}{name}{_TEXT}{html5[name]}" for name in _NAMES) + _START
_LONGEST_TEXT = max(map(len, html5.values()))
# Old names are also read without a semicolon and directly before other letters.
_OLD_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
_OLD_NAME = "^&(" + "|".join(_OLD_NAMES) + ")(.*)$"


def _windows_1252(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


_C1 = json.dumps([_windows_1252(c) for c in range(0x80, 0xA0)])


def _numeric(entity: Column) -> Column:
    """Character for ``&#123;`` or ``&#x7b;``."""
    hex_digits = F.regexp_extract(entity, "^&#[xX]0*([0-9a-fA-F]*)", 1)
    dec_digits = F.regexp_extract(entity, "^&#0*([0-9]*)", 1)
    is_hex = entity.rlike("^&#[xX]")
    digits = F.when(is_hex, hex_digits).otherwise(dec_digits)
    # Eight digits always fit; anything longer lies outside Unicode.
    short = F.when(F.length(digits) == 0, F.lit("0")).when(F.length(digits) <= 8, digits)
    code = F.when(is_hex, F.conv(short, 16, 10)).otherwise(short).cast("long")
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    invalid = (
        code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
        | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    return (
        F.when(code.isNull() | (code == 0) | (code > 0x10FFFF), "�")
        .when(code.between(0xD800, 0xDFFF), "�")
        .when(
            code.between(0x80, 0x9F),
            F.get(F.from_json(F.lit(_C1), "array<string>"), (code - 0x80).cast("int")),
        )
        .when(invalid, "")
        .otherwise(plain)
    )


def _text_of(name: Column) -> Column:
    """Text of a name in the table, null for an unknown one."""
    table = F.lit(_NAME_TABLE)
    at = F.instr(table, F.concat(F.lit(_START), name, F.lit(_TEXT)))
    text = F.substr(table, at + F.length(name) + 2, F.lit(_LONGEST_TEXT))
    return F.when(at > 0, F.substring_index(text, _START, 1))


def _named(entity: Column) -> Column:
    """Text for ``&name;``; an unknown name stays as it is."""
    exact = _text_of(F.substr(entity, F.lit(2)))
    old = F.regexp_extract(entity, _OLD_NAME, 1)
    rest = F.substr(entity, F.length(old) + 2)
    return F.coalesce(exact, F.concat(_text_of(old), rest), entity)


def unescape(text: Column) -> Column:
    """Replace every character reference once, in one pass over the text."""

    def decode(t: Column) -> Column:
        between = F.split(t, ENTITY, -1)
        decoded = F.transform(
            F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)),
            lambda e: F.when(e.startswith("&#"), _numeric(e)).otherwise(_named(e)),
        )
        pieces = F.zip_with(between, decoded, lambda s, e: F.concat(s, F.coalesce(e, F.lit(""))))
        return F.when(t.contains("&"), F.array_join(pieces, "")).otherwise(t)

    return let(text, decode)
