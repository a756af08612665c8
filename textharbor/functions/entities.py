"""HTML5 character references decoded by column expressions alone.

A text is cut at its ampersands; what follows one is a reference if it starts like one. A numeric reference is a code
point, with the replacements that HTML5 prescribes. A named one is looked up in a literal map of all HTML5 names: in full,
or else its longest beginning that may stand without a semicolon. Everything runs in the JVM.
"""

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import functions as F

# The pattern of a reference without its ampersand, and what HTML5 makes of some code points:
# Windows-1252 for 128 to 159 (those without a character there stay), nothing for controls and non-characters.
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
WINDOWS_1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "#39;")


def _names(short):
    """All names, or those that need no semicolon, as a literal map."""
    chosen = {name: char for name, char in html5.items() if not short or not name.endswith(";")}
    return F.from_json(F.lit(json.dumps(chosen)), "map<string,string>")  # folded to a literal by the optimiser


def _longest_short_name():
    return max(len(name) for name in html5 if not name.endswith(";"))


def _character(code):
    """The character of a code point."""
    beyond = code - 0x10000
    pair = F.shiftleft(F.shiftright(beyond, 10) + 0xD800, 16).bitwiseOR(F.pmod(beyond, F.lit(0x400)) + 0xDC00)
    units = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.substring(F.hex(pair), -8, 8))
    return F.decode(F.unhex(units), "UTF-16BE")


def _numeric(reference):
    """What a numeric reference (without ampersand) stands for."""
    is_hex = F.substring(reference, 2, 1).isin("x", "X")
    digits = F.rtrim(F.regexp_replace(reference, r"^#[xX]?0*|;$", ""))
    base16 = F.when(F.length(digits) <= 7, F.conv(digits, 16, 10).cast("int"))
    base10 = F.when(F.length(digits) <= 7, digits.cast("int"))
    number = F.when(digits == "", 0).otherwise(F.coalesce(F.when(is_hex, base16).otherwise(base10), F.lit(0x110000)))

    def of(n):
        windows = F.substring(F.lit(WINDOWS_1252), n - 127, 1)
        control = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF)
        missing = control | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE)
        return (
            F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("�"))
            .when(n == 13, F.lit("\r"))
            .when(n.between(128, 159), windows)
            .when(missing, F.lit(""))
            .otherwise(_character(n))
        )

    return _bound(number, of)


def _named(reference):
    """What a named reference (without ampersand) stands for; NULL if it is none."""
    whole = F.try_element_at(_names(False), reference)
    shorter = []
    for length in range(_longest_short_name(), 1, -1):
        found = F.try_element_at(_names(True), F.substring(reference, 1, length))
        rest = F.substring(reference, length + 1, 64)
        shorter.append(F.when(F.length(reference) > length, F.concat(found, rest)))
    return F.coalesce(whole, *shorter)


def _bound(value, function):
    """``function`` of a column that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), function), 0)


def _decoded(piece):
    """A piece of text that follows an ampersand."""

    def with_reference(reference):
        common = reduce(
            lambda when, name: when.when(reference == name, F.lit(html5.get(name, "'"))),
            COMMON[1:],
            F.when(reference == COMMON[0], F.lit(html5[COMMON[0]])),
        )
        char = common.when(F.startswith(reference, F.lit("#")), _numeric(reference)).when(reference != "", _named(reference))
        return F.coalesce(F.concat(char, F.substr(piece, F.length(reference) + 1)), F.concat(F.lit("&"), piece))

    return _bound(F.regexp_extract(piece, REFERENCE, 1), with_reference)


def decode_entities_native(text):
    """HTML5 entities to characters, as :func:`textharbor.cleaning.decode_entities` does in Python."""

    def joined(pieces):
        decoded = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), _decoded)
        return F.concat(F.get(pieces, 0), F.array_join(decoded, ""))

    return F.when(F.contains(text, F.lit("&")), _bound(F.split(text, "&"), joined)).otherwise(text)
