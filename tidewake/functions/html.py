"""Text of HTML as column expressions: what a page shows, without a parser and without Python.

Comments, scripts, styles and the head go first, each in one match, so that nothing in them reads as a tag. Elements that
break a line leave one, list items a mark, other tags a seam, across which no character reference is read. References are
looked up last, in the table of HTML 5 that Python's library has. All repeated groups are possessive: Java matches those
in a loop, so that a tag of a hundred thousand attributes costs no stack.

Against ``text.rendered``, which parses: a head within a head ends with the first end tag here, line breaks within a head
are not kept (where texts are tidied, neither shows), and a comment that never ends hides the rest.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewake.functions.text import BREAKS, ITEM_MARK, blank_as_empty, stripped

#: Stand where a tag was, and after the end of an element that is closed at once; code points that are no characters.
SEAM, CLOSED = "\ufdd0", "\ufdd1"
# What follows a tag's name up to its end: a ">" within quotes after "=" doesn't end it.
_REST = r"(?=[\s/>])(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
UNSEEN = rf"(?is)<!--.*?(?:--\s*+>|\z)|<(script|style){_REST}(?<!/)>.*?(?:</\1\s*+>|\z)"
HEAD = rf"(?is)<head{_REST}>.*?(?:</head\s*+>|\z)"
ITEM = rf"(?i)<li{_REST}>({CLOSED}?)"
BREAK = rf"(?i)</?(?:{'|'.join(sorted(BREAKS))}){_REST}>({CLOSED}?)"
TAG = r"<[A-Za-z](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>|</[A-Za-z][^>]*+>|<[!?/][^>]*+>"
REFERENCE = rf"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;{SEAM}]{{1,32}};?)"
WRONG = "\ufffd"


def _windows() -> dict[str, str]:
    """Numbers that pages take from an old code page: those of 128 to 159 that it has."""
    found = {}
    for k in range(128, 160):
        try:
            found[str(k)] = bytes([k]).decode("cp1252")
        except UnicodeDecodeError:
            found[str(k)] = chr(k)
    return found


def _map(pairs: dict[str, str]) -> Column:
    """A map as one literal, which Spark reads once."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string, string>")


def _numbered(n: Column) -> Column:
    """The character of a number, or what stands for one that has none."""
    old = F.element_at(_map(_windows()), n.cast("string"))
    no_character = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    wrong = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(wrong, F.lit(WRONG)).when(n.between(128, 159), old).when(no_character, F.lit("")).otherwise(plain)


def _named(ref: Column) -> Column:
    """The characters of a name; of one that has none, those of the longest name that it begins with and that needs no
    semicolon, and its rest."""
    known = F.element_at(_map(html5), ref)
    open_names = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    begun = F.get(F.filter(F.from_json(F.lit(json.dumps(open_names)), "array<string>"), lambda k: F.startswith(ref, k)), F.lit(0))
    rest = F.concat(F.element_at(_map({k: html5[k] for k in open_names}), begun), F.substring(ref, F.length(begun) + 1, F.length(ref)))
    return F.coalesce(known, rest, F.concat(F.lit("&"), ref))


def _number(ref: Column) -> Column:
    digits = F.regexp_replace(ref, r"^#[xX]?|;$", "")
    hexadecimal = F.rlike(ref, F.lit("^#[xX]"))
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(short) > 10, F.lit(1 << 40)).when(hexadecimal, F.conv(short, 16, 10).cast("long")).otherwise(short.cast("long"))


def unescaped(c: Column) -> Column:
    """Character references as the characters that they stand for."""

    def one(part: Column) -> Column:
        def with_reference(ref: Column) -> Column:
            rest = F.substring(part, F.length(ref) + 1, F.length(part))
            known = F.when(ref == "", F.lit("&")).when(F.startswith(ref, F.lit("#")), _numbered(_number(ref))).otherwise(_named(ref))
            return F.concat(known, rest)

        return F.get(F.transform(F.array(F.regexp_extract(part, REFERENCE, 1)), with_reference), F.lit(0))

    def joined(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))

    found = F.get(F.transform(F.array(F.split(c, "&", -1)), joined), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), found).otherwise(c)


def text_of(html: Column) -> Column:
    """The text that a page shows, not tidied; empty for null."""
    seen = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, SEAM), HEAD, SEAM)
    # After the last ">" there is no tag: it isn't looked for again from each "<" there.
    rest = F.substring_index(seen, ">", -1)
    t = F.replace(F.left(seen, F.length(seen) - F.length(rest)), F.lit("/>"), F.lit(f"/>{CLOSED}"))
    t = F.regexp_replace(F.regexp_replace(t, ITEM, f"{ITEM_MARK}\n$1"), BREAK, "\n$1")
    t = F.replace(F.regexp_replace(t, TAG, SEAM), F.lit(f"\n{CLOSED}"), F.lit("\n\n"))
    return F.translate(unescaped(F.concat(F.replace(t, F.lit(CLOSED), F.lit("")), rest)), SEAM, "")


def chosen_body(text: Column, html: Column) -> Column:
    """The plain text unless it is blank, else what the page shows."""
    return F.when(stripped(blank_as_empty(text)) != "", text).otherwise(text_of(html))
