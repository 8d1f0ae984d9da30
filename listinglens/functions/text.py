"""Text clean-up as Column expressions.

JavaScript's ``\\s`` and ``trim`` cover more space characters than Java's, so
the class is spelled out.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_SET = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = f"[{SPACE_SET}]"

# Named entities the portals use. "nbsp" becomes a plain space.
NAMED_ENTITIES = {
    "aacute": "á",
    "eacute": "é",
    "iacute": "í",
    "oacute": "ó",
    "uacute": "ú",
    "yacute": "ý",
    "ccaron": "č",
    "dcaron": "ď",
    "ecaron": "ě",
    "ncaron": "ň",
    "rcaron": "ř",
    "scaron": "š",
    "tcaron": "ť",
    "uring": "ů",
    "zcaron": "ž",
    "Aacute": "Á",
    "Eacute": "É",
    "Iacute": "Í",
    "Oacute": "Ó",
    "Uacute": "Ú",
    "Yacute": "Ý",
    "Ccaron": "Č",
    "Dcaron": "Ď",
    "Ecaron": "Ě",
    "Ncaron": "Ň",
    "Rcaron": "Ř",
    "Scaron": "Š",
    "Tcaron": "Ť",
    "Uring": "Ů",
    "Zcaron": "Ž",
    "nbsp": " ",
    "amp": "&",
    "quot": '"',
    "lt": "<",
    "gt": ">",
    "apos": "'",
}

# Red phrases in order of precedence, and the label of each.
RED_PHRASES = [
    (
        r"zaloh\w* predem|platb\w* predem|kauc\w* predem|penize predem",
        "Asks for a deposit/payment before viewing",
    ),
    (
        r"v zahranici|ze zahranici|do zahranici|zahranicni",
        "Owner / payment abroad",
    ),
    (r"western union|moneygram", "Mentions Western Union / MoneyGram"),
    (
        r"pouze (e-?mail|pres e-?mail)|kontaktujte (me )?pouze",
        "Email-only contact, pushes off-platform",
    ),
    (r"whatsapp", "Pushes contact to WhatsApp"),
    (
        r"bez prohlidky|nelze prohlidnout|nelze prohlednout",
        "Discourages an in-person viewing",
    ),
]


def empty_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def collapse_spaces(value: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(value, SPACE + "+", " "))


def trim_spaces(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def strip_html(html: Column) -> Column:
    """Readable text of an HTML fragment; null when nothing is left."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    text = F.replace(text, F.lit("&nbsp;"), F.lit(" "))
    return empty_to_null(collapse_spaces(text))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _substitute(text: Column, pattern: str, replacement) -> Column:
    """Replace each match of ``pattern`` (one capture group) by ``replacement(group, whole)``.

    Splitting at the matches and zipping the pieces with the replacements makes
    one left-to-right pass, so a replacement is never matched again.
    """

    def swapped(t: Column) -> Column:
        groups = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(2))
        wholes = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
        swaps = F.zip_with(groups, wholes, replacement)
        pieces = F.split(t, pattern, -1)
        woven = F.zip_with(pieces, swaps, lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(woven, "")).otherwise(t)

    return bind(text, swapped)


def _code_point(number: Column, whole: Column) -> Column:
    """Character of a code point; an impossible one keeps its entity text."""
    hexed = F.lpad(F.hex(number), 8, "0")
    valid = number.between(0, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(hexed), "UTF-32")).otherwise(whole)


def _hexadecimal(digits: Column) -> Column:
    return F.conv(F.when(F.length(digits) <= 8, digits), 16, 10).try_cast("long")


def decode_entities(text: Column) -> Column:
    """Hexadecimal, then decimal, then named entities; unknown names stay."""
    # Leading zeros say nothing; more than 8 hexadecimal digits cannot be a code point.
    text = _substitute(
        text,
        "&#x([0-9a-fA-F]+);",
        lambda g, w: _code_point(_hexadecimal(F.regexp_replace(g, "^0+(?=.)", "")), w),
    )
    text = _substitute(
        text,
        "&#([0-9]+);",
        lambda g, w: _code_point(g.try_cast("long"), w),
    )
    names = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])
    return _substitute(
        text,
        "&([a-zA-Z]+);",
        lambda g, w: F.coalesce(F.try_element_at(names, g), w),
    )


def clean_description(text: Column) -> Column:
    """Entities decoded, tags removed, white space collapsed; null when empty."""
    bare = F.regexp_replace(decode_entities(text), "<[^>]+>", " ")
    return empty_to_null(collapse_spaces(bare))


@cache
def _accent_pairs() -> tuple[str, str]:
    """Letters that are a base letter with marks, and those base letters.

    Over all of Unicode, by its decomposition; built once, on the driver.
    """
    source, target = [], []
    for point in range(0x00C0, sys.maxunicode + 1):
        parts = unicodedata.normalize("NFD", chr(point))
        if parts != chr(point) and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            source.append(chr(point))
            target.append(parts[0])
    return "".join(source), "".join(target)


def fold_accents(text: Column) -> Column:
    """Lower-case, diacritics removed (precomposed and combining)."""
    source, target = _accent_pairs()
    folded = F.translate(F.lower(text), source, target)
    return F.regexp_replace(folded, "[\\p{Mn}^`¨¯´·¸]", "")


def red_phrase(description: Column) -> Column:
    """Label of the first red phrase found in ``description``, else null."""

    def first_label(folded: Column) -> Column:
        found = F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern, label in RED_PHRASES:
            found = found.when(folded.rlike(pattern), label)
        return found

    # Folding costs far more than a pattern: once a text, not once a pattern.
    return bind(fold_accents(description), first_label)
