"""Slugs: the address part of a title."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import either

WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
UNSAFE = "".join(c for c in map(chr, range(128)) if not (c.isalnum() or c in " _.-"))


@cache
def _ascii_forms() -> dict[str, str]:
    """Every foreign character whose compatible decomposition (NFKD) holds ASCII, with that ASCII.

    Decomposition works character by character, and the reordering of marks that follows it moves no ASCII character.  So the
    ASCII of a text's decomposition is that of its characters, one after the other.
    """
    forms = {}
    for code in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= code <= 0xDFFF and unicodedata.decomposition(char := chr(code)):
            if form := unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode():
                forms[char] = form
    return forms


def _class_of(chars: list[str], gap: int = 1) -> str:
    """A regular expression for any of some foreign characters; those at most ``gap`` apart are joined to ranges.

    The test for ASCII goes first: a character is held against all ranges only if it is foreign.
    """
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and code <= ranges[-1][1] + gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return r"(?=[^\x00-\x7F])[" + "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last in ranges) + "]"


def _translated(value: Column, forms: dict[str, str], place: int) -> Column:
    """Each of the characters becomes the letter on one place of its form; those with shorter forms go."""
    order = sorted(forms, key=lambda char: len(forms[char]), reverse=True)
    return F.translate(value, "".join(order), "".join(forms[c][place] for c in order if len(forms[c]) > place))


def plain_ascii(value: Column) -> Column:
    """Letters without accents; what has no ASCII form is dropped.

    Column expressions only.  Characters with one ASCII letter are translated in the whole text; the few with more (ligatures,
    fractions, units) are spelled out one by one, in texts that hold any.
    """
    forms = _ascii_forms()
    single = {char: form for char, form in forms.items() if len(form) == 1}
    several = {char: form for char, form in forms.items() if len(form) > 1}
    places = range(max(map(len, several.values())))

    def spelled(char: Column) -> Column:
        return F.when(char <= "\x7f", char).when(char.rlike(_class_of(list(several))), F.concat(
            *[_translated(char, several, place) for place in places]
        )).otherwise(char)

    whole = F.when(
        value.rlike(_class_of(list(several), 16)), F.array_join(F.transform(F.split(value, ""), spelled), "")
    ).otherwise(value)
    ascii_only = F.regexp_replace(_translated(whole, single, 0), r"[^\x00-\x7F]", "")
    return F.when(value.rlike(r"[^\x00-\x7F]"), ascii_only).otherwise(value)


def safe_name(value: Column) -> Column:
    """A name safe in a path: words joined by '_', only ``A-Z a-z 0-9 _ . -``."""
    spaced = F.translate(plain_ascii(value), "/" + WHITE, " " * (1 + len(WHITE)))
    words = F.trim(F.regexp_replace(spaced, " {2,}", " "))
    return F.btrim(F.translate(words, " " + UNSAFE, "_"), F.lit("._"))


def slug_of(title: Column, given: Column | None = None) -> Column:
    """The given slug, or one made from the title, in safe lower-case form."""
    made = F.replace(F.lower(title), F.lit(" "), F.lit("-"))
    return F.lower(safe_name(made if given is None else either(given, made)))
