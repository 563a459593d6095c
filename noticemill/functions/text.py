"""Accent folding and the identity normalisers, as column expressions.

Spark has no compatibility decomposition, so the folding tables are generated
from the Unicode database by rule.  ASCII strings skip the
tables; western European ones use a short table; other strings whose characters
all fold one-to-one use the long one; only strings with a one-to-many character
(ß, ﬁ, ½ ...) take the per-character path.  All branches are JVM expressions, and CASE evaluates only the taken one.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticemill import vocab

_NON_ASCII = r"[^\x00-\x7f]"


def _without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@lru_cache(maxsize=None)
def _foldable() -> tuple[str, ...]:
    """Code points that decompose, combine or have a folded case."""
    found = []
    for cp in range(0x80, 0x110000):
        # Hangul syllables decompose into letters that no normaliser keeps.
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        char = chr(cp)
        if unicodedata.decomposition(char) or unicodedata.combining(char) or char.casefold() != char:
            found.append(char)
    return tuple(found)


@lru_cache(maxsize=None)
def _tables(casefold: bool, to_ascii_only: bool):
    """(single from, single to, removed, multi) for the requested folding."""
    source, target, removed, multi = [], [], [], {}
    for char in _foldable():
        folded = _without_marks(char)
        if casefold:
            folded = folded.casefold()
        if folded == char:
            continue
        if to_ascii_only and folded and not any(ord(c) < 128 for c in folded):
            continue
        if not folded:
            removed.append(char)
        elif len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            multi[char] = folded
    return "".join(source) + "".join(removed), "".join(target), multi


@lru_cache(maxsize=None)
def _latin_tables(casefold: bool, to_ascii_only: bool) -> tuple[str, str, str]:
    """The part of the tables western European text needs: (from, to, class of
    everything else)."""
    source, target, multi = _tables(casefold, to_ascii_only)
    pairs = [(s, t) for s, t in zip(source, target) if s < "\u0100"]
    others = "".join(f"\\x{{{cp:x}}}" for cp in range(0x80, 0x100) if chr(cp) in multi)
    return "".join(s for s, _ in pairs), "".join(t for _, t in pairs), f"[^\\x00-\\xff]|[{others}]"


@lru_cache(maxsize=None)
def _multi_class(casefold: bool, to_ascii_only: bool) -> str:
    """Character class of the one-to-many code points, as \\x{...} ranges."""
    points = sorted(ord(c) for c in _tables(casefold, to_ascii_only)[2])
    ranges, start, prev = [], points[0], points[0]
    for point in points[1:] + [None]:
        if point is not None and point == prev + 1:
            prev = point
            continue
        ranges.append(f"\\x{{{start:x}}}-\\x{{{prev:x}}}")
        start = prev = point
    return "[" + "".join(ranges) + "]"


def _fold(col: Column, casefold: bool, to_ascii_only: bool) -> Column:
    source, target, multi = _tables(casefold, to_ascii_only)
    one_to_one = F.translate(col, source, target)
    # The many-character path is a rare branch, so its table travels as one
    # short literal string that is turned into a map when the branch runs.
    pairs = "\n".join(f"{char}\t{folded}" for char, folded in multi.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\n"), F.lit("\t"))
    expanded = F.array_join(
        F.transform(F.split(col, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""
    )
    latin_source, latin_target, beyond_latin = _latin_tables(casefold, to_ascii_only)
    return (
        F.when(~col.rlike(_NON_ASCII), col)
        .when(~col.rlike(beyond_latin), F.translate(col, latin_source, latin_target))
        .when(~col.rlike(_multi_class(casefold, to_ascii_only)), one_to_one)
        .otherwise(F.translate(expanded, source, target))
    )


def strip_accents(col: Column) -> Column:
    """Compatibility decomposition with the combining marks dropped."""
    return _fold(col, casefold=False, to_ascii_only=False)


def fold_ascii(col: Column) -> Column:
    """Accent-free, case-folded text; only what can become ASCII is folded."""
    return F.lower(_fold(col, casefold=True, to_ascii_only=True))


def fold_latin(col: Column) -> Column:
    """Lower-case text without the accents of western European letters."""
    letters = [chr(cp) for cp in range(0xC0, 0x100) if len(_without_marks(chr(cp))) == 1]
    return caseless(F.translate(col, "".join(letters), "".join(_without_marks(c) for c in letters)))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _words(folded: Column) -> Column:
    return blank_to_null(F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " ")))


def normalize_text(col: Column) -> Column:
    return _words(fold_ascii(col))


def normalize_issuer(col: Column) -> Column:
    folded = fold_ascii(col)
    folded = F.regexp_replace(folded, r"(?U)\bs\s*\.\s*a\s*\.?", " sa ")
    folded = F.regexp_replace(folded, r"(?U)\bltda\s*\.?", " ltda ")
    return _words(folded)


def normalize_cnpj(col: Column) -> Column:
    return blank_to_null(F.regexp_replace(col, r"(?U)\D", ""))


def normalize_code(col: Column) -> Column:
    """ISIN and ticker form: ASCII letters and digits, upper case."""
    return blank_to_null(F.upper(F.regexp_replace(col, "[^A-Za-z0-9]", "")))


def normalize_share_class(col: Column) -> Column:
    folded = normalize_text(col)
    aliases = F.create_map(*[F.lit(x) for pair in vocab.SHARE_CLASS_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, folded), F.upper(F.replace(folded, F.lit(" "), F.lit("_"))))


# golden identifier -> normaliser
IDENTIFIER_NORMALIZERS = {
    "issuer": normalize_issuer,
    "cnpj": normalize_cnpj,
    "isin": normalize_code,
    "ticker": normalize_code,
    "share_class": normalize_share_class,
}


# Every whitespace character, by the Unicode database.
SPACES = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())


def strip(col: Column) -> Column:
    """Trim every Unicode whitespace character, not only spaces."""
    return F.btrim(col, F.lit(SPACES))


def without_spaces(col: Column) -> Column:
    return F.translate(col, SPACES, "")


def caseless(col: Column) -> Column:
    """Lower case in which a case-insensitive literal can be looked up with
    ``contains``; i, s and k have extra case partners outside ASCII."""
    partners = "İıſ"
    # A translation looks every character up, a search for each of three compares bytes.
    return F.lower(F.when(reduce(or_, [col.contains(c) for c in partners]), F.translate(col, partners, "iis")).otherwise(col))


def search(col: Column, pattern: str, group: int = 0) -> Column:
    """First match, null (not the empty string) when there is none."""
    return blank_to_null(F.regexp_extract(col, pattern, group))


def safe_file_name(col: Column) -> Column:
    """ASCII file name with a sanitised stem of at most 100 characters."""
    ascii_name = F.regexp_replace(_fold(col, casefold=False, to_ascii_only=True), _NON_ASCII, "")
    base = F.substring_index(F.rtrim(ascii_name, F.lit("/")), "/", -1)
    stem = F.regexp_replace(base, r"(?s)(?<=.)\.[^.]+\z", "")
    stem = F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_")
    stem = F.coalesce(blank_to_null(F.btrim(stem, F.lit("._-"))), F.lit("document"))
    return F.concat(F.substring(stem, 1, 100), F.lit(".pdf"))
