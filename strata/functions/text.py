"""Text normalisation as built-in column expressions (no Python at run time).

Spark has no Unicode normalisation function, so the accent map is built once on
the driver from ``unicodedata`` over the Latin ranges and applied by
``translate``, which stays inside code generation.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space in the widest sense, controls and invisible format characters
BLANK_CLASS = r"[\s\p{Z}\p{Cc}\p{Cf}⠀ㅤᅟᅠ]"
_VISIBLE = "[^" + BLANK_CLASS[1:]
#: the separators that SQL's trim takes off (category Zs)
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_FOLD_RANGES = ((0x00C0, 0x0250), (0x1E00, 0x1F00), (0xFF01, 0xFF5F))
#: letters without a decomposition that are one letter in plain ASCII
_FOLD_EXTRA = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ħ": "h", "ı": "i", "ŧ": "t"}


@cache
def fold_map() -> tuple[str, str]:
    src, dst = [], []
    for lo, hi in _FOLD_RANGES:
        for cp in range(lo, hi):
            ch = chr(cp)
            base = _FOLD_EXTRA.get(ch) or "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
            if base != ch and len(base) == 1 and base.isascii():
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


def fold(c: Column) -> Column:
    """Lower case without accents; a null stays null."""
    src, dst = fold_map()
    low = F.lower(F.translate(c, src, dst))
    low = F.replace(F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return F.regexp_replace(low, r"\p{M}+", "")


def fold_py(s: str) -> str:
    """The same as :func:`fold`, for code that already runs in Python."""
    low = s.translate(_fold_table()).lower().replace("ß", "ss").replace("æ", "ae").replace("œ", "oe")
    return low if low.isascii() else "".join(c for c in low if unicodedata.category(c)[0] != "M")


@cache
def _fold_table() -> dict[int, str]:
    return str.maketrans(*fold_map())


def trim_all(c: Column) -> Column:
    """Without blank characters at both ends."""
    return F.regexp_replace(c, f"^{BLANK_CLASS}+|{BLANK_CLASS}+$", "")


def squeeze(c: Column) -> Column:
    """Lower-level helper: runs of blanks become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def spaced_key(c: Column) -> Column:
    """SQL's ``lower(trim(regexp_replace(c, '\\s+', ' ', 'g')))``: runs of ASCII white space (no vertical tab) become one
    space, spaces of every kind go at both ends, and each letter is lowered by itself (no final sigma, a dotted I is i)."""
    one = F.trim(F.regexp_replace(c, r"[\t\n\f\r ]+", " "), F.lit(SPACES))
    return F.lower(F.translate(one, "\u0130\u03a3", "i\u03c3"))


def visible(c: Column) -> Column:
    """True if the text has a visible character; false for null."""
    return F.coalesce(c.rlike(_VISIBLE), F.lit(False))


def words_key(c: Column) -> Column:
    """Folded, punctuation as space, one space between words."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def loose_key(c: Column) -> Column:
    """Equal for texts that differ in case, accents, spacing, punctuation or a leading article."""
    return F.replace(F.regexp_replace(words_key(c), r"^(?:a|an|the)\s+(?=\S)", ""), F.lit(" "), F.lit(""))
