"""The text rules, all in one place.

Three rules live side by side and each operator names the one it uses:

* equality and order of names and titles: ``collated`` (case and accents do not
  count), Spark's own UNICODE_CI_AI collation;
* containment and prefixes: ``fold``, the same rule applied character by
  character, so that plain binary ``contains`` can do the work;
* have / missing / selected: plain string equality, exact bytes.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

COLLATION = "UNICODE_CI_AI"

# What trimming removes, the list separators, the norm() letters.
BLANKS = " \t\n\r\0\x0b"
SEPARATORS = r"[,;|\n]+"
NORM_FROM, NORM_TO = "ıçğöşü", "icgosu"

SPACES = r"\s+"


def _accent_tables() -> tuple[str, str]:
    """Accented small Latin letters with their base letter, from Unicode itself.

    Combining marks come last without a partner, so translate() drops them.
    """
    letters, bases = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base, *marks = unicodedata.normalize("NFD", letter)
        if marks and letter.islower() and base.isascii():
            letters.append(letter)
            bases.append(base)
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(letters + marks), "".join(bases)


ACCENTED, UNACCENTED = _accent_tables()


def collated(column: Column | str) -> Column:
    """Compare and sort without regard to case and accents."""
    return F.collate(_col(column), COLLATION)


def fold(column: Column | str) -> Column:
    """Small letters without accents; ``ı`` stays a letter of its own."""
    return F.translate(F.lower(_col(column)), ACCENTED, UNACCENTED)


def trim_blanks(column: Column | str) -> Column:
    return F.btrim(_col(column), F.lit(BLANKS))


def norm(column: Column | str) -> Column:
    """Trim, lower-case and fold the six Turkish letters (``ı`` becomes ``i``)."""
    return F.translate(F.lower(trim_blanks(column)), NORM_FROM, NORM_TO)


def parse_item_text(column: Column | str) -> Column:
    """Item names of a comma list: normalised, trimmed, distinct, in order."""
    parts = F.transform(F.split(norm(column), SEPARATORS), trim_blanks)
    return F.array_distinct(F.filter(parts, lambda p: p != F.lit("")))


def like_pattern(term: Column | str) -> Column:
    """LIKE pattern that finds ``term`` anywhere, its own % and _ acting as wildcards.

    A backslash before an ordinary character, or at the end, stands for itself.
    """
    inner = F.regexp_replace(_col(term), r"\\([^%_\\])", "$1")
    inner = F.regexp_replace(inner, r"(?<!\\)((?:\\\\)*)\\$", r"$1\\\\")
    return F.concat(F.lit("%"), inner, F.lit("%"))


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
