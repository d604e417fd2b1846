"""Text helpers: white space, terminal escapes, names of columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"\p{IsWhite_Space}"
#: The characters of Unicode's White_Space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Those of them that are spaces (Zs), which SQL's trim takes.
SPACES = "".join(c for c in WHITE if unicodedata.category(c) == "Zs")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body names it:
    inside a lambda, a plain expression is computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Without Unicode white space at its ends."""
    return F.btrim(text, F.lit(WHITE))


def is_blank(text: Column, white: str = WHITE) -> Column:
    return F.ltrim(text, F.lit(white)) == ""


def without_escapes(text: Column) -> Column:
    """Without ANSI sequences: CSI, OSC (ended by BEL or ESC \\) and others; none
    runs over a line's end, and an unended one stays."""
    csi = r"\x1B\[[0-?]*[ -/]*[@-~]"
    osc = r"\x1B\][^\x07\x1B\r\n]*(?:\x07|\x1B\\)"
    other = r"\x1B[ -/]*[0-OQ-WYZ\\`-~]"
    return F.regexp_replace(text, f"{csi}|{osc}|{other}", "")


def cells_of(text: Column, most: int = -1) -> Column:
    """Cells between runs of white space; the last of ``most`` takes the rest."""
    return F.split(trimmed(text), f"{BLANK}+", most)


def literal(text: str) -> str:
    """A pattern that matches ``text`` itself."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def normal_name(heading: str) -> str:
    """The key of a heading: lower case, other characters as ``_``, ``%`` spelled out."""
    spelled = heading.lower().replace("%", "_percent")
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", spelled)).strip("_")


def normal_names(heading: Column) -> Column:
    """``normal_name`` for a column."""
    spelled = F.replace(F.lower(heading), F.lit("%"), F.lit("_percent"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(spelled, "[^0-9a-z]+", "_"), "_+", "_"), r"\A_|_\z", "")


def unescaped(text: Column, sequences: dict[str, str], *, octal: bool = False, quote: str = "") -> Column:
    """``text`` with the escapes that a format writes undone; null where the
    escape character begins none of them, or the bytes aren't UTF-8.

    ``sequences`` maps each escape to what it stands for, the longest first; all
    begin with one character. With ``octal`` that character and three octal
    digits are a byte. With ``quote`` only a value between two of these is
    undone, and it loses them. The bytes are put together as hexadecimal digits,
    so that a character may be written in several escapes.
    """
    (mark,) = {k[0] for k in sequences}
    e = literal(mark)
    known = sorted(sequences, key=len, reverse=True)
    token = "|".join([*map(literal, known), *([f"{e}[0-3][0-7]{{2}}"] if octal else []), e, f"[^{re.escape(mark)}]+"])
    names = F.create_map(*[F.lit(x) for k in known for x in (k, sequences[k].encode().hex())])

    def bytes_of(t: Column) -> Column:
        if octal:
            as_byte = F.when(F.length(t) == 4, F.lpad(F.conv(F.substring(t, 2, 3), 8, 16), 2, "0"))
            escape = F.coalesce(F.try_element_at(names, t), as_byte)
        else:
            escape = F.try_element_at(names, t)
        return F.when(F.startswith(t, F.lit(mark)), escape).otherwise(F.hex(t))

    def undone(t: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(t, F.lit(f"(?s)({token})"), F.lit(1)), bytes_of)
        whole = F.when(~F.exists(parts, lambda v: v.isNull()), F.unhex(F.array_join(parts, "")).cast("string"))
        return F.when(~F.contains(t, F.lit(mark)), t).when(F.is_valid_utf8(whole), whole)

    if not quote:
        return let(text, undone)
    n = len(quote)
    quoted = (F.length(text) >= 2 * n) & F.startswith(text, F.lit(quote)) & F.endswith(text, F.lit(quote))
    return F.when(quoted, let(F.substring(text, F.lit(n + 1), F.length(text) - 2 * n), undone)).otherwise(text)
