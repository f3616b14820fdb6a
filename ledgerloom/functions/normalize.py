"""Scalar normalisation as Column functions. All stay in the JVM; casts are guarded, so ANSI mode never raises."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that counts as true; any other text that is not blank counts as false. Fixed values.
TRUE_WORDS = ("oui", "true", "1", "o", "y", "yes", "vrai")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ISO = r"^\d{4}-\d{2}-\d{2}$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy")
ENV_PREFIX = r"(?i)^([a-z0-9]+(?:-[a-z0-9]+)*_)"
NOTHING = "∅"
#: The first and the last Hangul syllable.
HANGUL = ("\uac00", "\ud7a3")


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def clean(text: Column) -> Column:
    """Trimmed text; blank text is null."""
    return F.nullif(F.trim(text.cast("string")), F.lit(""))


def clean_number(value: Column) -> Column:
    """NaN is null."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def to_num(text: Column) -> Column:
    """A number, or null. Guarded: '12D' and 'nan' are no numbers here."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def to_str(number: Column) -> Column:
    """A number as text, whole numbers without a point."""
    x = clean_number(number)
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))


def to_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first ten characters as a date in one of the formats, or null."""
    t = F.substring(F.trim(text.cast("string")), 1, 10)
    return F.coalesce(*(F.try_to_date(t, f) for f in formats))


def date_key(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """ISO text of the date; text that is no date stays as it is. Text that is ISO already is only looked at."""
    told = F.coalesce(F.date_format(to_date(text, formats), "yyyy-MM-dd"), clean(text))
    if formats[0] != "yyyy-MM-dd":
        return told
    t = F.substring(F.trim(text.cast("string")), 1, 10)
    return F.when(t.rlike(ISO) & (t >= "0001") & t.try_cast("date").isNotNull(), t).otherwise(told)


def to_bool(value: Column) -> Column:
    t = F.lower(clean(value))
    return F.when(t.isNotNull(), t.isin(*TRUE_WORDS))


def without_marks(text: str) -> str:
    """Compatibility decomposition without combining characters."""
    return "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x))


@dataclass(frozen=True)
class Folding:
    """A rule that turns each character into none, one or several, as tables: ``one`` to ``into`` (the rest of ``one`` goes)
    for translate, and the characters ``several`` with their ``parts``, themselves folded. Hangul syllables are left to
    arithmetic."""

    one: str
    into: str
    several: str
    parts: tuple[str, ...]

    @classmethod
    @lru_cache
    def of(cls, rule: Callable[[str], str]) -> Folding:
        chars = (c for c in map(chr, range(sys.maxunicode + 1)) if not ("\ud800" <= c <= "\udfff" or HANGUL[0] <= c <= HANGUL[1]))
        changed = [(c, r) for c in chars if (r := rule(c)) != c]
        single, gone, longer = ([x for x in changed if test(len(x[1]))] for test in (lambda n: n == 1, lambda n: n == 0, lambda n: n > 1))
        return cls("".join(c for c, _ in single + gone), "".join(r for _, r in single), "".join(c for c, _ in longer), tuple(r for _, r in longer))

    def apply(self, text: Column, hangul: bool) -> Column:
        """``text`` folded. Its characters are taken one by one only where one of them becomes several."""

        def spread(c: Column) -> Column:
            at = F.position(c, F.lit(self.several))
            found = F.coalesce(F.get(F.split(F.lit("\n".join(self.parts)), "\n"), F.when(c != "", at - 1).otherwise(-1)), c)
            return F.when(c < self.several[0], c).when(c.between(*HANGUL), _jamo(c)).otherwise(found) if hangul else F.when(c < self.several[0], c).otherwise(found)

        marked = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _ranges(self.several)) + (f"{HANGUL[0]}-{HANGUL[1]}" if hangul else "") + "]"
        spelled = F.when(text.rlike(marked), F.array_join(F.transform(F.split(text, ""), spread), "")).otherwise(text)
        return F.translate(spelled, self.one, self.into)


def _ranges(chars: str) -> list[tuple[int, int]]:
    """Ascending characters as ranges of code points."""
    out: list[tuple[int, int]] = []
    for c in map(ord, chars):
        if out and out[-1][1] == c - 1:
            out[-1] = out[-1][0], c
        else:
            out.append((c, c))
    return out


def _jamo(c: Column) -> Column:
    """The two or three letters of a Hangul syllable, whose number is (initial * 21 + vowel) * 28 + final."""
    number = F.ascii(c) - ord(HANGUL[0])
    final, vowel = number % 28, F.floor(number / 28) % 21
    letter = lambda first, count, i: F.substr(F.lit("".join(chr(first + k) for k in range(count))), (i + 1).cast("int"), F.lit(1))
    return F.concat(letter(0x1100, 19, F.floor(number / 588)), letter(0x1161, 21, vowel), F.when(final > 0, letter(0x11A8, 27, final - 1)).otherwise(""))


def _ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining characters: letters without their marks, ligatures and the like spelled
    out."""
    return F.when(_ascii(text), text).otherwise(Folding.of(without_marks).apply(text, True))


def fix_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read anew; unchanged where that gives no valid text."""
    narrow = text.rlike(r"^[\x00-\xFF]*$")
    return F.when(narrow, F.coalesce(F.try_validate_utf8(F.encode(F.when(narrow, text), "ISO-8859-1").cast("string")), text)).otherwise(text)


def has_mojibake(text: Column) -> Column:
    return fix_mojibake(text) != text


def split_env_prefix(text: Column, pattern: str = ENV_PREFIX) -> tuple[Column, Column]:
    """(prefix or null, rest)."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.regexp_replace(text, pattern, "")


def same(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Null-safe equality: as numbers if both are numbers, else as trimmed text."""
    x, y = clean(a), clean(b)
    m, n = to_num(x), to_num(y)
    alike = (x == y) & (F.length(x) < 300) & ~F.contains(F.lower(x), F.lit("e"))  # and no number that is too great for a double
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).when(alike, True).when(m.isNotNull() & n.isNotNull(), F.abs(m - n) < tolerance).otherwise(x == y)


def date_eq(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), True).otherwise(date_key(a).eqNullSafe(date_key(b)))


def case_fold(text: Column) -> Column:
    """Full case folding, whatever the neighbours of a letter."""
    return F.when(_ascii(text), F.lower(text)).otherwise(Folding.of(str.casefold).apply(text, False))


def key(value: Column, kind: str = "string") -> Column:
    """Canonical text of a value, by its kind: string, double, boolean or date."""
    if kind == "double":
        return to_str(value)
    if kind == "date":
        return F.date_format(value.cast("date"), "yyyy-MM-dd")
    if kind == "boolean":
        return F.when(value, "yes").when(~value, "no")
    return fix_mojibake(clean(value))


def shown(value: Column, kind: str = "string") -> Column:
    return F.coalesce(clean(value) if kind == "string" else key(value, kind), F.lit(NOTHING))


def shape(text: Column) -> Column:
    """Runs of letters as 'a', runs of digits as '9'."""
    letters = F.regexp_replace(text, r"[\p{L}\p{Nl}\p{No}]+", "a")
    return F.coalesce(F.regexp_replace(letters, r"\p{Nd}+", "9"), F.lit(NOTHING))


def signature(expected: Column, actual: Column) -> Column:
    """'=' for equal values, else the two shapes. One lambda makes both, which keeps the code of a row's method short: the
    JVM only compiles short ones."""
    return F.when(expected.eqNullSafe(actual), "=").otherwise(F.array_join(F.transform(F.array(expected, actual), shape), " → "))


def split_label(text: Column) -> tuple[Column, Column]:
    """(code, label) at the first dash; without a dash (null, text)."""
    dash = F.instr(text, "-")
    return F.when(dash > 0, F.substring_index(text, "-", 1)), F.when(dash > 0, F.substr(text, dash + 1)).otherwise(text)


def padded_equal(a: Column, b: Column) -> Column:
    """Labels equal, codes equal but for leading zeros."""
    (ca, la), (cb, lb) = split_label(a), split_label(b)
    digits = r"^[0-9]{1,38}$"
    number = lambda c: F.when(c.rlike(digits), c).try_cast("decimal(38,0)")
    return F.coalesce(number(ca) == number(cb), F.lit(False)) & la.eqNullSafe(lb)


def first_char(text: Column) -> Column:
    return F.left(text, F.lit(1))


def last_three(text: Column) -> Column:
    return F.right(text, F.lit(3))


def pad_five(text: Column) -> Column:
    """Digits filled up with zeros to five places, never cut; null for other text."""
    return F.when(text.rlike(r"^\d+$"), F.lpad(text, F.greatest(F.length(text), F.lit(5)), F.lit("0")))


def excel_date(serial: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def row_id(*parts: Column) -> Column:
    return F.concat_ws("/", *(F.coalesce(clean(p), F.lit("-")) for p in parts))
