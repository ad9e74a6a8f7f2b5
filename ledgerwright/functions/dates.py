"""Dates written by people: validity, and parsing to a (first day, last day) pair.

A text is taken apart by shape (one regular expression for numbers, three for month
names) and put together as ISO text, which `try_cast` turns into a date without raising.
That keeps the work in the JVM and costs no exception per layout tried.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerwright import fixed
from ledgerwright.functions.sqltext import apply, let, quoted

_SHORT = "".join(m[:3] for m in fixed.MONTH_NAMES)
_NAME = "(" + "|".join((*fixed.MONTH_NAMES, *(m[:3] for m in fixed.MONTH_NAMES))) + ")"
# Shapes; blanks have been collapsed before.
_NUMBERS = r"^(\d{1,4})([-/.])(\d{1,2})\2(\d{1,4})$"
_MONTH_FIRST = rf"(?i)^{_NAME} (\d{{1,2}})(,?) (\d{{4}}|\d{{2}})$"
_DAY_FIRST = rf"(?i)^(\d{{1,2}})([- ]){_NAME}\2(\d{{4}}|\d{{2}})$"
_MONTH_ONLY = rf"(?i)^{_NAME}([- ])(\d{{4}}|\d{{2}})$"


def _parts(text: str, pattern: str, names: str, body: str) -> str:
    """SQL of `body` over the groups g.<name> of a pattern; null where the shape differs."""
    shape = quoted(pattern)
    groups = ", ".join(f"'{n}', regexp_extract({text}, {shape}, {i + 1})" for i, n in enumerate(names))
    return f"if({text} rlike {shape}, {let('g', f'named_struct({groups})', body)}, NULL)"


def _year(y: str) -> str:
    """Two digits: 69-99 lie in the 1900s, 00-68 in the 2000s."""
    return (
        f"CASE length({y}) WHEN 4 THEN {y} WHEN 2 THEN concat(if({y} >= '69', '19', '20'), {y}) ELSE 'x' END"
    )


def _month(m: str) -> str:
    return f"((instr('{_SHORT}', lower(substring({m}, 1, 3))) + 2) div 3)"


def _date(year: str, month: str, day: str) -> str:
    return f"try_cast(concat_ws('-', {year}, {month}, {day}) AS DATE)"


def _day(t: str) -> str:
    """SQL of a readable single day; a slashed date is read month first, then day first."""
    numbers = _parts(t, _NUMBERS, "asbc", f"""CASE
        WHEN g.s = '.' THEN NULL
        WHEN length(g.a) = 4 THEN if(length(g.c) <= 2, {_date('g.a', 'g.b', 'g.c')}, NULL)
        WHEN length(g.a) <= 2 THEN coalesce({_date(_year('g.c'), 'g.a', 'g.b')},
            if(g.s = '/' AND length(g.c) = 4, {_date('g.c', 'g.b', 'g.a')}, NULL)) END""")
    month_first = _parts(t, _MONTH_FIRST, "mdky", f"""if(
        length(g.y) = 4 OR (g.k = ',' AND length(g.m) = 3),
        {_date(_year('g.y'), _month('g.m'), 'g.d')}, NULL)""")
    day_first = _parts(t, _DAY_FIRST, "dsmy", f"""if(
        if(length(g.m) = 3, g.s = '-' OR length(g.y) = 4, g.s = '-' AND length(g.y) = 4),
        {_date(_year('g.y'), _month('g.m'), 'g.d')}, NULL)""")
    return _by_first(t, f"coalesce({numbers}, {day_first})", month_first)


def _by_first(t: str, digit: str, letter: str) -> str:
    """SQL of `digit` for texts that begin with one of 0-9, else of `letter`: shapes are tried only where they can hold."""
    return f"if({t} >= '0' AND {t} < ':', {digit}, {letter})"


def _first_of_month(t: str) -> str:
    return _by_first(t, "NULL", _parts(t, _MONTH_ONLY, "msy", f"""if(
        g.s = '-' OR length(g.y) = 4, {_date(_year('g.y'), _month('g.m'), "'1'")}, NULL)"""))


def _valid_day(t: str) -> str:
    """SQL of a day in a layout that counts as valid: dots are allowed, a dashed date with a
    long year is day first, and a month alone is no date."""
    numbers = _parts(t, _NUMBERS, "asbc", f"""CASE
        WHEN length(g.a) = 4 THEN if(g.s <> '.' AND length(g.c) <= 2, {_date('g.a', 'g.b', 'g.c')}, NULL)
        WHEN length(g.a) <= 2 THEN coalesce(
            if(g.s = '/' OR (g.s = '-' AND length(g.c) = 2), {_date(_year('g.c'), 'g.a', 'g.b')}, NULL),
            if(g.s <> '.' OR length(g.c) = 4, {_date(_year('g.c'), 'g.b', 'g.a')}, NULL)) END""")
    month_first = _parts(t, _MONTH_FIRST, "mdky", f"""if(
        g.k = ',' AND length(g.y) = 4, {_date('g.y', _month('g.m'), 'g.d')}, NULL)""")
    day_first = _parts(t, _DAY_FIRST, "dsmy", f"""if(
        if(g.s = ' ', length(g.y) = 4, length(g.m) = 3),
        {_date(_year('g.y'), _month('g.m'), 'g.d')}, NULL)""")
    return _by_first(t, f"coalesce({numbers}, {day_first})", month_first)


def is_valid_date(text: Column) -> Column:
    """Does the text, untrimmed, name a real day in one of the layouts that count as valid?"""
    return apply(f"{_valid_day('x')} IS NOT NULL", F.regexp_replace(text, r"\s+", " "))


def _period() -> str:
    cases = " ".join(f"WHEN contains(x, '{s}') THEN '{s}'" for s in fixed.RANGE_SEPARATORS)
    # A text that is no range is one side, read once.
    sides = let("s", f"CASE {cases} END", """if(s IS NULL, array(x), array(
        trim(substring(x, 1, instr(x, s) - 1)), trim(substring(x, instr(x, s) + length(s)))))""")
    month = let("m", f"if(d IS NULL, {_first_of_month('t')}, NULL)",
                "named_struct('start', coalesce(d, m), 'end', coalesce(d, last_day(m)))")
    ends = let("d", _day("t"), month)
    known = "p[0].start IS NOT NULL AND p[size(p) - 1].end IS NOT NULL"
    return let("p", f"transform({sides}, t -> {ends})", f"""named_struct(
        'iso_from', if({known}, CAST(p[0].start AS STRING), NULL),
        'iso_to', if({known}, CAST(p[size(p) - 1].end AS STRING), NULL))""")


def parse_period(text: Column) -> Column:
    """Struct (iso_from, iso_to): a day, a month, or a range of either; nulls if unreadable."""
    return apply(_period(), F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def iso_date(text: Column) -> Column:
    """ISO text as a date; anything else is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
