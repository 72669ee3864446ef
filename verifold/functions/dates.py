"""Dates as they stand in documents. The current day is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verifold.functions.text import text

#: Fixed values.
MONTHS = {"janeiro": 1, "fevereiro": 2, "março": 3, "marco": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12}
SEPARATORS = r"[/\-.‐-―− ]"


def parse_date(c: Column | str) -> Column:
    """dd/mm/yyyy or yyyy-mm-dd, blanks around it; an impossible date is null."""
    t = F.trim(text(c))
    return F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(t, "dd/MM/yyyy")).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def normalize_date_string(c: Column | str) -> Column:
    """Four layouts as dd/mm/yyyy, without looking at the calendar; others null."""
    t = F.trim(text(c))
    day_first = F.regexp_replace(t, r"^(\d{2})[/.\-](\d{2})[/.\-](\d{4})$", "$1/$2/$3")
    year_first = F.regexp_replace(t, r"^(\d{4})[/\-](\d{2})[/\-](\d{2})(?:[T ].*)?$", "$3/$2/$1")
    packed = F.regexp_replace(t, r"^(\d{2})(\d{2})(\d{4})$", "$1/$2/$3")
    return (F.when(t.rlike(r"^\d{2}[/.\-]\d{2}[/.\-]\d{4}$"), day_first)
            .when(t.rlike(r"^\d{4}[/\-]\d{2}[/\-]\d{2}(?:[T ].*)?$"), year_first).when(t.rlike(r"^\d{8}$"), packed))


def normalize_flexible_date(c: Column | str) -> Column:
    """First d/m/y of a text as ISO; years below 100 are 20yy; ranges are checked, else null."""
    return flexible_iso(flexible_parts(c))


def flexible_parts(c: Column | str) -> Column:
    """First d/m/y of a text as a struct of numbers; nulls if there is none."""
    rx = rf"(?<!\d)(\d{{1,2}}){SEPARATORS}(\d{{1,2}}){SEPARATORS}(\d{{2,4}})(?!\d)"
    return F.struct(*(F.regexp_extract(text(c), rx, i).try_cast("int").alias(n) for i, n in enumerate(("d", "m", "y"), 1)))


def flexible_iso(parts: Column) -> Column:
    """``normalize_flexible_date`` of ``flexible_parts``."""
    d, m, y = parts["d"], parts["m"], parts["y"]
    year = F.when(y < 100, y + 2000).otherwise(y)
    ok = d.between(1, 31) & m.between(1, 12) & year.between(1900, 2100)
    return F.when(ok, F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))


def month_number(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))[F.lower(name)]


def long_date(c: Column | str) -> Column:
    """'5 de julho de 2024' as ISO; an unknown month gives null, the day is not checked."""
    rx = r"(?iu)(\d{1,2}) de ([a-zç]+) de (\d{4})"
    d, m, y = F.regexp_extract(text(c), rx, 1), month_number(F.regexp_extract(text(c), rx, 2)), F.regexp_extract(text(c), rx, 3)
    return F.when(m.isNotNull(), F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")))


def days_to_expire(expiry: Column, today: Column) -> Column:
    return F.date_diff(expiry, today)


def dates_in(c: Column | str) -> Column:
    """All dd/mm/yyyy of a text as yyyymmdd, in text order."""
    found = F.regexp_extract_all(text(c), F.lit(r"(?<!\d)(\d{2}/\d{2}/\d{4})(?!\d)"), 1)
    return F.transform(found, lambda x: F.concat(F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2)))


def _shown(key: Column) -> Column:
    return F.concat_ws("/", F.substring(key, 7, 2), F.substring(key, 5, 2), F.when(key.isNotNull(), F.substring(key, 1, 4)))


def earliest_date(c: Column | str) -> Column:
    k = F.array_min(dates_in(c))
    return F.when(k.isNotNull(), _shown(k))


def latest_date(c: Column | str) -> Column:
    k = F.array_max(dates_in(c))
    return F.when(k.isNotNull(), _shown(k))


def year_pair(c: Column | str) -> tuple[Column, Column]:
    """The first two distinct years; one year stands for both."""
    years = F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"\b((?:19|20)\d{2})\b"), 1))
    a, b = F.get(years, F.lit(0)).try_cast("int"), F.get(years, F.lit(1)).try_cast("int")
    return a, F.coalesce(b, a)


def window_around(c: Column, rx: str, before: int, after: int) -> Column:
    """The first match of a pattern with so many characters before and after it; null where there is none."""
    at, n = F.regexp_instr(c, F.lit(rx)), F.length(F.regexp_extract(c, rx, 0))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substr(c, start, at + n + after - start))


_YEAR = r"((?:19|20)\d{2})"
#: The words of a label for the years of make and model.
_MADE, _MODEL = r"(?:FAB|FABRICACAO|FABRICA[CÇ]AO)", r"(?:MOD|MODELO)"


def anchored_year_pair(c: Column | str) -> tuple[Column, Column]:
    """Years of make and model in upper-case text without accents: the first of four readings that is there.

    1. A label of both and two years right behind it. 2. The words of a label on one line, not far
    from each other: the first two distinct years from 40 characters before to 80 after them, one for both; if
    there is none, the years stay unknown. 3. Make and model without 'ANO', two years behind. 4. The first two
    distinct years of the whole text.
    """
    t = text(c)
    pair = lambda rx: tuple(F.nullif(F.regexp_extract(t, rx, i), F.lit("")).try_cast("int") for i in (1, 2))
    full = pair(rf"ANO\s*(?:FAB(?:RICACAO)?|FABRICA[CÇ]AO)?\s*/?\s*MODELO\s*[:\-]?\s*{_YEAR}\s*[/\-\s]\s*{_YEAR}")
    window = window_around(t, rf"\bANO\b.{{0,80}}\b{_MADE}\b.{{0,120}}\b{_MODEL}\b", 40, 80)
    short = pair(rf"\b(?:ANO\s*)?{_MADE}\s*(?:/|\s)?\s*{_MODEL}\s*[:\-]?\s*{_YEAR}\s*(?:/|-|\s)\s*{_YEAR}\b")
    near, anywhere = year_pair(window), year_pair(t)
    pick = lambda i: F.when(full[0].isNotNull(), full[i]).when(window.isNotNull(), near[i]).when(short[0].isNotNull(), short[i]).otherwise(anywhere[i])
    return pick(0), pick(1)


def expiry_sanity(expiry: Column, birth: Column, today: Column) -> Column:
    """Names of what is odd: expiry within 30 days, expiry beyond 25 years of 365 days, birth in the future."""
    found = F.array(
        F.when(expiry < F.date_add(today, 30), F.lit("expiry_soon")),
        F.when(expiry > F.date_add(today, 25 * 365), F.lit("expiry_far")),
        F.when(birth > today, F.lit("birth_in_future")),
    )
    return F.filter(found, lambda x: x.isNotNull())


def format_date_parts(d: Column, m: Column, y: Column) -> Column:
    return F.concat_ws("/", F.lpad(d.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0"), y.cast("string"))
