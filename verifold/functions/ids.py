"""Check digits and shapes of identifiers: CPF, CNPJ, RENAVAM, plates, chassis numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verifold.functions.text import compact_alnum, only_digits


def _weighted(digits: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total += F.substring(digits, i, 1).try_cast("int") * w
    return total


def _mod11(digits: Column, weights: list[int]) -> Column:
    """11 minus the remainder; 10 and 11 become 0."""
    r = _weighted(digits, weights) % 11
    return F.when(r < 2, F.lit(0)).otherwise(11 - r)


def cpf_check_reason(c: Column | str) -> Column:
    """ok, empty, bad_length, all_equal or dv_mismatch."""
    d = only_digits(c)
    first, second = _mod11(d, list(range(10, 1, -1))), _mod11(d, list(range(11, 1, -1)))
    good = (F.substring(d, 10, 1) == first.cast("string")) & (F.substring(d, 11, 1) == second.cast("string"))
    return (F.when(d == "", F.lit("empty")).when(F.length(d) != 11, F.lit("bad_length"))
            .when(d.rlike(r"^(\d)\1{10}$"), F.lit("all_equal")).when(good, F.lit("ok")).otherwise(F.lit("dv_mismatch")))


def is_valid_cpf(c: Column | str) -> Column:
    return cpf_check_reason(c) == "ok"


def is_valid_cnpj(c: Column | str) -> Column:
    d = only_digits(c)
    first = _mod11(d, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
    second = _mod11(d, [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
    good = (F.substring(d, 13, 1) == first.cast("string")) & (F.substring(d, 14, 1) == second.cast("string"))
    return (F.length(d) == 14) & ~d.rlike(r"^(\d)\1{13}$") & F.coalesce(good, F.lit(False))


def is_valid_tax_id(c: Column | str) -> Column:
    """A valid CPF or CNPJ by its length."""
    d = only_digits(c)
    return F.when(F.length(d) == 11, is_valid_cpf(c)).when(F.length(d) == 14, is_valid_cnpj(c)).otherwise(F.lit(False))


def normalize_renavam(c: Column | str) -> Column:
    """9 or 10 digits get leading zeros to 11; 11 stay; else null."""
    d = only_digits(c)
    return F.when(F.length(d).isin(9, 10, 11), F.lpad(d, 11, "0"))


def is_valid_renavam(c: Column | str) -> Column:
    """Weights 2 to 9 from the right over ten digits; false for null."""
    d = normalize_renavam(c)
    total = _weighted(d, [3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
    digit = (11 - total % 11) % 11
    return F.coalesce(F.substring(d, 11, 1).try_cast("int") == F.when(digit == 10, F.lit(0)).otherwise(digit), F.lit(False))


def normalize_plate(c: Column | str) -> Column:
    return compact_alnum(c)


def is_valid_plate(c: Column | str) -> Column:
    return normalize_plate(c).rlike("^[A-Z]{3}[0-9][A-Z0-9][0-9]{2}$")


def normalize_vin(c: Column | str) -> Column:
    return compact_alnum(c)


def is_valid_vin(c: Column | str) -> Column:
    return normalize_vin(c).rlike("^[A-HJ-NPR-Z0-9]{17}$")


#: Glyphs that text recognition confuses.
TO_DIGIT, TO_LETTER = ("OILSB", "01158"), ("0158", "OISB")


def _as_plate(window: Column, pattern: str) -> Column:
    """The window with confused glyphs swapped to fit a pattern of L (letter) and D (digit)."""
    return F.concat(*(F.translate(F.substring(window, i, 1), *(TO_LETTER if k == "L" else TO_DIGIT)) for i, k in enumerate(pattern, 1)))


def _windows(t: Column) -> Column:
    """All runs of seven characters."""
    return F.when(F.length(t) >= 7, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 6, F.lit(1))), lambda i: F.substr(t, i, F.lit(7)))).otherwise(F.array().cast("array<string>"))


def first_plate_window(c: Column | str) -> Column:
    """The first 7-character window that is a plate after swaps, in either layout."""
    def plate(w: Column) -> Column:
        older, newer = _as_plate(w, "LLLDDDD"), _as_plate(w, "LLLDLDD")
        return F.when(older.rlike("^[A-Z]{3}[0-9]{4}$"), older).when(newer.rlike("^[A-Z]{3}[0-9][A-Z][0-9]{2}$"), newer)

    return F.get(F.filter(F.transform(_windows(compact_alnum(c)), plate), lambda p: p.isNotNull()), F.lit(0))


def fix_plate_ocr(c: Column | str) -> Column:
    """The first 7-character window that is a plate after swaps; the older layout is tried first."""
    t = compact_alnum(c)
    windows = _windows(t)

    def first(pattern: str, rx: str) -> Column:
        return F.get(F.filter(F.transform(windows, lambda w: _as_plate(w, pattern)), lambda p: p.rlike(rx)), F.lit(0))

    return F.coalesce(first("LLLDDDD", "^[A-Z]{3}[0-9]{4}$"), first("LLLDLDD", "^[A-Z]{3}[0-9][A-Z][0-9]{2}$"))
