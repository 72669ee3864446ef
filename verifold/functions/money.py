"""Amounts: five grammars, kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verifold.functions.text import text

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
#: An amount such as 1.234,56 with an optional R$.
BR_AMOUNT = r"(\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2})"


def _double(t: Column, rx: str = NUMBER) -> Column:
    return F.when(t.rlike(rx), t.try_cast("double"))


def _dots(t: Column) -> Column:
    """Both marks: dots are thousands; only a comma: it is the decimal mark; only dots: as they are."""
    return F.when(t.contains(",") & t.contains("."), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit(".")))


def parse_money_any(c: Column | str) -> Column:
    """Any amount in reais; other characters are dropped, invalid becomes null. '3.700' is 3.7."""
    t = _dots(F.replace(F.replace(F.trim(text(c)), F.lit("R$"), F.lit("")), F.lit(" "), F.lit("")))
    return _double(F.regexp_replace(t, r"[^0-9.\-]", ""))


def parse_money_br(c: Column | str) -> Column:
    """As parse_money_any, but other characters make it null."""
    return _double(_dots(F.replace(F.replace(F.trim(text(c)), F.lit("R$"), F.lit("")), F.lit(" "), F.lit(""))))


def parse_money_reais(c: Column | str) -> Column:
    """Any comma: dots dropped and comma the decimal mark; no comma: a plain number."""
    t = F.replace(F.replace(F.trim(text(c)), F.lit("R$"), F.lit("")), F.lit(" "), F.lit(""))
    return _double(F.when(t.contains(","), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t))


def money_to_cents(c: Column | str) -> Column:
    """Comma: whole part and two decimals; no comma: all digits times 100."""
    t = F.trim(text(c))
    whole, part = F.regexp_replace(F.substring_index(t, ",", 1), "[^0-9]", ""), F.regexp_replace(F.element_at(F.split(t, ","), -1), "[^0-9]", "")
    with_comma = F.coalesce(F.when(whole != "", whole), F.lit("0")).try_cast("bigint") * 100 + F.rpad(F.substring(part, 1, 2), 2, "0").try_cast("bigint")
    digits = F.regexp_replace(t, "[^0-9]", "")
    return F.when(digits == "", F.lit(None).cast("bigint")).when(t.contains(","), with_comma).otherwise(digits.try_cast("bigint") * 100)


def parse_signed_amount(c: Column | str) -> Column:
    """Sign, thousands dots, decimal comma; the Unicode minus counts."""
    t = F.translate(F.regexp_replace(text(c), r"\s", ""), "−", "-")
    return _double(F.replace(F.replace(F.replace(t, F.lit("R$"), F.lit("")), F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def first_amount(c: Column | str) -> Column:
    """The first amount with R$ and its sign, else the first amount."""
    return parse_signed_amount(first_amount_text(c))


def first_amount_text(c: Column | str) -> Column:
    """``first_amount`` as it is written."""
    t = F.translate(text(c), "−", "-")
    own = F.regexp_replace(F.regexp_extract(t, r"([+-]?\s*R\$\s*[+-]?\s*(?:" + BR_AMOUNT[1:-1] + "))", 1), r"\s", "")
    bare = F.regexp_extract(t, r"([+-]?(?:" + BR_AMOUNT[1:-1] + "))", 1)
    return F.when(own != "", own).otherwise(bare)


def amount_tokens_relaxed(c: Column | str) -> Column:
    """All amounts; blanks after a mark are allowed and removed."""
    found = F.regexp_extract_all(text(c), F.lit(r"([+-]?\d{1,3}(?:\.\s*\d{3})*,\s*\d{2}|[+-]?\d+,\s*\d{2})"), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, r"\s", ""))


def sum_currency_cents(c: Column | str) -> Column:
    """Sum of every 'R$ x,yy', in cents; none gives 0."""
    found = F.regexp_extract_all(text(c), F.lit(r"R\$\s*" + BR_AMOUNT), 1)
    return F.aggregate(F.transform(found, money_to_cents), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def money_on_label_line(lines: Column, label: str) -> Column:
    """First amount, as written, on the first of the lines (an array) that holds the label and an amount."""
    rx = r"((?:R\$\s*)?(?:\d{1,3}(?:\.\d{3})*|\d+),\d{2})\b"
    found = F.transform(lines, lambda x: F.when(F.upper(x).contains(label.upper()), F.nullif(F.trim(F.regexp_extract(x, rx, 1)), F.lit(""))))
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def int_or_text_to_cents(value: Column, kind: Column) -> Column:
    """Whole numbers above 100000 are cents already, others reais; text by money_to_cents. kind: the variant's schema."""
    n = value.try_cast("bigint")
    whole = kind.isin("BIGINT", "DECIMAL(1,0)") | kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT)$")
    return F.when(whole, F.when(n > 100000, n).otherwise(n * 100)).otherwise(money_to_cents(value))


def null_safe_add(a: Column, b: Column) -> Column:
    """Null only if both are."""
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def pt_br(amount: Column) -> Column:
    """1.234,56 for 1234.56."""
    return F.translate(F.format_number(amount.cast("decimal(18,2)"), 2), ",.", ".,")
