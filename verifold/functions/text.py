"""Names, addresses, masks and other text functions (Column to Column)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
STATES = ("AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO")
NAME_CONNECTORS = ("DE", "DA", "DO", "DAS", "DOS", "E")
PERSON_CONNECTORS = ("DE", "DA", "DO", "DAS", "DOS")
INITIAL_STOPWORDS = ("DA", "DE", "DO", "DAS", "DOS", "E", "LTDA", "ME", "EPP", "S/A", "SA", "S.A.", "SOCIEDADE", "ANONIMA", "ANÔNIMA")
INITIAL_LETTERS = "A-ZÁÉÍÓÚÂÊÔÃÕÇ"
BANKS = (("Itau", "ITAÚ|ITAU"), ("Caixa", "CAIXA"), ("Banco do Brasil", "BANCO DO BRASIL"), ("Santander", "SANTANDER"), ("Bradesco", "BRADESCO"))
COVER_TOKENS = ("REPÚBLICA", "REPUBLICA", "FEDERATIVA", "BRASIL", "SECRETARIA NACIONAL", "SENATRAN", "CARTEIRA NACIONAL", "TRÂNSITO", "TRANSITO")
NAME_LABELS = (
    "IDENTIFICAÇÃO DO VENDEDOR", "IDENTIFICACAO DO VENDEDOR", "IDENTIFICAÇÃO DO COMPRADOR", "IDENTIFICACAO DO COMPRADOR", "O REGISTRO DESTE VEÍCULO", "O REGISTRO DESTE VEICULO",
    "CÓDIGO RENAVAM", "CODIGO RENAVAM", "COR PREDOMINANTE", "CHASSI LOCAL", "PLACA", "RENAVAM", "VALOR", "MUNICÍPIO", "MUNICIPIO",
)
PERSON_JUNK = ("KE", "KH", "RTF", "GE", "GI", "NM", "MM", "NA", "ALO", "ACC", "QR", "CODE")
PARENT_JUNK = ("S", "M", "O", "OO", "ES", "GI", "NM", "MM", "EM", "RE", "IO", "LH", "WERT", "LAT", "LALATE", "ASSINATURA", "PORTADOR", "OBSERVACOES", "OBSERVAÇÕES", "NACIONALIDADE", "BRASILEIRO", "LEMA", "CAT", "HAB", "CNH")


def _accent_tables() -> tuple[str, str]:
    """Latin letters with marks, by decomposition, and the plain letters."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code) and base[0].isascii():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accent_tables()


def text(c: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_blank(c: Column | str) -> Column:
    t = F.trim(_c(c).cast("string"))
    return F.when(t != "", t)


def collapse(c: Column | str) -> Column:
    """Trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(_c(c).cast("string"), r"(?U)\s+", " "))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_c(c).cast("string"), r"(?U)^\s+|\s+$", "")


def only_digits(c: Column | str) -> Column:
    """Digits only; null becomes empty."""
    return F.regexp_replace(text(c), "[^0-9]", "")


def only_digits_or_null(c: Column | str) -> Column:
    d = only_digits(c)
    return F.when(d != "", d)


def normalize_doc_id(c: Column | str) -> Column:
    """11 or 14 digits, else empty."""
    d = only_digits(c)
    return F.when(F.length(d).isin(11, 14), d).otherwise(F.lit(""))


def strip_accents(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(_c(c).cast("string"), _ACCENTED, _PLAIN), r"\p{M}", "")


def normalize_name(c: Column | str) -> Column:
    """No accents, upper case, single spaces; blank becomes null."""
    t = F.upper(strip_accents(collapse(c)))
    return F.when(t != "", t)


def sanitize_name(c: Column | str) -> Column:
    """Upper case and single spaces; accents stay, null becomes empty."""
    return F.upper(collapse(text(c)))


def clean_human_name(c: Column | str) -> Column:
    return collapse(F.regexp_replace(F.upper(text(c)), "[^A-ZÀ-Ü ]", " "))


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(collapse(text(c)), " "), lambda x: x != "")


def is_human_name(c: Column | str) -> Column:
    """8 characters or more, no label in it, letters only, two tokens of two letters or more."""
    n = clean_human_name(c)
    labelled = F.lit(False)
    for w in NAME_LABELS:
        labelled |= n.contains(w)
    long = F.filter(tokens(n), lambda x: F.length(x) >= 2)
    return (F.length(n) >= 8) & ~labelled & (F.size(long) >= 2)


def name_tokens(c: Column | str) -> Column:
    """Accent-free upper tokens of letters without connectors; repeats stay."""
    t = F.regexp_replace(F.upper(strip_accents(text(c))), "[^A-Z ]", " ")
    return F.filter(tokens(t), lambda x: ~x.isin(*NAME_CONNECTORS))


def name_match_tolerant(a: Column | str, b: Column | str) -> Column:
    """Null if a side has no token; else same first and last token and the smaller set inside the larger."""
    x, y = name_tokens(a), name_tokens(b)
    small, large = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    same = (F.get(x, F.lit(0)) == F.get(y, F.lit(0))) & (F.get(x, F.size(x) - 1) == F.get(y, F.size(y) - 1)) & (F.size(F.array_except(small, large)) == 0)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), same)


def name_match_two_tokens(a: Column | str, b: Column | str) -> Column:
    """Equal, or two shared tokens at least; false if a side is empty."""
    x, y = sanitize_name(a), sanitize_name(b)
    shared = F.size(F.array_intersect(tokens(x), tokens(y)))
    return (x != "") & (y != "") & ((x == y) | (shared >= 2))


def name_jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard of accent-free tokens of two letters or more; null if both are empty."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.upper(strip_accents(text(c))), F.lit("([A-Z]{2,})"), 1)) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union)


def name_initials(c: Column | str) -> Column:
    """First letters of the upper-case tokens, without stop words and single characters."""
    kept = F.filter(tokens(sanitize_name(c)), lambda x: ~x.isin(*INITIAL_STOPWORDS) & (F.length(x) > 1))
    return F.transform(kept, lambda x: F.substring(x, 1, 1))


def initials_of_code(c: Column | str) -> Column:
    """Letters of a code of initials such as 'JS' or 'J.S.'."""
    return F.regexp_extract_all(F.upper(text(c)), F.lit(f"([{INITIAL_LETTERS}])"), 1)


def initials_match(code: Column | str, name: Column | str) -> Column:
    """Two initials or more on both sides, equal on the common length."""
    x, y = initials_of_code(code), name_initials(name)
    n = F.least(F.size(x), F.size(y))
    return (n >= 2) & (F.slice(x, 1, F.greatest(n, F.lit(1))) == F.slice(y, 1, F.greatest(n, F.lit(1))))


def masked_name_initials(c: Column | str) -> Column:
    """'J*** S***' gives [J, S]; tokens that are not masked give none."""
    return F.transform(F.filter(tokens(F.upper(text(c))), lambda x: x.rlike(rf"^[{INITIAL_LETTERS}]\*+\.?$")), lambda x: F.substring(x, 1, 1))


def is_masked_name(c: Column | str) -> Column:
    return text(c).contains("*")


def mask_doc(c: Column | str) -> Column:
    """ddd.***.***-dd, dd.***.***/****-dd, else *** and the last four."""
    d = only_digits(c)
    cpf = F.concat(F.substring(d, 1, 3), F.lit(".***.***-"), F.substring(d, 10, 2))
    cnpj = F.concat(F.substring(d, 1, 2), F.lit(".***.***/****-"), F.substring(d, 13, 2))
    return F.when(d == "", F.lit("")).when(F.length(d) == 11, cpf).when(F.length(d) == 14, cnpj).otherwise(mask_last4(d))


def mask_last4(c: Column | str) -> Column:
    return F.concat(F.lit("***"), F.right(text(c), F.lit(4)))


def mask_renavam(c: Column | str) -> Column:
    d = only_digits(c)
    return F.when(d == "", F.lit("")).when(F.length(d) >= 6, F.concat(F.substring(d, 1, 3), F.lit("*****"), F.right(d, F.lit(3)))).otherwise(F.lit("***"))


def mask_for_display(kind: Column, value: Column) -> Column:
    """CPF and CNPJ as ***.last4, other document numbers as ***last4, the rest unchanged."""
    k, d = F.lower(kind), only_digits(value)
    last = F.right(d, F.lit(4))
    number = F.lit(False)
    for w in ("rg", "registro", "cnh", "numero", "documento"):
        number |= k.contains(w)
    return (F.when(value.isNull() | (d == ""), value)
            .when(k.contains("cpf") | k.contains("cnpj"), F.concat(F.lit("***."), last))
            .when(number, F.concat(F.lit("***"), last)).otherwise(value))


def sanitize_path(c: Column | str) -> Column:
    """Forward slashes, no leading slash, no user's home."""
    p = F.regexp_replace(F.regexp_replace(text(c), r"\\", "/"), "^/+", "")
    return F.regexp_replace(p, r"^(?:[A-Za-z]:/)?(?:Users|home)/[^/]+/", "")


def normalize_text(c: Column | str) -> Column:
    """No-break spaces as spaces, runs of blanks as one, trimmed; line ends stay."""
    return F.trim(F.regexp_replace(F.translate(text(c), " ", " "), "[ \\t]+", " "))


def normalize_vehicle_text(c: Column | str) -> Column:
    t = F.upper(strip_accents(text(c)))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^A-Z0-9_\s/:.\-]", " "), r"\s{2,}", " "))


def compact_alnum(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(strip_accents(text(c))), "[^A-Z0-9]", "")


def split_city_state(c: Column | str) -> tuple[Column, Column]:
    """City and state: a state as last token, or 'CITY - UF' / 'CITY/UF'; else the text and null."""
    t = F.upper(collapse(text(c)))
    last = F.element_at(F.split(t, "[ /\\-]+"), -1)
    has = last.isin(*STATES) & t.rlike(r"[ /\-][A-Z]{2}$")
    city = F.trim(F.regexp_replace(t, r"[ /\-]+[A-Z]{2}$", ""))
    return F.when(t == "", None).when(has, city).otherwise(t), F.when(has, last)


#: Names of the numbers that stand behind an address, in the order in which they are cut off.
ADDRESS_TAILS = ("CLIENTE", "COD(?:IGO)? +CLIENTE", "N[ºO]? *CLIENTE", "UNIDADE +CONSUMIDORA", "UC", "INSTAL(?:A[CÇ][AÃ]O)?", "CONTA", "CONTRATO")


def clean_address(c: Column | str) -> Column:
    """Without tails of a name and a number (customer, unit, contract), invoice notes and links; case stays, and so do such names without a number."""
    t = collapse(text(c))
    for name in ADDRESS_TAILS:
        t = F.trim(F.regexp_replace(t, rf"(?iu) +{name} *:? *\d+\b.*$", ""))
    t = collapse(F.regexp_replace(t, r"(?iu)(?:\bNOTA FISCAL\b|https?://).*$", ""))
    return F.when(t != "", t)


def first_non_empty(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*(F.when(c.cast("string") != "", c.cast("string")) for c in cols))


def looks_like_cover_only(c: Column | str) -> Column:
    """Empty, or three boilerplate tokens or more in under 1500 characters."""
    t = F.upper(text(c))
    n = F.lit(0)
    for w in COVER_TOKENS:
        n += t.contains(w).cast("int")
    return (t == "") | ((n >= 3) & (F.length(t) < 1500))


def clean_value(c: Column | str) -> Column:
    """Null for single glyphs of noise and anything under two characters."""
    t = collapse(text(c))
    return F.when(F.length(t) >= 2, t)


def detect_bank(c: Column | str) -> Column:
    t, out = F.upper(text(c)), F.lit(None).cast("string")
    for name, rx in reversed(BANKS):
        out = F.when(t.rlike(rx), F.lit(name)).otherwise(out)
    return out


def is_machine_line(c: Column | str) -> Column:
    """20 characters or more of A-Z, 0-9 and '<', five '<' among them."""
    t = F.upper(F.trim(text(c)))
    return t.rlike("^[A-Z0-9<]{20,}$") & (F.regexp_count(t, F.lit("<")) >= 5)


def machine_line_name(c: Column | str) -> Column:
    """A person's name of two tokens or more between the '<' of a machine line."""
    t = normalize_person_name(F.replace(F.trim(text(c)), F.lit("<"), F.lit(" ")))
    return F.when(is_machine_line(c) & (F.size(tokens(t)) >= 2), t)


def normalize_person_name(c: Column | str, junk: tuple[str, ...] = PERSON_JUNK, least: int = 2) -> Column:
    """A person's name from a noisy line: no dates, brackets, junk tokens or vowel-less scraps; null if nothing is left."""
    t = F.regexp_replace(F.upper(text(c)), r"(?s)\|.*$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\b\d{2}/\d{2}/\d{4}\b", " "), "[^A-ZÀ-Ü]", " ")
    kept = F.filter(tokens(t), lambda x: x.isin(*PERSON_CONNECTORS) | (~x.isin(*junk) & (F.length(x) >= least) & ((F.length(x) > 3) | x.rlike("[AEIOUÀ-Ü]"))))
    ends = "|".join(PERSON_CONNECTORS)
    out = F.trim(F.regexp_replace(F.regexp_replace(F.array_join(kept, " "), f"^((?:{ends})( |$))+", ""), f"( (?:{ends}))+$", ""))
    return F.when(out != "", out)


def clean_parent_line(c: Column | str) -> Column:
    """As a person's name, with tokens of three letters or more and its own junk."""
    return normalize_person_name(F.regexp_replace(F.upper(text(c)), r"\b(FILIAÇÃO|FILIACAO)\b", " "), PARENT_JUNK, 3)


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names whose value is null, blank or an empty list."""
    def lacks(c: Column) -> Column:
        shown = F.trim(c.cast("string"))
        return c.isNull() | (shown == "") | (F.typeof(c).startswith("array") & (shown == "[]"))

    return F.filter(F.array(*(F.when(lacks(c), F.lit(n)) for n, c in fields.items())), lambda x: x.isNotNull())
