"""Fields of documents from their texts: one job a type, texts(doc_id, text) to typed rows.

Labels are looked up with regular expressions over the whole text or over its lines; nothing leaves
the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verifold.functions import dates, ids, money
from verifold.functions import text as T
from verifold.operators import lines as L
from verifold.plans import statements

#: What tells a document's type. Of the types in order the first counts whose words stand in
#: the lower-case file name, or one of whose groups of patterns is wholly found in the upper-case text.
KEYWORDS = (
    ("cnh", ("cnh",), (("CARTEIRA NACIONAL DE HABIL",), ("SENATRAN",), ("ASSINADOR SERPRO",))),
    ("proposta", ("daycoval",), (("PLANILHA DE PROPOSTA",), ("BANCO DAYCOVAL",), (r"\bPROPOSTA:\s*\d{6,}\b",))),
    ("residencia", ("celesc",), (("SEGUNDA VIA", "ENDERECO"), ("UNIDADE CONSUMIDORA",), ("NOME:", "CEP:", "CIDADE:"))),
    ("holerite", ("holerite",), (("RECIBO DE PAGAMENTO",), ("PAGAMENTO DE SALARIO",), (r"ADM\.:", "SALARIO"))),
    ("extrato", ("extrato",), (("EXTRATO POR PERIODO",), ("LANCAMENTOS",), ("HISTORICO/COMPLEMENTO",), ("SALDO ANTERIOR",))),
)
#: The same for intake, first by name, then by text: (types, the first allowed one is meant; words or patterns).
INTAKE_NAMES = ((("cnh", "cnh_senatran"), ("cnh",)), (("proposta_daycoval",), ("daycoval", "proposta")), (("holerite",), ("holerite",)), (("folha_pagamento",), ("folha",)), (("extrato_bancario",), ("extrato",)))
INTAKE_TEXTS = (
    (("cnh", "cnh_senatran"), (("CARTEIRA NACIONAL DE HABIL",), ("ASSINADOR SERPRO",), ("SENATRAN",))),
    (("proposta_daycoval",), (("BANCO DAYCOVAL",), ("PLANILHA DE PROPOSTA",), (r"\bPROPOSTA:\s*\d{6,}\b",))),
    (("extrato_bancario",), (("EXTRATO", "SALDO"), ("LANCAMENTOS",), ("HISTORICO",))),
    (("holerite", "folha_pagamento"), (("RECIBO DE PAGAMENTO",), ("PAGAMENTO DE SALARIO",))),
)
INTAKE_TYPES = ("cnh", "cnh_senatran", "proposta_daycoval", "holerite", "folha_pagamento", "extrato_bancario")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def _groups(c: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    return reduce(lambda a, b: a | b, (reduce(lambda x, y: x & y, (c.rlike(rx) for rx in g)) for g in groups))


def classify_by_keywords(df: DataFrame) -> DataFrame:
    """Adds doc_class: cnh, proposta, residencia, holerite, extrato or desconhecido. Needs file_name and text."""
    name, up, out = F.lower(T.text("file_name")), F.upper(T.text("text")), F.lit("desconhecido")
    for kind, words, groups in reversed(KEYWORDS):
        out = F.when(_any(name, words) | _groups(up, groups), F.lit(kind)).otherwise(out)
    return df.withColumn("doc_class", out)


def classify_for_intake(df: DataFrame, chars: int = 8000, allowed: tuple[str, ...] = INTAKE_TYPES) -> DataFrame:
    """Adds doc_class, one of the allowed types: by file name, then by the start of the text; null when none fits."""
    name, up = F.lower(T.text("file_name")), F.upper(F.substring(T.text("text"), 1, chars))
    meant = lambda types: next((t for t in types if t in allowed), None)
    by_name = [F.when(_any(name, words), F.lit(meant(types))) for types, words in INTAKE_NAMES if meant(types)]
    by_text = [F.when(_groups(up, groups), F.lit(meant(types))) for types, groups in INTAKE_TEXTS if meant(types)]
    return df.withColumn("doc_class", F.coalesce(F.lit(None).cast("string"), *by_name, *by_text))


def text_source_policy(df: DataFrame, least: int = 800) -> DataFrame:
    """chosen text: native if long enough and no mere cover, else the other pass if there is one, else the longer."""
    native, other = T.text("native"), T.text("other")
    good = (F.length(native) >= least) & ~T.looks_like_cover_only("native")
    longer = F.when(F.length(other) > F.length(native), other).otherwise(native)
    chosen = F.when(good, native).when(F.trim(other) != "", other).otherwise(longer)
    return df.withColumns({"chosen": chosen, "chosen_from": F.when(chosen == native, F.lit("native")).otherwise(F.lit("other"))})


def optional_doc_gate(df: DataFrame, enabled: bool, optional: tuple[str, ...] = ("payslip", "payroll", "bank_statement")) -> DataFrame:
    return df if enabled else df.where(~F.col("doc_type").isin(*optional))


def text_quality_score(df: DataFrame) -> DataFrame:
    """Adds score: how much of a licence can be read in column text (words, shapes, and the fields that extract_licence finds)."""
    up = F.upper(T.text("text"))
    point = lambda hit, n: F.when(F.coalesce(hit, F.lit(False)), F.lit(n)).otherwise(F.lit(0))
    f = licence_fields(F.col("text"))
    score = (
        point(up.contains("SENATRAN") | up.contains("SECRETARIA NACIONAL"), 2)
        + point(up.rlike(r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b"), 8)
        + point(up.rlike(r"\b\d{2}/\d{2}/\d{4}\b"), 3)
        + point(f["cpf"].isNotNull(), 10) + point(f["validade"].isNotNull(), 6) + point(f["data_nascimento"].isNotNull(), 4)
        + point(f["cidade_nascimento"].isNotNull() & f["uf_nascimento"].isNotNull(), 4) + point(f["nome"].isNotNull(), 6)
        - point(F.length(up) < 300, 5)
    )
    return df.withColumn("score", score)


def best_text_candidate(df: DataFrame) -> DataFrame:
    """Best candidate text of each document by (score, length); if it is blank, the candidates that are not, by score, one below the other.

    Needs doc_id, candidate (number) and text.
    """
    scored = text_quality_score(df.withColumn("text", T.text("text"))).select("doc_id", "text", F.struct((-F.col("score")).alias("s"), (-F.length("text")).alias("n"), "candidate").alias("rank"), "score")
    best = scored.groupBy("doc_id").agg(F.min_by("text", "rank").alias("best"), F.min_by("score", "rank").alias("score"), F.array_sort(F.collect_list(F.struct("rank", T.strip("text").alias("t")))).alias("all"))
    joined = F.array_join(F.filter(F.transform("all", lambda x: x["t"]), lambda t: t != ""), "\n")
    return best.select("doc_id", F.when(T.strip("best") != "", T.strip("best")).otherwise(joined).alias("text"), "score")


def name_line_score(c: Column | str) -> Column:
    """Tokens, 2 more for three to six, 2 less beyond eight."""
    n = F.size(T.tokens(T.normalize_person_name(c)))
    return n + F.when(n.between(3, 6), F.lit(2)).otherwise(F.lit(0)) - F.when(n > 8, F.lit(2)).otherwise(F.lit(0))


def best_name(lines: Column, least: int = 4) -> Column:
    """The name in the line that reads most like one; the first of equals."""
    ranked = F.transform(lines, lambda x, i: F.struct(name_line_score(x).alias("s"), (-i).alias("o"), T.normalize_person_name(x).alias("name")))
    return F.array_max(F.filter(ranked, lambda r: r["name"].isNotNull() & (r["s"] >= least)))["name"]


def best_name_line(lines: DataFrame) -> DataFrame:
    """``best_name`` of rows (doc_id, pos, line)."""
    rows = lines.withColumns({"name": T.normalize_person_name("line"), "score": name_line_score("line")}).where("name is not null and score >= 4")
    return rows.groupBy("doc_id").agg(F.max_by("name", F.struct("score", -F.col("pos"))).alias("nome"))


def parent_score(c: Column | str) -> Column:
    """How much a cleaned line reads like a parent's name; 0 below two tokens."""
    t = T.text(c)
    words, letters = T.tokens(t), F.length(F.regexp_replace(t, " ", ""))
    n, vowels = F.size(words), F.regexp_count(t, F.lit("[AEIOUÀ-Ü]"))
    has = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    score = (2 * vowels / F.greatest(letters, F.lit(1)) + 0.15 * letters / F.greatest(n, F.lit(1)) + F.when(has(T.PERSON_CONNECTORS), F.lit(0.6)).otherwise(F.lit(0.0))
             + 0.25 * F.least(n, F.lit(6)) - F.when(has(("WERT", "LAT", "LALATE")), F.lit(2.0)).otherwise(F.lit(0.0)))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.round(score, 6))


#: What ends the list of parents.
PARENT_STOPS = ("ASSINAT", "OBSERV", "NACIONAL", "LEMA", "LOCAL", "I<BR", "SERPRO", "SENATRAN")


def top2_relative(lines: Column, share: float = 0.7, least: float = 1.4) -> Column:
    """Parents of a document: the best line, and the second if it comes near.

    The first four distinct names below 'FILIA' (13 lines at most, up to a stop word) compete.
    """
    below = F.slice(L.array_slice(lines, ("FILIA",)), 1, 13)
    stop = L.first_index(below, lambda x: _any(F.upper(x), PARENT_STOPS))
    before = F.when(stop.isNotNull(), F.slice(below, F.lit(1), F.coalesce(stop, F.lit(0)))).otherwise(below)
    names = F.slice(F.array_distinct(F.filter(F.transform(before, T.clean_parent_line), lambda x: x.isNotNull())), 1, 4)
    ranked = F.array_sort(F.transform(names, lambda x, i: F.struct((-parent_score(x)).alias("s"), i.alias("o"), x.alias("name"))))
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    near = (-second["s"] >= share * -best["s"]) & (-second["s"] >= least)
    return F.filter(F.array(best["name"], F.when(near, second["name"])), lambda x: x.isNotNull())


def prefer_registry_zone(text: Column, own: Column) -> Column:
    """Category next to the last 11-digit number that is not the own CPF, else the last one, else near CAT."""
    up = F.upper(T.text(text))
    pairs = F.regexp_extract_all(up, F.lit(r"(\d{11}\s+[A-E]{1,2})\b"), 1)
    other = F.filter(pairs, lambda p: F.substring(p, 1, 11) != F.coalesce(own, F.lit("")))
    last = lambda a: F.when(F.size(a) > 0, F.regexp_extract(F.element_at(a, -1), r"([A-E]{1,2})$", 1))
    near = F.nullif(F.regexp_extract(up, r"\bCAT(?:EG(?:ORIA)?)?\W{0,12}([A-E]{1,2})\b", 1), F.lit(""))
    return F.coalesce(last(F.when(F.size(other) > 0, other)), last(F.when(F.size(pairs) > 0, pairs)), near)


def _spaced(text: Column) -> Column:
    """No-break spaces as spaces, so that patterns see them."""
    return F.translate(T.text(text), "\u00a0", " ")


def _first(text: Column, *rxs: str) -> Column:
    """First group of the first pattern that matches the text and is not blank, with single spaces."""
    return F.coalesce(*(T.null_if_blank(T.collapse(F.regexp_extract(T.text(text), rx, 1))) for rx in rxs))


def _between(text: Column, start: str, end: str) -> Column:
    """What stands between two words, over lines."""
    return _first(text, rf"(?isu)\Q{start}\E\s*(.*?)\s*\Q{end}\E")


def _fields(texts: DataFrame, fields: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """doc_id and fields made of the text: a projection."""
    return texts.select("doc_id", *(c.alias(k) for k, c in fields(F.col("text")).items()))


CPF = r"(\d{3}\.?\d{3}\.?\d{3}-?\d{2})"
BR_DATE = r"(\d{2}/\d{2}/\d{4})"
AMOUNT = r"(\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2})"
#: The printed form of a proposal. Words that end the shop's name; what follows the mother's name in
#: other fields; the number of a street.
SHOP_ENDS = r"(?iu)\b(?:VENDEDOR|DIVERSOS|BANCO|AGENTE|AGENT/OPER|CARTEIRA|TELEFONE|DADOS\s+PESSOAIS|GRUPO\s+CLIENTE)\b.*$"
NEXT_FIELDS = r"(?iu)\b(?:Nome\s+C[oô]njuge|Endere[cç]o|Bairro|Cidade|UF|Cep|Telefone|Celular|E-?Mail|ATIVIDADE\s+PROFISSIONAL|Empresa|Sal[aá]rio|Outras\s+Rendas|DADOS\s+DO\s+C[oô]NJUGE|REFER[ÊE]NCIA|DADOS\s+DO\s+AVALISTA|Continua)\b"
STREET_NUMBER = r"\bN[ºo]\s*\.?\s*(?:\.\s*)?:?\s*(\d{1,6})\b"
MOTHER = r"(?isu)\bFil\.?\s*M[ãa]e\s*:\s*(.+?)\s+(?=Qtde\b)(.*)$"


def _mother(text: Column) -> Column:
    """The mother's name, and a surname alone on one of the next six lines: that of dependents is skipped, any other ends the search."""
    name = F.upper(_first(text, MOTHER))
    below = F.transform(F.split(F.regexp_extract(T.text(text), MOTHER, 2), r"\R"), lambda x: F.upper(T.collapse(x)))
    surname = L.take_below(below, 6, lambda x: (x == "") | x.rlike(r"\bQTDE\b") | x.contains("DEPENDENTE"), lambda x: x.rlike(r"^[A-ZÀ-Ü '\-]{2,40}$") & ~x.rlike(NEXT_FIELDS))
    return F.when(name.isNotNull(), F.concat_ws(" ", name, surname))


def proposal_fields(text: Column) -> dict[str, Column]:
    """Seventeen fields of a credit proposal; names are upper case, other values as printed."""
    t = _spaced(text)
    person = r"(?iu)\bFINANCIADO\s*:\s*([A-ZÀ-Ü\s]+?)\s*\(([\d.\-]+)\w?\)"
    born = r"(?iu)\bNaturalidade\s*:\s*([A-ZÀ-Ü\s]+?)\s+UF\s+Naturalidade\s*:\s*([A-Z]{2})"
    at = lambda rx, i: T.null_if_blank(T.collapse(F.regexp_extract(t, rx, i)))
    shop = _first(t, r"(?iu)\bLOJA\s*:\s*(.+)")
    address = _first(t, r"(?isu)\bEndere[cç]o\s*:\s*(.+?)\s+Cep\s*:")
    numbered = address.rlike(f"(?iu){STREET_NUMBER}")
    street = F.when(numbered, F.regexp_replace(address, f"(?iu){STREET_NUMBER}.*$", "")).otherwise(F.regexp_replace(address, r"(?iu)\bCompl\.?\s*:.*$", ""))
    return {
        "proposta": _first(t, r"(?iu)\bProposta\s*:\s*(\d{4,})\b"), "nome_financiado": F.upper(at(person, 1)), "nome_loja": F.upper(T.null_if_blank(F.regexp_replace(shop, SHOP_ENDS, ""))),
        "cpf": F.coalesce(T.only_digits_or_null(at(person, 2)), T.only_digits_or_null(_first(t, r"(?iu)\bCPF\s*:\s*([\d.\-]{11,})"))),
        "data_nascimento": _first(t, rf"(?iu)\bData\s+de\s+Nasc\.?\s*:\s*{BR_DATE}"), "cidade_nascimento": F.upper(at(born, 1)), "uf": F.upper(at(born, 2)), "nome_mae": _mother(t),
        "endereco": F.coalesce(T.null_if_blank(T.collapse(street)), address), "numero": _first(address, f"(?iu){STREET_NUMBER}"), "complemento": F.upper(_first(address, r"(?iu)\bCompl\.?\s*:\s*([A-Z0-9\-\s]+)$")),
        "empresa": _between(t, "Empresa:", "C.N.P.J"), "data_admissao": _between(t, "Data Adm.:", "Cargo"), "salario": _between(t, "Salário:", "Outras Rendas:"),
        "outras_rendas": F.coalesce(_first(t, rf"(?iu)\bOutras\s+Rendas\s*:\s*{AMOUNT}\b"), _first(_between(t, "Outras Rendas:", "Vlr. Parcela:"), AMOUNT)),
        "valor_parcela": _first(t, rf"(?iu)\b(?:Vlr\.?|Valor)\s*(?:da\s*)?(?:Parcela|Prest(?:a[cç][aã]o)?)\b\s*[:\-]?\s*(?:R\$\s*)?{AMOUNT}\b", rf"(?iu)\bParcela\b[^\d\n]{{0,40}}(?:R\$\s*)?{AMOUNT}\b"),
        "valor_compra": _first(t, rf"(?iu)\bVlr\.?\s*Compra\b\s*[:\-]?\s*(?:R\$\s*)?{AMOUNT}\b"),
    }


def extract_proposal(texts: DataFrame) -> DataFrame:
    """``proposal_fields`` of each text."""
    return _fields(texts, proposal_fields)


def licence_fields(text: Column) -> dict[str, Column]:
    """Fields of a licence as columns over its text."""
    lines = L.lines_of(text)
    machine = L.first_of(lines, lambda x, _: T.machine_line_name(x))
    birth_line = L.first_of(lines, lambda x, _: F.when(x.rlike(rf"{BR_DATE}.*,"), x))
    cpf = T.only_digits_or_null(F.nullif(F.regexp_extract(T.text(text), rf"(?<!\d){CPF}(?!\d)", 1), F.lit("")))
    birth = F.coalesce(F.nullif(F.regexp_extract(T.text(birth_line), BR_DATE, 1), F.lit("")), dates.earliest_date(text))
    city, state = T.split_city_state(F.regexp_replace(F.regexp_extract(T.text(birth_line), rf"{BR_DATE}\s*,\s*(.+)$", 2), ",", " "))
    expiry = dates.latest_date(text)
    return {
        "nome": F.coalesce(machine, T.normalize_person_name(L.array_value_after(lines, "NOME")), best_name(lines)), "cpf": cpf, "categoria": prefer_registry_zone(text, cpf),
        "data_nascimento": birth, "validade": expiry, "cidade_nascimento": city, "uf_nascimento": state, "filiacao": top2_relative(lines),
        "low_signal": (F.length(T.text(text)) < 1200) | (cpf.isNull() & expiry.isNull()),
    }


def extract_licence(texts: DataFrame) -> DataFrame:
    """nome, cpf, categoria, data_nascimento, validade, cidade_nascimento, uf_nascimento, filiacao, low_signal."""
    return _fields(texts, licence_fields)


def licence_registry_fields(text: Column) -> dict[str, Column]:
    category = _first(text, r"(?iu)\bCATEGORIA\W{0,12}([A-E]{1,2})\b", r"(?iu)\bCAT\W{0,12}([A-E]{1,2})\b", r"(?iu)\bCATEG\W{0,12}([A-E]{1,2})\b")
    fields = licence_fields(text)
    return fields | {"categoria": F.coalesce(category, fields["categoria"])}


def extract_licence_registry(texts: DataFrame) -> DataFrame:
    """A licence with the category next to CATEGORIA, CAT or CATEG."""
    return _fields(texts, licence_registry_fields)


#: Labels of a payslip's fields.
EMPLOYER_LABELS = ("EMPREGADOR", "EMPRESA", "RAZAO SOCIAL", "RAZÃO SOCIAL", "CNPJ/CPF", "CNPJ")
EMPLOYEE_LABELS = ("NOME", "NOME DO FUNCIONARIO", "NOME DO FUNCIONÁRIO", "FUNCIONARIO", "FUNCIONÁRIO", "EMPREGADO")
HIRE_LABELS = ("ADMISSAO", "ADMISSÃO", "DATA ADMISSAO", "DATA ADMISSÃO", "DT ADMISSAO", "DT ADMISSÃO")
TOTAL_LABELS = ("TOTAL DE VENCIMENTOS", "TOTAL VENCIMENTOS", "TOTAL DOS VENCIMENTOS", "VENCIMENTOS", "TOTAL PROVENTOS", "TOTAL DE PROVENTOS")
MONEY = r"\b(\d{1,3}(?:\.\d{3})*,\d{2}|\d+,\d{2})\b"


def extract_payslip(texts: DataFrame) -> DataFrame:
    """nome, cpf (digits), empregador, data_admissao, total_vencimentos; each by its label, then by a fallback."""
    return _fields(texts, payslip_fields)


def payslip_fields(text: Column) -> dict[str, Column]:
    lines, whole = L.lines_of(text), T.text(text)
    tail = lambda x: T.clean_value(F.regexp_extract(x, r"^[^:\-]*[:\-]\s*(.*)$", 1))
    holds = lambda x, labels: _any(F.upper(x), labels)
    two_words = lambda v: F.when(F.size(T.tokens(v)) >= 2, v)
    clean = T.clean_value
    employer = F.coalesce(
        L.first_of(lines, lambda x, below: F.when(holds(x, EMPLOYER_LABELS), F.coalesce(tail(x), clean(below)))),
        L.first_of(F.slice(lines, 1, 12), lambda x, _: F.when((F.length(x) >= 12) & ~holds(x, ("CPF", "FUNCION", "ADMISS")), two_words(clean(x)))),
    )
    before = F.slice(F.reverse(L.lines_of(F.regexp_extract(whole, rf"(?s)^(.*?)\b{CPF}\b", 1))), 1, 6)
    employee = F.coalesce(
        L.first_of(lines, lambda x, _: F.when(F.upper(x).isin(*EMPLOYEE_LABELS) | _any(F.upper(x), tuple(f"{n}:" for n in EMPLOYEE_LABELS)), two_words(tail(x)))),
        L.first_of(lines, lambda x, below: F.when(holds(x, EMPLOYEE_LABELS), two_words(clean(below)))),
        L.first_of(before, lambda x, _: F.when(~x.rlike(MONEY), two_words(clean(x)))),
    )
    date = r"(?<!\d)(\d{1,2}/\d{1,2}/\d{4})(?!\d)"
    hired = L.array_labelled_match(lines, HIRE_LABELS, date)
    parts = F.split(hired, "/")
    amounts = F.regexp_extract_all(whole, F.lit(MONEY), 1)
    total = F.coalesce(L.array_labelled_match(lines, TOTAL_LABELS, MONEY, False), F.get(amounts, F.size(amounts) - 1))
    return {
        "nome": employee, "cpf": T.only_digits_or_null(F.regexp_extract(whole, rf"\b{CPF}\b", 1)), "empregador": employer,
        "data_admissao": F.when(hired.isNotNull(), dates.format_date_parts(*(F.get(parts, F.lit(i)) for i in range(3)))), "total_vencimentos": total,
    }


def residence_fields(text: Column) -> dict[str, Column]:
    """Of a residence proof: the holder behind NOME, NOME DO CONSUMIDOR or NOME DO TITULAR, and the due date in three readings."""
    t, lines = _spaced(text), L.lines_of(text)
    town = T.collapse(F.regexp_replace(_first(t, r"(?iu)CIDADE\s*[:\-]?\s*(.+)"), r"(?iu)(?:\bGRUPO\b\s*/|https?://).*$", ""))
    city, state = T.split_city_state(town)
    has = lambda x, w: F.upper(x).contains(w)
    dated = lambda x: F.nullif(F.regexp_extract(x, rf"\b{BR_DATE}\b", 1), F.lit(""))
    due = F.coalesce(
        _first(t, *(rf"(?iu){label}\s*[:\-]?\s*{BR_DATE}" for label in (r"DATA\s+DE\s+VENCIMENTO", r"(?:VENCIMENTO|VENC\.)", r"PAGAR\s+AT[ÉE]"))),
        L.first_of(lines, lambda x, _: F.when(has(x, "VENC") & ~has(x, "EMIS"), dated(x))),
        dates.latest_date(F.array_join(F.filter(lines, lambda x: ~has(x, "EMIS")), "\n")),
    )
    return {
        "nome_titular": _first(t, r"(?iu)NOME(?:\s+DO\s+(?:CONSUMIDOR|TITULAR))?\s*[:\-]?\s*(.+)"), "endereco": T.clean_address(_first(t, r"(?iu)ENDERE[ÇC]O\s*[:\-]?\s*(.+)")),
        "cep": _first(t, r"\b(\d{5}-?\d{3})\b"), "cidade": city, "uf": state, "vencimento": due,
    }


def extract_residence(texts: DataFrame) -> DataFrame:
    """nome_titular, endereco, cep, cidade, uf, vencimento."""
    return _fields(texts, residence_fields)


#: Labels of a vehicle certificate; what follows them on their line counts, so a longer word leaves its rest.
CERTIFICATE = {"marca_modelo": "MARCA/MODELO", "categoria": "CATEGORIA", "combustivel": "COMBUST", "cor": "COR", "proprietario_nome": "PROPRIET", "uf_licenciamento": "UF", "local_emissao": "LOCAL"}


def certificate_fields(text: Column) -> dict[str, Column]:
    """Fourteen fields of the electronic vehicle certificate: plate, RENAVAM, chassis and date of issue by their shape, the others by labels."""
    lines = F.filter(L.lines_of(text), lambda x: ~x.rlike(L.CERTIFICATE_NOISE))
    blob = F.upper(F.array_join(lines, " "))
    years = F.regexp_extract_all(L.array_tabular_value(lines, "ANO FAB/MOD"), F.lit(r"\b((?:19|20)\d{2})\b"), 1)
    issued = r"\b([0-3]?\d)/([01]?\d)/((?:19|20)\d{2})\b"
    owner_id = L.first_of(lines, lambda x, _: F.when(F.upper(x).contains("PROPRIET"), F.nullif(F.regexp_extract(x, r"\b(\d{3}\.\d{3}\.\d{3}-\d{2})\b", 1), F.lit(""))))
    return {
        "placa": _first(blob, r"\b([A-Z]{3}[0-9][A-Z0-9][0-9]{2})\b"), "renavam": _first(blob, r"\b(\d{11})\b"), "chassi": _first(blob, r"\b([A-HJ-NPR-Z0-9]{17})\b"),
        **{k: L.array_tabular_value(lines, label) for k, label in CERTIFICATE.items()},
        "ano_fabricacao": F.get(years, F.lit(0)), "ano_modelo": F.coalesce(F.get(years, F.lit(1)), F.get(years, F.lit(0))), "proprietario_doc": owner_id,
        "data_emissao": F.when(blob.rlike(issued), dates.format_date_parts(*(F.regexp_extract(blob, issued, i) for i in (1, 2, 3)))),
    }


def extract_vehicle_certificate(texts: DataFrame) -> DataFrame:
    """``certificate_fields`` of each text."""
    return _fields(texts, certificate_fields)


def vehicle_fields(text: Column) -> dict[str, Column]:
    """Of the new paper layout: plate, RENAVAM (any number of 9 to 11 digits) and chassis by their shape, years, owner between NOME and CPF."""
    up = T.normalize_vehicle_text(text)
    made, model = dates.anchored_year_pair(up)
    return {"placa": _first(up, r"\b([A-Z]{3}\d[A-Z0-9]\d{2})\b"), "renavam": _first(up, r"\b(\d{9,11})\b"), "chassi": _first(up, r"\b([A-HJ-NPR-Z0-9]{17})\b"),
            "ano_fabricacao": made, "ano_modelo": model, "proprietario": _first(up, r"\bNOME\b\s+([A-Z ]{5,})\s+\bCPF\b")}


def extract_vehicle_document(texts: DataFrame) -> DataFrame:
    """``vehicle_fields`` of each text."""
    return _fields(texts, vehicle_fields)


def legacy_fields(text: Column) -> dict[str, Column]:
    """Of the old paper layout, each by the first reading that gives anything.

    Plate: as printed; its seven glyphs with anything between them and confused ones swapped; three letters and
    four more in the text without separators; any window of that. RENAVAM and chassis: as printed, then in
    the text without separators. Years: the first two.
    """
    up, packed = T.normalize_vehicle_text(text), T.compact_alnum(text)
    gap = "[^A-Z0-9]*"
    spaced = gap.join(["([A-Z0-9])"] * 3 + ["([0-9OILSB])"] * 4)
    apart = F.concat(*(F.regexp_extract(up, spaced, i) for i in range(1, 8)))
    plate = F.coalesce(_first(up, r"\b([A-Z]{3}\d{4})\b"), ids.fix_plate_ocr(apart), ids.fix_plate_ocr(F.regexp_extract(packed, "([A-Z]{3}[A-Z0-9]{4})", 1)), ids.first_plate_window(packed))
    years = F.regexp_extract_all(up, F.lit(r"\b((?:19|20)\d{2})\b"), 1)
    first, second = (F.get(years, F.lit(i)).try_cast("int") for i in (0, 1))
    return {"placa": plate, "renavam": F.coalesce(_first(up, r"\b(\d{9,11})\b"), _first(T.only_digits(text), r"(\d{9,11})")),
            "chassi": F.coalesce(_first(up, r"\b([A-Z0-9]{17})\b"), _first(packed, r"([A-Z0-9]{17})")), "ano_fabricacao": first, "ano_modelo": F.coalesce(second, first)}


def extract_vehicle_document_legacy(texts: DataFrame) -> DataFrame:
    """``legacy_fields`` of each text."""
    return _fields(texts, legacy_fields)


def routed_vehicle_fields(text: Column) -> dict[str, Column]:
    """The new layout's fields where any of plate, RENAVAM or chassis is found, else the old layout's (which has no owner)."""
    new, old = vehicle_fields(text), legacy_fields(text)
    found = F.coalesce(new["placa"], new["renavam"], new["chassi"]).isNotNull()
    return {"layout": F.when(found, F.lit("new")).otherwise(F.lit("legacy")), **{k: F.when(found, v).otherwise(old.get(k, F.lit(None))) for k, v in new.items()}}


def route_vehicle_document(texts: DataFrame) -> DataFrame:
    """``routed_vehicle_fields`` of each text."""
    return _fields(texts, routed_vehicle_fields)


#: Sections of a transfer.
SELLER, BUYER = ("DADOS DO VENDEDOR", "IDENTIFICAÇÃO DO VENDEDOR", "IDENTIFICACAO DO VENDEDOR"), ("DADOS DO COMPRADOR", "IDENTIFICAÇÃO DO COMPRADOR", "IDENTIFICACAO DO COMPRADOR")
TAX_ID = r"(?<!\d)(\d{3}\.?\d{3}\.?\d{3}-?\d{2}|\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})(?!\d)"


def anchored_renavam(lines: Column) -> Column:
    """RENAVAM on a line with that word, or alone on the next line; only with a valid check digit."""
    def value(x: Column, below: Column) -> Column:
        pure = F.length(F.trim(F.regexp_replace(below, r"[0-9\s.\-]", ""))) <= 1
        tries = [ids.normalize_renavam(x), F.when(pure, ids.normalize_renavam(below))]
        return F.when(x.rlike(r"(?i)\bRENAVAM\b"), F.coalesce(*(F.when(ids.is_valid_renavam(t), t) for t in tries)))

    return L.first_of(lines, value)


def transfer_fields(text: Column) -> dict[str, Column]:
    """Plate, chassis, price, RENAVAM (anchored, with a valid check digit), and both parties from their sections."""
    lines, up = L.lines_of(text), F.upper(T.text(text))
    buyer, seller = L.array_slice(lines, BUYER), L.array_slice(lines, SELLER, BUYER)
    g = lambda rx: F.nullif(F.regexp_extract(up, rx, 1), F.lit(""))
    number = lambda block: L.first_of(block, lambda x, _: F.nullif(F.regexp_extract(x, TAX_ID, 1), F.lit("")))
    return {
        "placa": F.regexp_replace(g(r"\b([A-Z]{3}-?[0-9][A-Z0-9][0-9]{2})\b"), "-", ""), "chassi": g(r"\b([A-HJ-NPR-Z0-9]{17})\b"), "renavam": anchored_renavam(lines), "valor": money.money_on_label_line(lines, "VALOR"),
        "comprador_nome": T.sanitize_name(L.array_colon_value(buyer, "NOME")), "comprador_cpf_cnpj": T.normalize_doc_id(number(buyer)),
        "vendedor_nome": T.sanitize_name(L.array_colon_value(seller, "NOME")), "vendedor_cpf_cnpj": T.normalize_doc_id(number(seller)),
    }


def extract_transfer(texts: DataFrame) -> DataFrame:
    """``transfer_fields`` of each text."""
    return _fields(texts, transfer_fields)


REAIS = r"R\$\s*(?:\d{1,3}(?:\.\d{3})*|\d+),\d{2}"


def lien_status(blob: Column) -> Column:
    """ausente, inativa, desconhecida or null; a text alone never proves an active lien."""
    up = F.upper(T.text(blob))
    return (F.when(up.contains("SEM GRAVAME"), F.lit("ausente")).when(up.contains("BAIXA") & up.contains("ALIENA"), F.lit("inativa"))
            .when(up.contains("ALIENA") | up.contains("GRAVAME"), F.lit("desconhecida")))


#: What denies and what mentions a restriction.
NO_RESTRICTION = ("NENHUMA RESTRIÇÃO CADASTRADA", "NENHUMA RESTRIÇÃO REGISTRADA", "SEM RESTRIÇÃO", "SEM RESTRICOES")
RESTRICTION = ("RESTRIÇÃO", "RESTRICAO", "BLOQUEIO", "IMPEDIMENTO")


def admin_restriction(blob: Column) -> Column:
    """False if restrictions are denied, true if any is mentioned, else null."""
    up = F.upper(T.text(blob))
    return F.when(_any(up, NO_RESTRICTION), F.lit(False)).when(_any(up, RESTRICTION), F.lit(True))


def tax_overdue(blob: Column) -> Column:
    """True for a tax debt with an amount, false where IPVA has none, else null."""
    up = F.upper(T.text(blob))
    late = _any(up, ("DÍVIDA ATIVA", "DIVIDA ATIVA")) | (up.contains("IPVA") & _any(up, ("EM ATRASO", "EM ABERTO", "NOTIFICADO")))
    return F.when(late, F.when(up.rlike(REAIS), F.lit(True))).when(up.contains("IPVA") & up.contains("NENHUM"), F.lit(False))


def open_items(block: Column, noun: str) -> Column:
    """False if the block says there is no such item, true if it holds an amount, else null."""
    up = F.upper(T.text(block))
    return F.when(up.contains("NENHUM") & up.contains(noun), F.lit(False)).when(up.rlike(REAIS), F.lit(True))


def owner_name(lines: Column) -> Column:
    """What follows 'Nome do proprietário atual' (on its line or below), or 'Proprietário:'."""
    def value(x: Column, below: Column) -> Column:
        up, tail = F.upper(x), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
        named = up.contains("NOME DO PROPRIET") & up.contains("ATUAL")
        return F.coalesce(F.when(named, F.when((tail != "") & (F.upper(tail) != up), tail).otherwise(below)), F.when(up.contains("PROPRIET") & x.contains(":"), tail))

    return L.first_of(lines, value)


#: Labels of the text blocks of a registry lookup, tried in order.
BLOCKS = {
    "situacao_texto": ("SITUAÇÃO", "SITUACAO"), "debitos_texto": ("DÉBITOS", "DEBITOS", "LISTAGEM DE DÉBITOS", "LISTAGEM DE DEBITOS"), "multas_texto": ("MULTAS", "LISTAGEM DE MULTAS"),
    "restricoes_texto": ("RESTRIÇÕES", "RESTRICOES"), "restricao_venda_texto": ("RESTRIÇÃO À VENDA", "RESTRICAO A VENDA"),
}


def extract_registry_lookup(texts: DataFrame, mode: str | None = None) -> DataFrame:
    """Owner, vehicle, text blocks, derived flags and totals of a registry lookup.

    mode: 'aberta' or 'despachante' as the user knows it; None: open where the owner's name is masked.
    An open lookup's name counts as masked.
    """
    return texts.select("doc_id", lookup_struct(F.col("text"), mode).alias("x")).select("doc_id", "x.*")


def lookup_struct(text: Column, mode: str | None = None) -> Column:
    """Fields of a lookup as one struct. It is bound in steps, so that lines, owner and blocks are made once: each step is the element of an array of one."""
    def let(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), then), F.lit(0))

    kept = F.filter(L.lines_of(text), lambda x: ~x.rlike(L.REGISTRY_NOISE))
    return let({"lines": kept}, lambda s: let({"lines": s["lines"], "blob": F.array_join(s["lines"], "\n"), "owner": owner_name(s["lines"]), **{k: L.array_block_after(s["lines"], *v) for k, v in BLOCKS.items()}},
                                              lambda x: F.struct(*(v.alias(k) for k, v in _looked_up(x, mode).items()))))


#: Names of the fields of a lookup in order.
_LOOKED_UP = ("proprietario_nome", "proprietario_nome_ofuscado", "proprietario_iniciais", "proprietario_iniciais_tokens", "proprietario_doc", "proprietario_doc_ofuscado", "placa", "renavam", "chassi", "marca_modelo", "cor", "ano_fabricacao", "ano_modelo",
              *BLOCKS, "alienacao_fiduciaria_status", "restricao_administrativa_ativa", "ipva_em_atraso", "debitos_em_aberto", "multas_em_aberto", "debitos_total_cents", "multas_total_cents", "modo")


def _looked_up(x: Column, mode: str | None) -> dict[str, Column]:
    lines, blob, owner = x["lines"], x["blob"], x["owner"]
    up = F.upper(blob)
    g = lambda rx: F.nullif(F.regexp_extract(up, rx, 1), F.lit(""))
    how = F.lit(mode) if mode in ("aberta", "despachante") else F.when(T.is_masked_name(owner), F.lit("aberta")).otherwise(F.lit("despachante"))
    masked = T.is_masked_name(owner) | (how == "aberta")
    initials = F.when(masked, T.masked_name_initials(owner)).otherwise(F.array().cast("array<string>"))
    doc = L.first_of(lines, lambda v, _: F.nullif(F.regexp_extract(v, r"\b(\d{3}\.?\d{3}\.?\d{3}-?\d{2}|\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}|\d{3}\*{3,}\d{2}|\d{2}\*{3,}\d{2})\b", 1), F.lit("")))
    years = L.first_of(lines, lambda v, _: F.when(F.upper(v).rlike("FABRICA|ANO") & v.rlike(r"\b(19\d{2}|20\d{2})\b"), v))
    found = F.regexp_extract_all(years, F.lit(r"\b(19\d{2}|20\d{2})\b"), 1)
    after = lambda label: L.array_value_after(lines, label)
    return dict(zip(_LOOKED_UP, (
        owner, masked, F.nullif(F.array_join(initials, ""), F.lit("")), initials, doc, doc.contains("*"), g(r"\b([A-Z]{3}[0-9][A-Z0-9][0-9]{2})\b"), g(r"\b(\d{11})\b"), after("CHASSI"), after("MARCA"), after("COR"),
        F.get(found, F.lit(0)), F.coalesce(F.get(found, F.lit(1)), F.get(found, F.lit(0))), *(x[k] for k in BLOCKS),
        lien_status(blob), admin_restriction(blob), tax_overdue(blob), open_items(x["debitos_texto"], "DÉBITO"), open_items(x["multas_texto"], "MULTA"),
        money.sum_currency_cents(x["debitos_texto"]), money.sum_currency_cents(x["multas_texto"]), how,
    ), strict=True))


#: Fields of each document type over its text, as columns by name or as one struct; users may register their own types.
EXTRACTORS: dict[str, Callable[[Column], dict[str, Column] | Column]] = {
    "proposal": proposal_fields, "licence": licence_fields, "licence_registry": licence_registry_fields, "payslip": payslip_fields, "payroll": payslip_fields,
    "residence_proof": residence_fields, "vehicle_certificate": certificate_fields, "vehicle_document": routed_vehicle_fields, "vehicle_document_new": vehicle_fields,
    "vehicle_document_old": legacy_fields, "transfer": transfer_fields, "registry_lookup": lookup_struct,
}
STATEMENT = "bank_statement"


def extract_all(texts: DataFrame, extractors: dict[str, Callable[[Column], dict[str, Column] | Column]] | None = None, strategies=None) -> DataFrame:
    """doc_id, doc_type and data (VARIANT) of every text whose doc_type has a job, bank statements among them: one scan.

    One projection reads each text by its own type's job. Statements need windows over their lines:
    these are made in the same projection, and what moves to them is lines and extracted data, not texts.
    Repeated ids are extracted each by itself. Needs doc_id, doc_type and text.
    """
    jobs = extractors or EXTRACTORS
    data = F.lit(None).cast("string")
    for kind, fields in jobs.items():
        made = fields(F.col("text"))
        made = F.struct(*(c.alias(k) for k, c in made.items())) if isinstance(made, dict) else made
        data = F.when(F.col("doc_type") == kind, F.to_json(made)).otherwise(data)
    wanted = texts.where(F.col("doc_type").isin(*jobs, STATEMENT))
    is_statement = F.col("doc_type") == STATEMENT
    rows = wanted.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "doc_type", data.alias("done"),
        F.when(is_statement, F.struct(T.detect_bank("text").alias("banco"), F.upper(T.text("text")).contains("PIX").alias("tem_pix"))).alias("head"),
        F.when(is_statement, statements.tidy_lines("text")).alias("lines"))
    read = statements.statement_data(rows, strategies)
    return read.select("doc_id", "doc_type", F.parse_json("done").alias("data"))
