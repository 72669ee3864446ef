"""Table jobs: normalised parties, audited identifiers, amounts, dates, matched names, masked columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verifold.functions import dates, ids, money
from verifold.functions import text as T


def normalize_parties(df: DataFrame) -> DataFrame:
    """Adds normalised columns. Needs name, doc_number, address, city_state."""
    city, state = T.split_city_state("city_state")
    return df.withColumns({
        "name_normalized": T.normalize_name("name"), "name_sanitized": T.sanitize_name("name"), "name_clean": T.clean_human_name("name"),
        "name_tokens": T.name_tokens("name"), "doc_normalized": T.normalize_doc_id("doc_number"), "address_clean": T.clean_address("address"), "city": city, "state": state,
    })


def audit_ids(df: DataFrame) -> DataFrame:
    """doc_type, id kind, total, present, valid and a count for each CPF reason. Needs doc_type, cpf, cnpj, renavam, plate, vin.

    Counts are summed before the shuffle; there is one row a type and kind.
    """
    reason = ids.cpf_check_reason("cpf")
    kinds = {"cpf": (reason == "ok", reason), "cnpj": (ids.is_valid_cnpj("cnpj"), None), "renavam": (ids.is_valid_renavam("renavam"), None), "plate": (ids.is_valid_plate("plate"), None), "vin": (ids.is_valid_vin("vin"), None)}
    rows = df.select("doc_type", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), (T.text(k) != "").alias("present"), ok.alias("valid"), (r if r is not None else F.lit(None).cast("string")).alias("reason")) for k, (ok, r) in kinds.items()))))
    reasons = [F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("bad_length", "all_equal", "dv_mismatch")]
    return rows.groupBy("doc_type", "kind").agg(F.count("*").alias("n"), F.count_if("present").alias("n_present"), F.count_if("valid").alias("n_valid"), *reasons)


GRAMMARS = {"any": money.parse_money_any, "br": money.parse_money_br, "reais": money.parse_money_reais, "signed": money.parse_signed_amount}


def normalize_amounts(df: DataFrame) -> DataFrame:
    """Adds reais by each grammar and cents. Needs amount."""
    return df.withColumns({f"amount_{k}": f("amount") for k, f in GRAMMARS.items()} | {"amount_cents": money.money_to_cents("amount")})


def amount_audit(df: DataFrame) -> DataFrame:
    """Share of amounts that no grammar reads, by doc_type."""
    n = normalize_amounts(df)
    return n.groupBy("doc_type").agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(f"amount_{k}").isNull().cast("int")), 6).alias(f"unread_{k}") for k in GRAMMARS))


def normalize_dates(df: DataFrame, today: Column) -> DataFrame:
    """Adds date, text form, days to expiry and expiry bucket. Needs date_text."""
    d = dates.parse_date("date_text")
    days = dates.days_to_expire(d, today)
    bucket = F.when(d.isNull(), F.lit("unknown")).when(days < 0, F.lit("expired")).when(days <= 30, F.lit("month")).when(days <= 365, F.lit("year")).otherwise(F.lit("later"))
    return df.withColumns({"date_value": d, "date_shown": dates.normalize_date_string("date_text"), "days_to_expire": days, "expiry_bucket": bucket})


def match_names(pairs: DataFrame) -> DataFrame:
    """Adds verdicts for each pair. Needs name_a, name_b."""
    return pairs.withColumns({
        "exact": T.normalize_name("name_a") == T.normalize_name("name_b"), "tolerant": T.name_match_tolerant("name_a", "name_b"),
        "two_tokens": T.name_match_two_tokens("name_a", "name_b"), "jaccard": F.round(T.name_jaccard("name_a", "name_b"), 6),
        "initials": T.initials_match(F.array_join(T.name_initials("name_a"), ""), "name_b"),
    })


def mask_personal_data(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Same table with masked columns; kinds: column to doc, renavam, last4 or a display kind."""
    how = {"doc": T.mask_doc, "renavam": T.mask_renavam, "last4": T.mask_last4}
    return df.withColumns({c: how[k](c) if k in how else T.mask_for_display(F.lit(k), F.col(c)) for c, k in kinds.items()})


#: Fields that may be shown of each type, in order.
WHITELIST = {"proposal": ("proposta", "nome_financiado", "cpf", "data_nascimento", "uf", "salario", "outras_rendas", "renda_total"), "licence": ("nome", "cpf", "categoria", "validade", "data_nascimento"), "payslip": ("nome", "empregador", "total_vencimentos")}


def project_whitelist(df: DataFrame) -> DataFrame:
    """shown: map of the whitelisted fields that are present, masked. Needs doc_type and fields (map of strings).

    renda_total appears only if salario and outras_rendas are both plain numbers.
    """
    a, b = (F.element_at("fields", F.lit(k)).try_cast("double") for k in ("salario", "outras_rendas"))
    fields = F.when((F.col("doc_type") == "proposal") & a.isNotNull() & b.isNotNull(), F.map_concat("fields", F.create_map(F.lit("renda_total"), (a + b).cast("string")))).otherwise(F.col("fields"))
    allowed = F.array().cast("array<string>")
    for t, names in WHITELIST.items():
        allowed = F.when(F.col("doc_type") == t, F.array(*map(F.lit, names))).otherwise(allowed)
    kept = F.filter(allowed, lambda k: F.array_contains(F.map_keys(fields), k))
    return df.withColumn("shown", F.map_from_arrays(kept, F.transform(kept, lambda k: T.mask_for_display(k, F.element_at(fields, k)))))


#: Fields each type must have.
REQUIRED_FIELDS = {
    "cnh": ("nome", "cpf", "data_nascimento", "validade"), "proposta": ("proposta", "nome_financiado", "cpf", "data_nascimento"), "residencia": ("nome_titular", "endereco", "cep", "cidade", "uf", "vencimento"),
    "holerite": ("nome", "empregador", "data_admissao", "total_vencimentos"), "extrato": ("titular", "agencia", "conta", "periodo_inicio", "periodo_fim", "lancamentos"),
}


def required_fields_for(doc_type: Column) -> Column:
    out = F.array().cast("array<string>")
    for t, names in REQUIRED_FIELDS.items():
        out = F.when(doc_type == t, F.array(*map(F.lit, names))).otherwise(out)
    return out
