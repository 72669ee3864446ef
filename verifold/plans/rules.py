"""Verification rules. Each family turns one wide row a case into checks, without any further shuffle.

A wide row (``wide_cases``) has the latest data of each document type as VARIANT and the array
``present``. A check is (check_id, status, message, evidence). Every ``when`` chain ends in an
explicit branch for null.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verifold.functions import dates, ids, money
from verifold.functions import text as T

#: Public names and the types that stored documents may carry.
TYPES = ("proposal", "licence", "licence_registry", "payslip", "payroll", "bank_statement", "transfer", "vehicle_certificate", "vehicle_document_new", "vehicle_document_old", "vehicle_document", "registry_lookup", "registry_query", "registry")
VEHICLE = ("vehicle_certificate", "vehicle_document_new", "vehicle_document_old", "vehicle_document")
REGISTRY = ("registry_lookup", "registry_query", "registry")
#: Type names as the documents' producers write them.
ALIASES = {"proposta_daycoval": "proposal", "cnh": "licence", "cnh_senatran": "licence_registry", "holerite": "payslip", "folha_pagamento": "payroll", "extrato_bancario": "bank_statement", "atpv": "transfer", "crlv_e": "vehicle_certificate", "documento_veiculo_novo": "vehicle_document_new", "documento_veiculo_antigo": "vehicle_document_old", "documento_veiculo": "vehicle_document", "detran_sc": "registry_lookup", "consulta_detran": "registry_query", "detran": "registry"}
CHECK = "array<struct<check_id:string,status:string,message:string,evidence:map<string,string>>>"


def public_type(c: Column) -> Column:
    out = c
    for k, v in ALIASES.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def wide_cases(store: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """One row a case with the latest data of every type, the types present, and path and number of documents of each type.

    vehicle and registry are the first present of their types. Needs case_id, doc_type, file_name, path and data;
    a row with n_docs stands for so many documents. cases: case_id of all cases that get a row, those without any document too.
    """
    number = F.sum("n_docs") if "n_docs" in store.columns else F.count("*")
    latest = store.withColumn("doc_type", public_type(F.col("doc_type"))).groupBy("case_id", "doc_type").agg(
        F.max_by(F.struct("path", "data"), "file_name").alias("x"), number.alias("n"))
    listed = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_type", c))))
    # Documents of one case and type are reduced before anything moves; what meets by case is a row a type.
    wide = latest.groupBy("case_id").agg(*(F.first(F.when(F.col("doc_type") == t, F.col("x.data")), ignorenulls=True).alias(t) for t in TYPES),
                                           F.collect_set("doc_type").alias("present"), listed(T.sanitize_path("x.path")).alias("inputs"), listed(F.col("n")).alias("counts"))
    if cases is not None:
        empty = {"present": F.array().cast("array<string>"), "inputs": F.create_map().cast("map<string,string>"), "counts": F.create_map().cast("map<string,bigint>")}
        wide = cases.select("case_id").distinct().join(wide, "case_id", "left").withColumns({c: F.coalesce(c, none) for c, none in empty.items()})
    for name, types in (("vehicle", VEHICLE), ("registry_any", REGISTRY)):
        kind, data = F.lit(None).cast("string"), F.lit(None).cast("variant")
        for t in reversed(types):
            kind, data = F.when(_has(t), F.lit(t)).otherwise(kind), F.when(_has(t), F.col(t)).otherwise(data)
        wide = wide.withColumns({f"{name}_type": kind, f"{name}_data": data})
    return wide


def _has(t: str) -> Column:
    return F.array_contains("present", t)


#: While ``planned`` builds its rules: the columns they ask for, by level and name.
_ASKED: ContextVar[dict[int, dict[str, Column]] | None] = ContextVar("asked", default=None)


def let(name: str, value: Column, level: int = 1) -> Column:
    """A value that rules use more than once: computed in a projection below them where ``planned`` builds them.

    A value of one level may use those of lower levels; level 0 is read from documents.
    """
    asked = _ASKED.get()
    if asked is None:
        return value
    asked.setdefault(level, {})[name] = value
    return F.col(name)


def planned(wide: DataFrame, build: Callable[[], Column]) -> tuple[DataFrame, Column]:
    """Wide rows with the columns that ``build`` asks for, and what it builds."""
    token = _ASKED.set({})
    try:
        made, asked = build(), _ASKED.get()
    finally:
        _ASKED.reset(token)
    for level in sorted(asked):
        wide = wide.select("*", *(c.alias(n) for n, c in asked[level].items()))
    return wide, made


def asked_fields(build: Callable[[], Column]) -> dict[str, set[str]]:
    """Names that rules read, by the type or alias they read them from."""
    token = _ASKED.set({})
    try:
        build()
        asked = _ASKED.get()
    finally:
        _ASKED.reset(token)
    out: dict[str, set[str]] = {}
    for key in asked.get(0, {}):
        _, t, name, _ = key.split("__")
        out.setdefault(t, set()).add(name.split(".")[0])
    return out


def only_asked(store: DataFrame, build: Callable[[], Column]) -> DataFrame:
    """A store whose data holds just the fields that rules read: from shredded VARIANT only these columns are scanned, and less is shuffled.

    For rules that read through ``field`` and its kin.
    """
    asked = asked_fields(build)
    mine = {t: set(asked.get(t, ())) for t in TYPES}
    for alias, types in (("vehicle_data", VEHICLE), ("registry_any_data", REGISTRY)):
        for t in types:
            mine[t] |= asked.get(alias, set())
    kind, data = public_type(F.col("doc_type")), F.lit(None).cast("variant")
    for t, names in mine.items():
        if names:
            kept = F.to_variant_object(F.struct(*(F.try_variant_get("data", f"$.{n}", "variant").alias(n) for n in sorted(names))))
            data = F.when(kind == t, kept).otherwise(data)
    return store.withColumn("data", F.when(F.col("data").isNotNull(), data))


def raw(t: str, name: str, as_type: str = "string") -> Column:
    """One field of a document, as it is."""
    return let(f"v__{t}__{name}__{as_type}", F.try_variant_get(F.col(t), f"$.{name}", as_type), 0)


def field(t: str, *names: str, as_type: str = "string") -> Column:
    """First of the fields that is neither null nor empty."""
    got = [raw(t, n, as_type) for n in names]
    return T.first_non_empty(*got) if as_type == "string" else F.coalesce(*got)


def truthy(t: str, *names: str) -> Column:
    """First field that is not null, empty or a zero number (a zero given as text counts)."""
    def one(n: str) -> Column:
        value = raw(t, n)
        kind = F.schema_of_variant(raw(t, n, "variant"))
        return F.when((value != "") & ~((kind != "STRING") & (value.try_cast("double") == 0)), value)

    return F.coalesce(*map(one, names))


def check(check_id: str, status: Column, message: Column | str, **evidence: Column | str) -> Column:
    """One check; evidence values that are null stay out."""
    pairs = F.create_map(*(x for k, v in evidence.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string")))) if evidence else F.create_map().cast("map<string,string>")
    kept = F.map_filter(pairs, lambda k, v: v.isNotNull()) if evidence else pairs
    return F.struct(F.lit(check_id).alias("check_id"), status.alias("status"), (message if isinstance(message, Column) else F.lit(message)).alias("message"), kept.alias("evidence"))


def _names(**flags: Column) -> Column:
    return F.array_join(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())), lambda x: x.isNotNull()), ",")


def _status(*branches: tuple[Column, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for cond, s in reversed(branches):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(s)).otherwise(out)
    return out


def declared_income() -> Column:
    return money.null_safe_add(*(money.parse_money_any(field("proposal", f)) for f in ("salario", "outras_rendas")))


def proven_income() -> Column:
    payslip = money.parse_money_any(truthy("payslip", "total_vencimentos", "salario_liquido"))
    keys = ("renda_apurada", "renda_recorrente", "creditos_validos_total", "creditos_recorrentes_total")
    return F.coalesce(payslip, *(money.parse_money_any(field("bank_statement", k)) for k in keys))


def identity_check(row=None) -> Column:
    """Proposal against licence: name and birth date as upper-case strings."""
    upper = lambda c: F.nullif(F.upper(F.trim(T.text(c))), F.lit(""))
    pn, ln = upper(field("proposal", "nome_financiado", "nome")), upper(field("licence", "nome"))
    pb, lb = upper(field("proposal", "data_nascimento")), upper(field("licence", "data_nascimento"))
    docs = _has("proposal") & _has("licence")
    fields = pn.isNotNull() & ln.isNotNull() & pb.isNotNull() & lb.isNotNull()
    status = _status((~docs, "MISSING"), (~fields, "MISSING"), ((pn == ln) & (pb == lb), "OK"), otherwise="WARN")
    return F.array(check("identity.proposta_vs_cnh", status, F.when(status == "OK", F.lit("OK")).when(status == "WARN", F.lit("Divergences found")).otherwise(F.lit("Missing documents or fields")),
                         fields_compared=F.when(docs & fields, F.lit("nome,data_nascimento")), diffs=F.when(docs & fields, _names(nome=pn != ln, data_nascimento=pb != lb)),
                         missing=F.when(~docs, _names(proposal=~_has("proposal"), licence=~_has("licence"))),
                         missing_fields=F.when(docs & ~fields, F.array_join(F.filter(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in (("proposal.nome", pn), ("proposal.data_nascimento", pb), ("licence.nome", ln), ("licence.data_nascimento", lb)))), lambda x: x.isNotNull()), ","))))


def income_checks() -> Column:
    declared, proven = let("l__declared", declared_income()), let("l__proven", proven_income())
    none = ~_has("payslip") & ~_has("bank_statement")
    proof = _names(payslip=_has("payslip"), bank_statement=_has("bank_statement"))
    least = _status((none, "MISSING"), (proven.isNull(), "WARN"), (declared.isNull(), "OK"), (proven > 0, "OK"), otherwise="WARN")
    proved = _status((none, "MISSING"), (proven.isNull(), "WARN"), otherwise="OK")
    total = _status((declared.isNull(), "MISSING"), (none, "MISSING"), (proven.isNull(), "WARN"), (proven >= declared * 0.95, "OK"), otherwise="WARN")
    shown = lambda c: F.round(c, 2)
    return F.array(
        check("income.declared_vs_proven.minimum", least, "Some evidence of income", declared=shown(declared), proven=shown(proven), proof_docs=proof),
        check("income.declared_vs_proven.proof", proved, "Proof of income can be read", proven=shown(proven), proof_docs=proof),
        check("income.declared_vs_proven.total", total, "Declared income is supported", declared=shown(declared), proven=shown(proven), proof_docs=proof),
    )


def licence_registry_checks() -> Column:
    """Only for cases with a licence registry document."""
    match = T.name_match_tolerant(field("proposal", "nome_financiado", "nome"), field("licence_registry", "nome"))
    a, b = T.only_digits_or_null(field("proposal", "cpf")), T.only_digits_or_null(field("licence_registry", "cpf"))
    expiry, category = field("licence_registry", "validade"), T.null_if_blank(field("licence_registry", "categoria"))
    made = F.array(
        check("identity.proposta_vs_cnh_senatran.nome", _status((match.isNull(), "MISSING"), (match, "OK"), otherwise="WARN"), "Names of proposal and registry"),
        check("identity.proposta_vs_cnh_senatran.cpf", _status((a.isNull() | b.isNull(), "MISSING"), (a == b, "OK"), otherwise="WARN"), "CPF of proposal and registry", proposal=T.mask_doc(a), registry=T.mask_doc(b)),
        check("identity.cnh_senatran.validade", _status((F.trim(T.text(expiry)) == "", "MISSING"), (dates.parse_date(expiry).isNotNull(), "OK"), otherwise="WARN"), "Expiry can be read"),
        check("identity.cnh_senatran.categoria", _status((category.isNull(), "MISSING"), otherwise="OK"), "Category is present"),
    )
    return F.when(_has("licence_registry"), made).otherwise(F.array().cast(CHECK))


def transfer_checks() -> Column:
    """Only for cases with a transfer authorisation."""
    f = lambda *n: field("transfer", *n)
    needed = ("placa", "chassi", "valor_venda", "comprador_cpf_cnpj", "comprador_nome")
    lacking = let("l__lacking", _names(**{n: raw("transfer", n).isNull() | (raw("transfer", n) == "") for n in needed}))
    buyer = let("l__buyer", T.normalize_doc_id(f("comprador_cpf_cnpj")))
    proposer = let("l__proposer", T.normalize_doc_id(field("proposal", "cpf", "cpf_financiado", "cpf_cliente", "cpf_titular", "cpf_cnpj", "documento", "documento_numero")))
    names = T.name_match_two_tokens(f("comprador_nome"), field("proposal", "nome_financiado", "nome", "nome_cliente", "cliente_nome", "nome_titular"))
    number = f("renavam")
    own, own_ok = let("l__own", ids.normalize_renavam(number)), let("l__own_ok", ids.is_valid_renavam(number))
    vehicle = let("l__vehicle", ids.normalize_renavam(field("vehicle_data", "renavam")))
    vehicle_ok = let("l__vehicle_ok", F.col("vehicle_type").isNotNull() & ids.is_valid_renavam(vehicle), 2)
    seller = let("l__seller", T.normalize_doc_id(f("vendedor_cpf_cnpj")))
    owner = let("l__owner", F.coalesce(*(F.nullif(T.normalize_doc_id(field("vehicle_data", n)), F.lit("")) for n in ("proprietario_doc", "proprietario_documento", "cpf_proprietario", "cnpj_proprietario", "cpf", "cnpj")), F.lit("")))
    both = ids.is_valid_tax_id(owner) & ids.is_valid_tax_id(seller)
    ok = F.lit("OK")
    made = [
        check("vehicle.atpv.present", ok, "Transfer is present"),
        check("vehicle.atpv.parse.required_fields", _status((lacking == "", "OK"), otherwise="WARN"), "Required fields of the transfer", missing=F.nullif(lacking, F.lit(""))),
        F.when(buyer != "", check("vehicle.atpv.comprador_doc.dv", _status((ids.is_valid_tax_id(buyer), "OK"), otherwise="WARN"), "Check digits of the buyer", buyer=T.mask_doc(buyer))),
        check("vehicle.atpv.renavam.conditional", _status((number.isNull(), "OK"), (own_ok, "OK"), otherwise="WARN"), "RENAVAM of the transfer, if there is one", present=number.isNotNull()),
        check("vehicle.atpv.comprador.matches_proposta", _status(((buyer != "") & (proposer != "") & (buyer == proposer), "OK"), (((buyer == "") | (proposer == "")) & names, "OK"), otherwise="WARN"), "Buyer is the proposer", transfer=T.mask_doc(buyer), proposal=T.mask_doc(proposer)),
        check("vehicle.atpv.vendedor.informativo", ok, "Seller is for information"),
        check("vehicle.atpv.renavam.required_if_supported", _status((F.col("vehicle_type").isNull(), "OK"), (~vehicle_ok, "WARN"), (own_ok, "OK"), otherwise="FAIL"), "RENAVAM is needed where the vehicle document has one", vehicle_type=F.col("vehicle_type"), vehicle=T.mask_renavam(vehicle)),
        check("vehicle.atpv.renavam.matches_vehicle_doc", _status((vehicle_ok & own_ok & (own != vehicle), "FAIL"), otherwise="OK"), "RENAVAM of transfer and vehicle document", transfer=T.mask_renavam(own), vehicle=T.mask_renavam(vehicle)),
        check("vehicle.atpv.vendedor.matches_vehicle_owner", _status((both & (owner != seller), "WARN"), otherwise="OK"), "Seller is the owner", seller=T.mask_doc(seller), owner=T.mask_doc(owner)),
        check("followup.atpv.renavam", ok, "RENAVAM binds only where a vehicle document supports it"),
        check("followup.atpv.vendedor", ok, "Seller is compared only where both numbers are valid"),
    ]
    return F.when(_has("transfer"), F.filter(F.array(*made), lambda x: x.isNotNull())).otherwise(F.array().cast(CHECK))


def registry_checks() -> Column:
    """Only for cases with a registry lookup."""
    g = lambda n, t: raw("registry_any_data", n, t)
    owner, seller = T.normalize_doc_id(g("proprietario_doc", "string")), T.normalize_doc_id(F.when(_has("transfer"), field("transfer", "vendedor_cpf_cnpj")))
    code, name = T.text(g("proprietario_iniciais", "string")), T.sanitize_name(F.when(_has("transfer"), field("transfer", "vendedor_nome")))
    owner_status = _status(((owner != "") & (seller != "") & (owner == seller), "OK"), ((owner != "") & (seller != ""), "FAIL"), ((code != "") & (name != "") & T.initials_match(code, name), "WARN"), otherwise="MISSING")
    flag = lambda n: _status((g(n, "boolean"), "FAIL"), (~g(n, "boolean"), "OK"), otherwise="WARN")
    lien = F.lower(F.trim(g("alienacao_fiduciaria_status", "string")))
    debts = g("debitos_total_cents", "bigint") + g("multas_total_cents", "bigint")
    keys = ("vlr_compra", "vlr_compra_reais", "vlr_compra_cents", "valor_compra", "valor_compra_reais", "valor_compra_cents", "vlr_molicar", "vlr_mercado")
    price_of = lambda n: F.when(T.text(field("proposal", n)) != "", money.int_or_text_to_cents(field("proposal", n), F.schema_of_variant(raw("proposal", n, "variant"))))
    chosen = F.coalesce(*(F.when(T.text(field("proposal", n)) != "", F.lit(i)) for i, n in enumerate(keys)))
    price = F.lit(None).cast("bigint")
    for i, n in enumerate(keys):
        price = F.when(chosen == i, price_of(n)).otherwise(price)
    last4 = lambda c: F.when(c != "", T.mask_last4(c))
    made = F.array(
        check("vehicle.detran.present", F.lit("OK"), "Registry lookup is present", doc_type=F.col("registry_any_type")),
        check("vehicle.detran.owner.matches_atpv_vendedor", owner_status, "Registered owner is the seller", owner=last4(owner), seller=last4(seller)),
        check("vehicle.detran.restricao_administrativa.absent", flag("restricao_administrativa_ativa"), "No administrative restriction"),
        check("vehicle.detran.alienacao_fiduciaria.inactive_or_absent", _status((lien == "ativa", "FAIL"), (lien.isin("inativa", "ausente"), "OK"), otherwise="WARN"), "No active lien", lien=lien),
        check("vehicle.detran.ipva.no_overdue", flag("ipva_em_atraso"), "No overdue tax"),
        check("vehicle.detran.debitos.total_vs_valor_compra", _status((debts.isNull() | price.isNull(), "MISSING"), (debts > price, "FAIL"), otherwise="OK"), "Debts are within the price", debts_cents=debts, price_cents=price),
    )
    return F.when(F.col("registry_any_type").isNotNull(), made).otherwise(F.array().cast(CHECK))


#: Rule families in report order. Users may pass their own list of functions without arguments.
FAMILIES: list[Callable[[], Column]] = [identity_check, income_checks, licence_registry_checks, transfer_checks, registry_checks]


def checks_of(wide: DataFrame, families: list[Callable[[], Column]] | None = None) -> DataFrame:
    """case_id, seq and check of all families: one projection of the wide rows, then one row a check."""
    rows, arrays = planned(wide, lambda: F.concat(*(f().cast(CHECK) for f in (families or FAMILIES))))
    rows = rows.select("case_id", F.posexplode(arrays).alias("seq", "x"))
    return rows.select("case_id", "seq", "x.check_id", "x.status", "x.message", "x.evidence")


# Standalone validators and reports


def validate_transfer(df: DataFrame) -> DataFrame:
    """errors and is_valid of each transfer.

    Needs placa, chassi, renavam, valor_venda, comprador_cpf_cnpj, comprador_nome, vendedor_cpf_cnpj and
    vendedor_nome as strings, or the other names of canonical_keys.
    """
    plate, vin, ren = ids.normalize_plate("placa"), ids.normalize_vin("chassi"), F.col("renavam")
    buyer, seller, price = T.only_digits("comprador_cpf_cnpj"), T.only_digits("vendedor_cpf_cnpj"), money.parse_money_reais("valor_venda")
    blank = lambda n: F.trim(T.text(n)) == ""
    required = ("placa", "renavam", "chassi", "valor_venda", "comprador_cpf_cnpj", "comprador_nome", "vendedor_nome")
    rules = [(f"missing_required:{n}", blank(n)) for n in required] + [
        ("invalid:placa_format", ~blank("placa") & ~ids.is_valid_plate(plate)),
        ("invalid:chassi_vin_format", ~blank("chassi") & ~ids.is_valid_vin(vin)),
        ("invalid:valor_venda_format", ~blank("valor_venda") & price.isNull()),
        ("invalid:valor_venda_nonpositive", price <= 0),
        ("invalid:comprador_nome", ~blank("comprador_nome") & ~T.is_human_name("comprador_nome")),
        ("invalid:vendedor_nome", ~blank("vendedor_nome") & ~T.is_human_name("vendedor_nome")),
        ("invalid:comprador_cpf", (F.length(buyer) == 11) & ~ids.is_valid_cpf(buyer)),
        ("invalid:comprador_cnpj", (F.length(buyer) == 14) & ~ids.is_valid_cnpj(buyer)),
        ("invalid:comprador_cpf_cnpj_len", ~blank("comprador_cpf_cnpj") & ~F.length(buyer).isin(11, 14)),
        ("invalid:renavam_len", ~blank("renavam") & ids.normalize_renavam(ren).isNull()),
        ("invalid:renavam_checkdigit", ~blank("renavam") & ids.normalize_renavam(ren).isNotNull() & ~ids.is_valid_renavam(ren)),
        ("invalid:renavam_is_cpf", ids.is_valid_cpf(ids.normalize_renavam(ren))),
        ("invalid:renavam_equals_comprador_doc", ids.normalize_renavam(ren) == buyer),
    ]
    errors = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules)), lambda x: x.isNotNull())
    return df.withColumns({"errors": errors, "normalized": F.struct(plate.alias("placa"), vin.alias("chassi"), ids.normalize_renavam(ren).alias("renavam"), price.alias("valor_venda"), buyer.alias("comprador"), seller.alias("vendedor"))}).withColumn("is_valid", F.size("errors") == 0)


def canonical_keys(df: DataFrame) -> DataFrame:
    """Fills comprador_cpf_cnpj, chassi and valor_venda from the other names a table may use."""
    def first(target: str, *others: str) -> Column:
        return T.first_non_empty(*(F.col(c) for c in (target, *others) if c in df.columns))

    names = {"comprador_cpf_cnpj": ("cpf", "cnpj"), "chassi": ("vin", "numero_chassi"), "valor_venda": ("valor_compra", "valor_transacao", "valor")}
    return df.withColumns({k: first(k, *v) for k, v in names.items() if any(c in df.columns for c in (k, *v))})


def payslip_soft_checks(df: DataFrame) -> DataFrame:
    """Adds cpf_reason and warnings; fields are never cleared. Needs cpf, nome, total_vencimentos."""
    reason = ids.cpf_check_reason("cpf")
    amount = money.parse_money_br("total_vencimentos")
    found = F.array(F.when(~reason.isin("ok", "empty"), F.concat(F.lit("cpf:"), reason)), F.when(T.null_if_blank("nome").isNull(), F.lit("nome:missing")), F.when(amount.isNull(), F.lit("total_vencimentos:missing")), F.when(amount <= 0, F.lit("total_vencimentos:not_positive")))
    return df.withColumns({"cpf_reason": reason, "warnings": F.filter(found, lambda x: x.isNotNull())})


def certificate_soft_checks(df: DataFrame) -> DataFrame:
    """Adds dv_ok, reason (ok, dv_mismatch, or invalid for anything but eleven digits) and warning of the RENAVAM of a vehicle certificate; one that is absent gives no warning."""
    whole = F.coalesce(F.col("renavam").rlike(r"^\d{11}$"), F.lit(False))
    reason = F.when(~whole, F.lit("invalid")).when(ids.is_valid_renavam("renavam"), F.lit("ok")).otherwise(F.lit("dv_mismatch"))
    return df.withColumns({"dv_ok": reason == "ok", "reason": reason, "warning": F.when((reason != "ok") & (T.text("renavam") != ""), F.concat(F.lit("renavam:"), reason))})


def licence_critique(df: DataFrame, today: Column) -> DataFrame:
    """Adds critiques: id length, state, odd dates. Needs cpf, uf, validade, data_nascimento."""
    shown = lambda c: F.when(F.trim(T.text(c)).rlike(r"^\d{2}/\d{2}/\d{4}$"), dates.parse_date(c))
    odd = dates.expiry_sanity(shown("validade"), shown("data_nascimento"), today)
    found = F.array(F.when((T.only_digits("cpf") != "") & (F.length(T.only_digits("cpf")) != 11), F.lit("cpf_length")), F.when((T.text("uf") != "") & ~F.upper(F.trim("uf")).isin(*T.STATES), F.lit("unknown_state")), F.when(shown("validade").isNull(), F.lit("expiry_missing")))
    return df.withColumn("critiques", F.concat(F.filter(found, lambda x: x.isNotNull()), odd))


def residence_critique(df: DataFrame) -> DataFrame:
    """Adds critiques of a residence proof: an unknown state. Needs uf."""
    state = F.upper(F.trim(T.text("uf")))
    return df.withColumn("critiques", F.filter(F.array(F.when((state != "") & ~state.isin(*T.STATES), F.lit("unknown_state"))), lambda x: x.isNotNull()))


def licence_validity_report(df: DataFrame, today: Column) -> DataFrame:
    """case_id, status (valid, expired, missing or unparseable) and days left. Needs case_id, validade."""
    d = dates.parse_date("validade")
    days = dates.days_to_expire(d, today)
    status = F.when(F.trim(T.text("validade")) == "", F.lit("missing")).when(d.isNull(), F.lit("unparseable")).when(days >= 0, F.lit("valid")).otherwise(F.lit("expired"))
    return df.select("case_id", status.alias("status"), days.alias("days_to_expire"))


def income_report(wide: DataFrame) -> DataFrame:
    """Declared and proven income summed over all sources, status and ratio."""
    declared = money.null_safe_add(*(money.parse_money_br(field("proposal", f)) for f in ("salario", "outras_rendas")))
    first = lambda t, *n: F.coalesce(*(money.parse_money_br(field(t, x)) for x in n))
    sources = {
        "payslip": first("payslip", "total_vencimentos"),
        "payroll": first("payroll", "remuneracao", "salario", "renda"),
        "bank_statement": first("bank_statement", "renda_apurada", "renda_recorrente", "creditos_recorrentes_total", "creditos_validos_total"),
    }
    proven = F.lit(None).cast("double")
    for v in sources.values():
        proven = money.null_safe_add(proven, v)
    rows = wide.select("case_id", declared.alias("declared"), *(v.alias(f"{k}_income") for k, v in sources.items()), proven.alias("proven"))
    status = F.when(F.col("declared").isNull(), F.lit("declared_missing")).when(F.col("proven").isNull(), F.lit("proven_missing")).when(F.col("proven") >= F.col("declared"), F.lit("compatible")).otherwise(F.lit("below_declared"))
    return rows.withColumns({"status": status, "ratio": F.try_divide("proven", "declared")})
