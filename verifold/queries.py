"""Registered queries of the verification engine, each over its whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verifold import casegen, probes
from verifold.functions import dates, ids, money
from verifold.functions import text as T
from verifold.operators import cases as C
from verifold.operators import lines as L
from verifold.operators import tables as N
from verifold.plans import extract, report, rules, statements
from verifold.sources.store import append_documents, append_variants, classify_read, document_envelope, file_inventory, list_documents, load_report_inputs, newest_documents, parse_outcome, read_listed, scan_document_store, scan_texts, shared_folder, write_reports
from verifold.sources.generations import compact, current, publish, vacuum
from verifold.streaming.intake import stream_intake

QUERIES: dict = {}
SQL: dict[str, str] = {}
TODAY = "2026-01-05"


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with SQL if given."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Intake log: events as documents of cases (user and day)


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("case_id"), F.col("event_type").alias("doc_type"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("file_name"), "value")


INTAKE = "intake AS (SELECT cast(user_id AS varchar) || '-' || strftime(ts, '%Y-%m-%d') AS case_id, event_type AS doc_type, lpad(cast(event_id AS varchar), 12, '0') AS file_name, value FROM events)"
NEEDED = ("signup", "purchase")


@query(f"WITH {INTAKE} SELECT case_id, doc_type, file_name, value FROM intake QUALIFY row_number() OVER (PARTITION BY case_id, doc_type ORDER BY file_name DESC) = 1")
def g1_latest_document(spark, sf_dir):
    return C.latest_document(intake(spark, sf_dir))


@query(f"WITH {INTAKE} SELECT case_id, doc_type, count(*) AS n_docs, max(file_name) AS latest_file FROM intake GROUP BY ALL")
def g2_presence_summary(spark, sf_dir):
    return C.presence_summary(intake(spark, sf_dir))


@query(f"WITH {INTAKE} SELECT case_id, CASE WHEN count(DISTINCT doc_type) FILTER (WHERE doc_type IN ('signup', 'purchase')) = 2 THEN 'PASS' ELSE 'FAIL' END AS gate FROM intake GROUP BY case_id")
def g3_gate_status(spark, sf_dir):
    return C.gate_status(intake(spark, sf_dir), NEEDED)


@query(f"WITH {INTAKE}, need AS (SELECT unnest(['signup', 'purchase']) AS missing) SELECT DISTINCT i.case_id, missing FROM intake i, need n WHERE NOT EXISTS (SELECT 1 FROM intake j WHERE j.case_id = i.case_id AND j.doc_type = n.missing)")
def k3_missing_required_docs(spark, sf_dir):
    return C.missing_required_docs(intake(spark, sf_dir), NEEDED)


@query(f"WITH {INTAKE} SELECT case_id, file_name FROM intake i WHERE EXISTS (SELECT 1 FROM intake j WHERE j.case_id = i.case_id AND j.doc_type = 'purchase')")
def k4_present_only(spark, sf_dir):
    i = intake(spark, sf_dir)
    return C.present_only(i, i, "purchase").select("case_id", "file_name")


@query(f"WITH {INTAKE} SELECT case_id, CASE min(CASE doc_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END) WHEN 0 THEN 'purchase' WHEN 1 THEN 'signup' ELSE 'click' END AS chosen_type FROM intake WHERE doc_type IN ('purchase', 'signup', 'click') GROUP BY case_id")
def k5_first_present_of(spark, sf_dir):
    return C.first_present_of(intake(spark, sf_dir), ("purchase", "signup", "click"))


@query(f"WITH {INTAKE}, f AS (SELECT case_id, doc_type || ':' || string_agg(file_name, ',' ORDER BY file_name) AS s, doc_type FROM intake GROUP BY case_id, doc_type) SELECT case_id, string_agg(s, ';' ORDER BY doc_type) AS listing FROM f GROUP BY case_id")
def w9_ordered_listing(spark, sf_dir):
    one = F.transform("listing", lambda x: F.concat(x["doc_type"], F.lit(":"), F.array_join(x["files"], ",")))
    return C.ordered_listing(intake(spark, sf_dir)).select("case_id", F.array_join(one, ";").alias("listing"))


STATUS = "CASE WHEN value IS NULL THEN NULL WHEN value < 20 THEN 'OK' WHEN value < 60 THEN 'WARN' WHEN value < 90 THEN 'MISSING' WHEN value < 200 THEN 'FAIL' ELSE 'odd' END"


def event_checks(spark, sf_dir) -> DataFrame:
    return intake(spark, sf_dir).select("case_id", F.col("doc_type").alias("check_id"), F.expr(STATUS).alias("status"), F.col("file_name").try_cast("int").alias("seq"))


CHECKS = f"{INTAKE}, checks AS (SELECT case_id, doc_type AS check_id, {STATUS} AS status FROM intake)"
NAMED = "CASE max({}) WHEN 0 THEN 'OK' WHEN 1 THEN 'WARN' WHEN 2 THEN 'MISSING' WHEN 3 THEN 'FAIL' ELSE 'MISSING' END AS overall_status"
STRICT = "CASE status WHEN 'OK' THEN 0 WHEN 'WARN' THEN 1 WHEN 'MISSING' THEN 2 WHEN 'FAIL' THEN 3 END"


@query(f"WITH {CHECKS} SELECT case_id, {NAMED.format(STRICT)} FROM checks GROUP BY case_id")
def g4_overall_status(spark, sf_dir):
    c = event_checks(spark, sf_dir)
    return C.overall_status(c.select("case_id").distinct(), c)


@query(f"WITH {CHECKS} SELECT case_id, {NAMED.format(STRICT[:-4] + ' ELSE (CASE WHEN coalesce(status, $$$$) = $$$$ THEN 0 ELSE 1 END) END')} FROM checks GROUP BY case_id".replace("$$$$", "''"))
def g5_overall_status_lenient(spark, sf_dir):
    c = event_checks(spark, sf_dir)
    return C.overall_status_lenient(c.select("case_id").distinct(), c)


@query(f"WITH {CHECKS} SELECT case_id, count(*) FILTER (WHERE status = 'OK') AS n_ok, count(*) FILTER (WHERE status = 'WARN') AS n_warn, count(*) FILTER (WHERE status = 'MISSING') AS n_missing, count(*) FILTER (WHERE status = 'FAIL') AS n_fail, count(*) FILTER (WHERE coalesce(status, '') NOT IN ('OK', 'WARN', 'MISSING', 'FAIL')) AS n_other FROM checks GROUP BY case_id")
def g6_status_counts(spark, sf_dir):
    return C.status_counts(event_checks(spark, sf_dir))


@query(f"WITH {CHECKS} SELECT case_id, check_id, count(*) AS n FROM checks GROUP BY ALL HAVING count(*) > 1")
def g9_duplicate_check_ids(spark, sf_dir):
    return C.duplicate_check_ids(event_checks(spark, sf_dir))


# Cases rendered from the star schema


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_read(casegen.store(casegen.flat(spark, sf_dir)))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.wide_cases(store(spark, sf_dir))


FLAT = f"flat AS ({casegen.FLAT_SQL})"
MONEY = lambda c: f"cast(replace(replace({c}, '.', ''), ',', '.') AS double)"
INCOME = f"""income AS (SELECT *, CASE WHEN has_proposal AND (p_salario IS NOT NULL OR p_outras IS NOT NULL) THEN coalesce({MONEY("p_salario")}, 0) + coalesce({MONEY("p_outras")}, 0) END AS declared,
  coalesce(CASE WHEN has_payslip THEN {MONEY("h_total")} END, CASE WHEN has_bank_statement THEN {MONEY("e_renda")} END) AS proven, NOT has_payslip AND NOT has_bank_statement AS no_proof FROM flat)"""
CPF_OK = lambda c: f"({c} IN ('11144477735', '52998224725') OR ({c} = cpf AND cpf_valid))"
REN_OK = lambda c: f"coalesce({c} IN (renavam_ok, '12345678900'), false)"
CENTS = "cast(replace(replace(p_compra, '.', ''), ',', '') AS bigint)"
#: Status of each check, as SQL over the flat cases: id -> (applies, status).
RULES = {
    "identity.proposta_vs_cnh": ("true", "CASE WHEN NOT has_proposal OR NOT has_licence OR p_nome IS NULL THEN 'MISSING' WHEN p_nome = l_nome AND p_nasc = l_nasc THEN 'OK' ELSE 'WARN' END"),
    "income.declared_vs_proven.minimum": ("true", "CASE WHEN no_proof THEN 'MISSING' WHEN proven IS NULL THEN 'WARN' WHEN declared IS NULL OR proven > 0 THEN 'OK' ELSE 'WARN' END"),
    "income.declared_vs_proven.proof": ("true", "CASE WHEN no_proof THEN 'MISSING' WHEN proven IS NULL THEN 'WARN' ELSE 'OK' END"),
    "income.declared_vs_proven.total": ("true", "CASE WHEN declared IS NULL OR no_proof THEN 'MISSING' WHEN proven IS NULL THEN 'WARN' WHEN proven >= declared * 0.95 THEN 'OK' ELSE 'WARN' END"),
    "identity.proposta_vs_cnh_senatran.nome": ("has_licence_registry", "CASE WHEN NOT has_proposal OR p_nome IS NULL THEN 'MISSING' WHEN s_nome NOT LIKE 'OTHER%' THEN 'OK' ELSE 'WARN' END"),
    "identity.proposta_vs_cnh_senatran.cpf": ("has_licence_registry", "CASE WHEN NOT has_proposal OR s_cpf IS NULL THEN 'MISSING' WHEN s_cpf = cpf THEN 'OK' ELSE 'WARN' END"),
    "identity.cnh_senatran.validade": ("has_licence_registry", "CASE WHEN s_validade IS NULL THEN 'MISSING' WHEN s_validade = 'bad' THEN 'WARN' ELSE 'OK' END"),
    "identity.cnh_senatran.categoria": ("has_licence_registry", "CASE WHEN s_categoria IS NULL THEN 'MISSING' ELSE 'OK' END"),
    "vehicle.atpv.present": ("has_transfer", "'OK'"),
    "vehicle.atpv.parse.required_fields": ("has_transfer", "CASE WHEN p_compra IS NULL OR t_comprador IS NULL OR t_comprador_doc IS NULL THEN 'WARN' ELSE 'OK' END"),
    "vehicle.atpv.comprador_doc.dv": ("has_transfer AND t_comprador_doc IS NOT NULL", f"CASE WHEN {CPF_OK('t_comprador_doc')} THEN 'OK' ELSE 'WARN' END"),
    "vehicle.atpv.renavam.conditional": ("has_transfer", f"CASE WHEN t_renavam IS NULL OR {REN_OK('t_renavam')} THEN 'OK' ELSE 'WARN' END"),
    "vehicle.atpv.comprador.matches_proposta": ("has_transfer", "CASE WHEN t_comprador_doc IS NOT NULL AND has_proposal THEN CASE WHEN t_comprador_doc = cpf THEN 'OK' ELSE 'WARN' END WHEN has_proposal AND t_comprador IS NOT NULL AND p_nome IS NOT NULL THEN 'OK' ELSE 'WARN' END"),
    "vehicle.atpv.vendedor.informativo": ("has_transfer", "'OK'"),
    "vehicle.atpv.renavam.required_if_supported": ("has_transfer", f"CASE WHEN NOT has_vehicle THEN 'OK' WHEN NOT {REN_OK('v_renavam')} THEN 'WARN' WHEN {REN_OK('t_renavam')} THEN 'OK' ELSE 'FAIL' END"),
    "vehicle.atpv.renavam.matches_vehicle_doc": ("has_transfer", f"CASE WHEN has_vehicle AND {REN_OK('v_renavam')} AND {REN_OK('t_renavam')} AND v_renavam <> t_renavam THEN 'FAIL' ELSE 'OK' END"),
    "vehicle.atpv.vendedor.matches_vehicle_owner": ("has_transfer", "CASE WHEN has_vehicle AND v_owner <> t_vendedor_doc THEN 'WARN' ELSE 'OK' END"),
    "followup.atpv.renavam": ("has_transfer", "'OK'"),
    "followup.atpv.vendedor": ("has_transfer", "'OK'"),
    "vehicle.detran.present": ("has_registry", "'OK'"),
    "vehicle.detran.owner.matches_atpv_vendedor": ("has_registry", "CASE WHEN has_transfer AND r_owner IS NOT NULL THEN CASE WHEN r_owner = t_vendedor_doc THEN 'OK' ELSE 'FAIL' END WHEN has_transfer AND r_iniciais <> 'XY' THEN 'WARN' ELSE 'MISSING' END"),
    "vehicle.detran.restricao_administrativa.absent": ("has_registry", "CASE WHEN r_restricao THEN 'FAIL' WHEN NOT r_restricao THEN 'OK' ELSE 'WARN' END"),
    "vehicle.detran.alienacao_fiduciaria.inactive_or_absent": ("has_registry", "CASE WHEN r_alienacao = 'ativa' THEN 'FAIL' WHEN r_alienacao IN ('inativa', 'ausente') THEN 'OK' ELSE 'WARN' END"),
    "vehicle.detran.ipva.no_overdue": ("has_registry", "CASE WHEN r_ipva THEN 'FAIL' WHEN NOT r_ipva THEN 'OK' ELSE 'WARN' END"),
    "vehicle.detran.debitos.total_vs_valor_compra": ("has_registry", f"CASE WHEN r_debitos IS NULL OR r_multas IS NULL OR NOT has_proposal OR p_compra IS NULL THEN 'MISSING' WHEN r_debitos + r_multas > {CENTS} THEN 'FAIL' ELSE 'OK' END"),
}


def rules_sql(*prefixes: str) -> str:
    parts = [f"SELECT case_id, '{k}' AS check_id, {status} AS status FROM income WHERE {when}" for k, (when, status) in RULES.items() if k.startswith(prefixes)]
    return f"{FLAT}, {INCOME}, checks AS ({' UNION ALL '.join(parts)})"


def _family(name: str, families: list, *prefixes: str, every_case: bool = False) -> None:
    def run(spark, sf_dir):
        rows = rules.wide_cases(store(spark, sf_dir), casegen.flat(spark, sf_dir)) if every_case else wide(spark, sf_dir)
        return rules.checks_of(rows, families).select("case_id", "check_id", "status")

    run.__name__ = name
    query(f"WITH {rules_sql(*prefixes)} SELECT * FROM checks")(run)


_family("v8_identity_check", [rules.identity_check], "identity.proposta_vs_cnh", every_case=True)
SQL["v8_identity_check"] = SQL["v8_identity_check"].replace("SELECT * FROM checks", "SELECT * FROM checks WHERE check_id = 'identity.proposta_vs_cnh'")
_family("v9_income_checks", [rules.income_checks], "income.", every_case=True)
_family("v10_licence_registry_checks", [rules.licence_registry_checks], "identity.proposta_vs_cnh_senatran", "identity.cnh_senatran")
_family("v11_transfer_checks", [rules.transfer_checks], "vehicle.atpv", "followup")
_family("v12_registry_checks", [rules.registry_checks], "vehicle.detran")
ALL = rules_sql("")


@query(f"WITH {ALL}, n AS (SELECT case_id, {NAMED.format(STRICT)}, count(*) FILTER (WHERE status = 'OK') AS n_ok, count(*) FILTER (WHERE status = 'WARN') AS n_warn, count(*) FILTER (WHERE status = 'MISSING') AS n_missing, count(*) FILTER (WHERE status = 'FAIL') AS n_fail FROM checks GROUP BY case_id) SELECT n.*, CASE WHEN has_proposal AND has_licence THEN 'PASS' ELSE 'FAIL' END AS gate FROM n JOIN flat USING (case_id) WHERE has_proposal OR has_licence OR has_licence_registry OR has_payslip OR has_bank_statement OR has_transfer OR has_vehicle OR has_registry")
def v13_master_report(spark, sf_dir):
    return _shown(report.master_report(store(spark, sf_dir), F.lit(TODAY)))


def _shown(r: DataFrame) -> DataFrame:
    return r.select("case_id", "overall_status", F.expr("cast(summary.n_ok as bigint)").alias("n_ok"), F.expr("cast(summary.n_warn as bigint)").alias("n_warn"), F.expr("cast(summary.n_missing as bigint)").alias("n_missing"), F.expr("cast(summary.n_fail as bigint)").alias("n_fail"), F.col("meta.gate1").alias("gate"))


HAS_ANY = "(has_proposal OR has_licence OR has_licence_registry OR has_payslip OR has_bank_statement OR has_transfer OR has_vehicle OR has_registry)"


@query(f"WITH {FLAT} SELECT case_id, CASE WHEN k % 7 = 0 THEN 'path' ELSE 'name' END AS leak FROM flat WHERE {HAS_ANY} AND k % 7 < 2")
def v15_privacy_guard(spark, sf_dir):
    """Reports with an absolute path (k % 7 = 0) or a person's field (1) put in must be caught, all others not."""
    r = report.master_report(store(spark, sf_dir), F.lit(TODAY)).withColumn("k", F.substring("case_id", 2, 9).cast("long") % 7)
    leaky = F.when(F.col("k") == 0, F.map_concat("inputs", F.create_map(F.lit("more"), F.lit("/home/someone/x.json")))).when(F.col("k") == 1, F.map_concat("inputs", F.create_map(F.lit("nome"), F.lit("x")))).otherwise(F.col("inputs"))
    return report.privacy_guard(r.withColumn("inputs", leaky)).select("case_id", F.when(F.substring("case_id", 2, 9).cast("long") % 7 == 0, F.lit("path")).otherwise(F.lit("name")).alias("leak"))


@query(f"WITH {ALL} SELECT case_id, {NAMED.format(STRICT)}, count(*) AS n_checks, max(has_proposal::int)::varchar AS proposal FROM checks JOIN flat USING (case_id) WHERE {HAS_ANY} GROUP BY case_id")
def v13_report_json(spark, sf_dir):
    r = report.report_json(report.master_report(store(spark, sf_dir), F.lit(TODAY)))
    seen = F.get_json_object("report", "$.inputs.proposal").isNotNull().cast("int").cast("string")
    return r.select("case_id", F.get_json_object("report", "$.overall_status").alias("overall_status"), F.json_array_length(F.get_json_object("report", "$.checks")).cast("long").alias("n_checks"), seen.alias("proposal"))


@query(f"WITH {FLAT} SELECT case_id, f.field, CASE WHEN NOT (has_proposal AND has_licence) OR a IS NULL OR b IS NULL THEN 'missing' WHEN d IS NULL THEN 'not_comparable' WHEN c = d THEN 'equal' ELSE 'different' END AS status, CASE WHEN has_proposal THEN a END AS left_raw, CASE WHEN has_proposal THEN c END AS left_normalized, CASE WHEN has_licence THEN b END AS right_raw, CASE WHEN has_licence THEN d END AS right_normalized FROM flat, LATERAL (SELECT unnest(['nome', 'cpf', 'data_nascimento']) AS field, unnest([p_nome, p_cpf, p_nasc]) AS a, unnest([l_nome, cpf, CASE WHEN k % 13 = 0 THEN 'ilegível' ELSE l_nasc END]) AS b, unnest([strip_accents(upper(p_nome)), cpf, p_nasc]) AS c, unnest([strip_accents(upper(l_nome)), cpf, CASE WHEN k % 13 > 0 THEN p_nasc END]) AS d) f WHERE has_proposal OR has_licence")
def v5_field_comparison(spark, sf_dir):
    """All columns; some dates of the licence can't be read."""
    f = casegen.flat(spark, sf_dir)
    left = f.where("has_proposal").select("case_id", F.col("p_nome").alias("nome"), F.col("p_cpf").alias("cpf"), F.col("p_nasc").alias("data_nascimento"))
    right = f.where("has_licence").select("case_id", F.col("l_nome").alias("nome"), "cpf", F.when(F.col("k") % 13 == 0, F.lit("ilegível")).otherwise(F.col("l_nasc")).alias("data_nascimento"))
    return C.compare_fields(left, right, {"nome": "name", "cpf": "id", "data_nascimento": "date"})


@query(f"WITH {FLAT}, d AS (SELECT case_id, l_validade, CASE WHEN l_validade LIKE '____-__-__' THEN try_strptime(l_validade, '%Y-%m-%d') ELSE try_strptime(l_validade, '%d/%m/%Y') END::DATE AS v FROM flat WHERE has_licence) SELECT case_id, CASE WHEN l_validade IS NULL THEN 'missing' WHEN v IS NULL THEN 'unparseable' WHEN v >= DATE '{TODAY}' THEN 'valid' ELSE 'expired' END AS status, cast(v - DATE '{TODAY}' AS int) AS days_to_expire FROM d")
def v6_licence_validity(spark, sf_dir):
    f = casegen.flat(spark, sf_dir).where("has_licence").select("case_id", F.col("l_validade").alias("validade"))
    return rules.licence_validity_report(f, F.lit(TODAY).cast("date"))


@query(f"WITH {FLAT}, i AS (SELECT case_id, CASE WHEN has_proposal AND (p_salario IS NOT NULL OR p_outras IS NOT NULL) THEN coalesce({MONEY('p_salario')}, 0) + coalesce({MONEY('p_outras')}, 0) END AS declared, CASE WHEN has_payslip THEN {MONEY('h_total')} END AS h, CASE WHEN has_bank_statement THEN {MONEY('e_renda')} END AS e FROM flat WHERE has_proposal OR has_licence OR has_licence_registry OR has_payslip OR has_bank_statement OR has_transfer OR has_vehicle OR has_registry), j AS (SELECT *, CASE WHEN h IS NOT NULL OR e IS NOT NULL THEN coalesce(h, 0) + coalesce(e, 0) END AS proven FROM i) SELECT case_id, round(declared, 2) AS declared, round(proven, 2) AS proven, CASE WHEN declared IS NULL THEN 'declared_missing' WHEN proven IS NULL THEN 'proven_missing' WHEN proven >= declared THEN 'compatible' ELSE 'below_declared' END AS status, round(proven / declared, 4) AS ratio FROM j")
def v7_income_report(spark, sf_dir):
    return rules.income_report(wide(spark, sf_dir)).select("case_id", F.round("declared", 2).alias("declared"), F.round("proven", 2).alias("proven"), "status", F.round("ratio", 4).alias("ratio"))


@query(f"WITH {FLAT}, m AS (SELECT case_id, list_filter([CASE WHEN NOT has_proposal AND (NOT has_proposal OR NOT has_licence) THEN 'proposal' END, CASE WHEN NOT has_licence THEN 'licence' END, CASE WHEN NOT has_payslip AND NOT has_bank_statement THEN 'proof_of_income' END], lambda x: x IS NOT NULL) AS l FROM flat WHERE has_proposal OR has_licence OR has_licence_registry OR has_payslip OR has_bank_statement OR has_transfer OR has_vehicle OR has_registry) SELECT case_id, array_to_string(l, ',') AS missing_docs FROM m WHERE len(l) > 0")
def g7_missing_docs_summary(spark, sf_dir):
    checks = rules.checks_of(wide(spark, sf_dir))
    return C.missing_docs_summary(checks).select("case_id", F.array_join("missing_docs", ",").alias("missing_docs"))


@query(f"WITH {FLAT}, {INCOME} SELECT case_id, round(declared, 2) AS declared, round(proven, 2) AS proven, (has_payslip::int + has_bank_statement::int)::int AS n_proof_docs FROM income WHERE has_proposal OR has_licence OR has_licence_registry OR has_payslip OR has_bank_statement OR has_transfer OR has_vehicle OR has_registry")
def g8_checks_usage_summary(spark, sf_dir):
    u = C.checks_usage_summary(rules.checks_of(wide(spark, sf_dir))).where("check_id = 'income.declared_vs_proven.total'")
    return u.select("case_id", "declared", "proven", "n_proof_docs")


@query(f"WITH {ALL} SELECT case_id, status, string_agg(check_id, ',' ORDER BY check_id) AS check_ids FROM checks JOIN flat USING (case_id) WHERE has_proposal OR has_licence OR has_licence_registry OR has_payslip OR has_bank_statement OR has_transfer OR has_vehicle OR has_registry GROUP BY case_id, status")
def g6_group_checks(spark, sf_dir):
    g = C.group_checks(rules.checks_of(wide(spark, sf_dir)))
    return g.select("case_id", "status", F.array_join(F.array_sort("check_ids"), ",").alias("check_ids"))


TOKENS = lambda c: f"regexp_extract_all(strip_accents(upper(coalesce({c}, ''))), '[A-Z]{{2,}}')"
JACCARD = lambda a, b: f"len(list_distinct(list_intersect({TOKENS(a)}, {TOKENS(b)}))) / nullif(len(list_distinct({TOKENS(a)} || {TOKENS(b)})), 0)"


@query(f"WITH {FLAT}, p AS (SELECT case_id, unnest([CASE WHEN has_licence THEN 'licence' END, CASE WHEN has_licence_registry THEN 'licence_registry' END, CASE WHEN has_proposal THEN 'proposal' END]) AS t, unnest([cpf, s_cpf, cpf]) AS n, unnest([l_nome, s_nome, p_nome]) AS nome, unnest([k, k, k - k % 10]) AS born FROM flat) SELECT a.case_id, a.t AS doc_type_a, b.t AS doc_type_b, a.n = b.n AS same_id, a.born = b.born AS same_birth, round({JACCARD('a.nome', 'b.nome')}, 6) AS similarity, {JACCARD('a.nome', 'b.nome')} < 0.6 AS names_differ FROM p a JOIN p b ON a.case_id = b.case_id AND a.t < b.t")
def k7_cross_compare_pairs(spark, sf_dir):
    """All columns. Of the proposal's birth dates only those of every tenth case are the licence's."""
    f = casegen.flat(spark, sf_dir).withColumn("other", F.when(F.col("k") % 10 == 0, F.col("p_nasc")).otherwise(F.lit("01/02/1900")))
    one = lambda flag, t, name, number, birth: f.where(flag).select("case_id", F.lit(t).alias("doc_type"), F.col(name).alias("name"), F.col(number).alias("doc_number"), F.expr(birth).alias("birth"))
    parties = one("has_proposal", "proposal", "p_nome", "p_cpf", "other").unionByName(one("has_licence", "licence", "l_nome", "cpf", "l_nasc")).unionByName(one("has_licence_registry", "licence_registry", "s_nome", "s_cpf", "p_nasc"))
    return C.cross_compare_pairs(parties).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {FLAT} SELECT case_id, CASE WHEN p_compra IS NULL THEN 'missing_required:valor_venda,' ELSE '' END || CASE WHEN t_renavam IS NULL THEN 'missing_required:renavam,' ELSE '' END || CASE WHEN t_comprador_doc IS NULL THEN 'missing_required:comprador_cpf_cnpj,' ELSE '' END || CASE WHEN t_comprador IS NULL THEN 'missing_required:comprador_nome,' ELSE '' END || CASE WHEN t_renavam IS NOT NULL AND NOT {REN_OK('t_renavam')} THEN 'invalid:renavam_checkdigit,' ELSE '' END || CASE WHEN t_comprador_doc IS NOT NULL AND NOT {CPF_OK('t_comprador_doc')} THEN 'invalid:comprador_cpf,' ELSE '' END || CASE WHEN k % 6 = 0 THEN 'invalid:placa_format,' ELSE '' END AS errors FROM flat WHERE has_transfer")
def v1_validate_transfer(spark, sf_dir):
    t = casegen.flat(spark, sf_dir).where("has_transfer").select("case_id", F.when(F.col("k") % 6 == 0, F.lit("PLACA")).otherwise(F.lit("abc-1d23")).alias("placa"), F.lit("9BWZZZ377VT004251").alias("chassi"), F.col("t_renavam").alias("renavam"), F.col("p_compra").alias("valor_venda"), F.col("t_comprador").alias("comprador_nome"), F.col("t_comprador_doc").alias("comprador_cpf_cnpj"), F.col("t_vendedor").alias("vendedor_nome"), F.col("t_vendedor_doc").alias("vendedor_cpf_cnpj"))
    order = ["valor_venda", "renavam", "comprador_cpf_cnpj", "comprador_nome"]
    wanted = [*(f"missing_required:{n}" for n in order), "invalid:renavam_checkdigit", "invalid:comprador_cpf", "invalid:placa_format"]
    shown = F.concat(*(F.when(F.array_contains("errors", n), F.lit(n + ",")).otherwise(F.lit("")) for n in wanted))
    return rules.validate_transfer(t).select("case_id", shown.alias("errors"))


# Table jobs


def parties(spark, sf_dir) -> DataFrame:
    return casegen.flat(spark, sf_dir).select("case_id", F.col("p_nome").alias("name"), F.col("p_cpf").alias("doc_number"))


@query(f"WITH {FLAT} SELECT case_id, strip_accents(upper(p_nome)) AS name_normalized, cpf AS doc_normalized, len(list_filter(string_split(coalesce(p_nome, ''), ' '), lambda x: x <> '')) AS n_tokens FROM flat")
def n1_normalize_parties(spark, sf_dir):
    p = parties(spark, sf_dir).withColumns({"address": F.lit(None).cast("string"), "city_state": F.lit("CURITIBA - PR")})
    return N.normalize_parties(p).select("case_id", "name_normalized", "doc_normalized", F.size("name_tokens").cast("bigint").alias("n_tokens"))


@query(f"""WITH {FLAT}, i AS (SELECT k, CASE WHEN has_proposal THEN CASE WHEN k % 29 = 0 THEN 'all_equal' WHEN k % 31 = 0 THEN 'bad_length' WHEN cpf_valid THEN 'ok' ELSE 'dv_mismatch' END END AS c, CASE WHEN has_vehicle THEN {REN_OK('v_renavam')} END AS r FROM flat)
  SELECT 'cpf' AS kind, count(*) AS n, count(c) AS n_present, count(*) FILTER (WHERE c = 'ok') AS n_valid, count(*) FILTER (WHERE c = 'bad_length') AS n_bad_length, count(*) FILTER (WHERE c = 'all_equal') AS n_all_equal, count(*) FILTER (WHERE c = 'dv_mismatch') AS n_dv_mismatch FROM i
  UNION ALL SELECT 'cnpj', count(*), count(*) FILTER (WHERE k % 5 > 0), count(*) FILTER (WHERE k % 5 > 1), 0, 0, 0 FROM i
  UNION ALL SELECT 'renavam', count(*), count(r), count(*) FILTER (WHERE r), 0, 0, 0 FROM i
  UNION ALL SELECT 'plate', count(*), count(*), count(*) FILTER (WHERE k % 6 > 0), 0, 0, 0 FROM i
  UNION ALL SELECT 'vin', count(*), count(*), count(*) FILTER (WHERE k % 4 > 0), 0, 0, 0 FROM i""")
def n2_audit_ids(spark, sf_dir):
    """All five kinds, and each reason why a CPF is refused."""
    k = F.col("k")
    cpf = F.when(k % 29 == 0, F.lit("11111111111")).when(k % 31 == 0, F.lit("529.982")).otherwise(F.col("p_cpf"))
    f = casegen.flat(spark, sf_dir).select(
        F.lit("proposal").alias("doc_type"), F.when(F.col("has_proposal"), cpf).alias("cpf"), F.when(k % 5 > 1, F.lit("11.222.333/0001-81")).when(k % 5 == 1, F.lit("11222333000182")).alias("cnpj"),
        F.when(F.col("has_vehicle"), F.col("v_renavam")).alias("renavam"), F.when(k % 6 == 0, F.lit("PLACA")).otherwise(F.lit("abc-1d23")).alias("plate"), F.when(k % 4 == 0, F.lit("9BWZZZ377VTOO4251")).otherwise(F.lit("9BWZZZ377VT004251")).alias("vin"))
    return N.audit_ids(f).drop("doc_type")


@query(f"WITH {FLAT} SELECT case_id, {MONEY('p_salario')} AS amount_any, {MONEY('p_salario')} AS amount_br, {MONEY('p_salario')} AS amount_reais, {MONEY('p_salario')} AS amount_signed, cast(replace(replace(p_salario, '.', ''), ',', '') AS bigint) AS amount_cents FROM flat")
def n3_normalize_amounts(spark, sf_dir):
    a = casegen.flat(spark, sf_dir).select("case_id", F.col("p_salario").alias("amount"))
    return N.normalize_amounts(a).drop("amount")


@query(f"WITH {FLAT}, d AS (SELECT CASE WHEN l_validade LIKE '____-__-__' THEN try_strptime(l_validade, '%Y-%m-%d') ELSE try_strptime(l_validade, '%d/%m/%Y') END::DATE - DATE '{TODAY}' AS n FROM flat) SELECT CASE WHEN n IS NULL THEN 'unknown' WHEN n < 0 THEN 'expired' WHEN n <= 30 THEN 'month' WHEN n <= 365 THEN 'year' ELSE 'later' END AS expiry_bucket, count(*) AS n FROM d GROUP BY 1")
def n4_normalize_dates(spark, sf_dir):
    d = casegen.flat(spark, sf_dir).select(F.col("l_validade").alias("date_text"))
    return N.normalize_dates(d, F.lit(TODAY).cast("date")).groupBy("expiry_bucket").agg(F.count("*").alias("n"))


INITIALS = lambda c: f"list_transform(list_filter(string_split(upper(coalesce({c}, '')), ' '), lambda x: len(x) > 1 AND x <> 'DA'), lambda x: x[1])"


@query(f"WITH {FLAT}, i AS (SELECT *, {INITIALS('p_nome')} AS x, {INITIALS('s_nome')} AS y FROM flat) SELECT case_id, p_nome = s_nome AS exact, CASE WHEN p_nome IS NOT NULL THEN s_nome NOT LIKE 'OTHER%' END AS tolerant, coalesce(s_nome NOT LIKE 'OTHER%' AND p_nome IS NOT NULL, false) AS two_tokens, round({JACCARD('p_nome', 's_nome')}, 6) AS jaccard, least(len(x), len(y)) >= 2 AND x[1:least(len(x), len(y))] = y[1:least(len(x), len(y))] AS initials FROM i")
def n5_match_names(spark, sf_dir):
    p = casegen.flat(spark, sf_dir).select("case_id", F.col("p_nome").alias("name_a"), F.col("s_nome").alias("name_b"))
    return N.match_names(p).drop("name_a", "name_b")


@query(f"WITH {FLAT} SELECT case_id, substr(cpf, 1, 3) || '.***.***-' || substr(cpf, 10, 2) AS p_cpf, substr(renavam_ok, 1, 3) || '*****' || substr(renavam_ok, 9, 3) AS renavam_ok, '***.' || substr(cpf, 8, 4) AS cpf FROM flat")
def n6_mask_personal_data(spark, sf_dir):
    f = casegen.flat(spark, sf_dir).select("case_id", "p_cpf", "renavam_ok", "cpf")
    return N.mask_personal_data(f, {"p_cpf": "doc", "renavam_ok": "renavam", "cpf": "cpf"})


@query(f"WITH {FLAT} SELECT case_id, CASE WHEN p_salario IS NULL THEN 'salario,' ELSE '' END || CASE WHEN p_nome IS NULL THEN 'nome,' ELSE '' END AS missing FROM flat WHERE has_proposal")
def j2_missing_fields(spark, sf_dir):
    f = casegen.flat(spark, sf_dir).where("has_proposal")
    return f.select("case_id", F.concat(*(F.when(F.array_contains(T.missing_fields({"salario": F.col("p_salario"), "nome": F.col("p_nome")}), x), F.lit(x + ",")).otherwise(F.lit("")) for x in ("salario", "nome"))).alias("missing"))


@query(f"WITH {FLAT} SELECT case_id, cpf_valid AS cpf_ok, {REN_OK('t_renavam')} AS renavam_ok_valid, CASE WHEN cpf_valid THEN 'ok' ELSE 'dv_mismatch' END AS reason FROM flat")
def s23_check_digits(spark, sf_dir):
    f = casegen.flat(spark, sf_dir)
    return f.select("case_id", ids.is_valid_cpf("p_cpf").alias("cpf_ok"), ids.is_valid_renavam("t_renavam").alias("renavam_ok_valid"), ids.cpf_check_reason("p_cpf").alias("reason"))


# Lines of documents and statements


@query(r"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(160))), lambda x: x <> '')) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, sum(length(line))::bigint AS n_chars_in_lines, min(line) AS least_line FROM l GROUP BY doc_id""")
def l1_explode_lines(spark, sf_dir):
    lines = L.explode_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars_in_lines"), F.min("line").alias("least_line"))


@query(r"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(160))), lambda x: x <> '')) AS line FROM documents) SELECT doc_id, count(DISTINCT lower(regexp_replace(line, '\s+', ' ', 'g'))) AS n_distinct FROM l GROUP BY doc_id""")
def l5_merge_pass_lines(spark, sf_dir):
    lines = L.explode_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    twice = lines.withColumn("pass", F.lit(0)).unionByName(lines.withColumn("pass", F.lit(1)))
    return L.merge_pass_lines(twice).select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_distinct"))


#: Words put before the documents' texts, by doc_id % 12, and file names by doc_id % 5, with the type that each alone gives.
OPENINGS = ("Carteira Nacional de Habilitação", "PLANILHA DE PROPOSTA", "Proposta: 123456 x", "Segunda via, endereco", "nome: a cep: b cidade: c", "Recibo de pagamento", "Adm.: 1 salario", "Extrato por periodo", "Saldo anterior", "Extrato, saldo", "Historico", "nothing")
BY_WORDS = ("cnh", "proposta", "proposta", "residencia", "residencia", "holerite", "holerite", "extrato", "extrato", "desconhecido", "desconhecido", "desconhecido")
BY_WORDS_INTAKE = ("cnh", "proposta_daycoval", "proposta_daycoval", None, None, "holerite", None, None, None, "extrato_bancario", "extrato_bancario", None)
FILES = ("x.txt", "CNH digital.pdf", "folha.pdf", "extrato.pdf", "y.txt")


def _opened(spark, sf_dir) -> DataFrame:
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(at(OPENINGS, 12), F.lit("\n"), T.text("text")).alias("text"), at(FILES, 5).alias("file_name"))


def _listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


TOLD = "(SELECT doc_id, upper(coalesce(text, '')) AS t FROM documents)"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 5 = 1 OR doc_id % 12 = 0 OR regexp_matches(t, 'CARTEIRA NACIONAL DE HABIL|SENATRAN|ASSINADOR SERPRO') THEN 'cnh'
  WHEN doc_id % 12 IN (1, 2) THEN 'proposta' WHEN doc_id % 12 IN (3, 4) THEN 'residencia' WHEN doc_id % 12 IN (5, 6) THEN 'holerite' WHEN doc_id % 5 = 3 OR contains(t, 'LANCAMENTOS') OR contains(t, 'SALDO ANTERIOR') THEN 'extrato'
  ELSE {_listed(BY_WORDS)}[doc_id % 12 + 1] END AS doc_class FROM {TOLD}""")
def x1_classify_by_keywords(spark, sf_dir):
    return extract.classify_by_keywords(_opened(spark, sf_dir)).select("doc_id", "doc_class")


def statement_texts(spark, sf_dir) -> DataFrame:
    return casegen.render_statements(casegen.transactions(spark, sf_dir))


KIND = "CASE doc_id % 6 WHEN 0 THEN 'line_end_value' WHEN 1 THEN 'tabular_two_amounts' WHEN 2 THEN 'month_sections_dual_dates' WHEN 3 THEN 'long_date_header' WHEN 4 THEN 'month_columnar' ELSE 'date_last_value' END"


@query(f"WITH t AS ({casegen.TX_SQL}) SELECT doc_id, {KIND} AS strategy, strftime(d, '%Y-%m-%d') AS data, CASE WHEN doc_id % 6 = 0 THEN -cents ELSE cents END AS cents FROM t")
def x9_extract_statement(spark, sf_dir):
    got = statements.extract_statement(statement_texts(spark, sf_dir))
    return got.select("doc_id", "strategy", "data", F.round(F.col("valor") * 100).cast("bigint").alias("cents"))


@query(f"WITH t AS ({casegen.TX_SQL}) SELECT doc_id, {KIND} AS strategy FROM t GROUP BY doc_id")
def w1_best_strategy(spark, sf_dir):
    found = statements.candidates(statements.statement_lines(statement_texts(spark, sf_dir)))
    return statements.best_strategy(statements.strategy_score(found)).select("doc_id", "strategy")


#: What each strategy makes of each printed layout: (layout, strategy, whether it reads the lines or discards them).
CROSSINGS = ((0, "line_end_value", True), (0, "date_last_value", True), (0, "tabular_two_amounts", False), (1, "tabular_two_amounts", True), (2, "month_sections_dual_dates", True), (2, "tabular_two_amounts", False),
             (3, "long_date_header", True), (4, "month_columnar", True), (5, "date_last_value", True), (5, "tabular_two_amounts", False))
CROSSED = ", ".join(f"({k}, '{s}', {str(good).lower()})" for k, s, good in CROSSINGS)


@query(f"WITH t AS ({casegen.TX_SQL}), d AS (SELECT doc_id, {KIND} AS own, count(*) AS n FROM t GROUP BY doc_id), m(kind, strategy, good) AS (VALUES {CROSSED}) SELECT strategy, sum(CASE WHEN good THEN n ELSE 0 END)::bigint AS n_tx, sum(CASE WHEN good THEN 0 ELSE n END)::bigint AS n_discarded, round(avg(CASE WHEN good THEN n + 2.0 ELSE -1.0 END), 6) AS mean_score, count(*) FILTER (WHERE strategy = own) AS n_won FROM d JOIN m ON m.kind = d.doc_id % 6 GROUP BY strategy")
def g14_strategy_leaderboard(spark, sf_dir):
    found = statements.candidates(statements.statement_lines(statement_texts(spark, sf_dir)))
    return statements.strategy_leaderboard(statements.strategy_score(found))


# Extraction round trips over rendered texts


def _optional(label: str, c: str):
    return F.when(F.col(c).isNotNull(), F.concat(F.lit(label), F.col(c)))


def proposal_texts(spark, sf_dir) -> DataFrame:
    """Printed forms in three variants: all on labelled lines; values below labels and in small letters; without number and with words in other places."""
    f, k = casegen.flat(spark, sf_dir).where("has_proposal"), F.col("k")
    s = lambda x: F.lit(x) if isinstance(x, str) else x
    text = lambda *parts: F.concat(*map(s, parts))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    number, rate = (1000 + k).cast("string"), F.concat((100 + k % 900).cast("string"), F.lit(",00"))
    person = F.when(F.col("p_nome").isNotNull(), text("FINANCIADO: ", F.col("p_nome"), " (", F.col("p_cpf"), ")")).otherwise(text("CPF: ", F.col("p_cpf")))
    full = text("PLANILHA\nProposta: ", number, " LOJA: AUTO  CENTRO ", F.col("last_name_"), " VENDEDOR: A\n", person, "\nData de Nasc.: ", F.col("p_nasc"), " Sexo: F\nNaturalidade: SAO JOSE UF Naturalidade: SC\nFil. Pai: X Fil. Mãe: MARIA DE SOUZA Qtde Dependentes: 0\nLIMA\nNome Cônjuge: Y\n",
                "Endereço: RUA DAS FLORES Nº.:", (1 + k % 900).cast("string"), " Compl.: apto 3 Cep: 88000-000\nEmpresa: ACME ", k.cast("string"), " LTDA C.N.P.J: 1\nData Adm.: ", F.col("p_nasc"), " Cargo: Z\nSalário: ", blank("p_salario"), " Outras Rendas: ", blank("p_outras"), " Vlr. Parcela: ", rate, F.coalesce(_optional("\nVlr. Compra: ", "p_compra"), F.lit("")))
    below = text("proposta:\n", number, "\nloja:\nauto centro sul telefone: 1\n", F.when(F.col("p_nome").isNotNull(), text("financiado:\n", F.lower("p_nome"), "\n(", F.col("p_cpf"), "A)")).otherwise(text("cpf:\n", F.col("p_cpf"))), "\ndata de nasc:\n", F.col("p_nasc"), "\nnaturalidade: lages uf naturalidade: sc\nFil Mae: ana\nmaria  Qtde Dep\nNome Cônjuge: OUTRA\n",
                 "endereço: rua  nova\nNo 7\ncep: 1\nempresa: acme\nbranca C.N.P.J\ndata adm.:\n01/02/2020\ncargo\nsalário:\n", blank("p_salario"), "\noutras rendas: R$ ", blank("p_outras"), "\nVlr. Parcela:\nValor da Prestação - R$ ", rate, F.coalesce(_optional("\nVLR COMPRA R$ ", "p_compra"), F.lit("")))
    other = text("Proposta: ", number, "\n", person, "\nLOJA: BANCO\nEndereço: ESTRADA GERAL Compl.: FUNDOS 2 Cep: 1\nFil. Mãe: ROSA Qtde Dependentes: 1\n12 anos\nLIMA\nParcela mensal de R$ ", rate)
    rows = f.withColumn("last_name_", F.element_at(F.split("full_name", " "), -1))
    return rows.select(k.alias("doc_id"), F.when(k % 3 == 0, full).when(k % 3 == 1, below).otherwise(other).alias("text"))


@query(f"""WITH {FLAT} SELECT k AS doc_id, (1000 + k)::varchar AS proposta, p_nome AS nome_financiado, cpf, CASE k % 3 WHEN 0 THEN 'AUTO CENTRO ' || split_part(full_name, ' ', -1) WHEN 1 THEN 'AUTO CENTRO SUL' END AS nome_loja,
  CASE WHEN k % 3 < 2 THEN p_nasc END AS data_nascimento, ['SAO JOSE', 'LAGES', NULL][k % 3 + 1] AS cidade_nascimento, CASE WHEN k % 3 < 2 THEN 'SC' END AS uf, ['MARIA DE SOUZA LIMA', 'ANA MARIA', 'ROSA'][k % 3 + 1] AS nome_mae,
  ['RUA DAS FLORES', 'rua nova', 'ESTRADA GERAL'][k % 3 + 1] AS endereco, CASE k % 3 WHEN 0 THEN (1 + k % 900)::varchar WHEN 1 THEN '7' END AS numero, ['APTO 3', NULL, 'FUNDOS 2'][k % 3 + 1] AS complemento, CASE k % 3 WHEN 0 THEN 'ACME ' || k || ' LTDA' WHEN 1 THEN 'acme branca' END AS empresa,
  CASE k % 3 WHEN 0 THEN p_nasc WHEN 1 THEN '01/02/2020' END AS data_admissao, CASE WHEN k % 3 < 2 THEN p_salario END AS salario, CASE WHEN k % 3 < 2 THEN p_outras END AS outras_rendas, (100 + k % 900) || ',00' AS valor_parcela, CASE WHEN k % 3 < 2 THEN p_compra END AS valor_compra FROM flat WHERE has_proposal""")
def x4_extract_proposal(spark, sf_dir):
    return extract.extract_proposal(proposal_texts(spark, sf_dir))


@query(f"WITH {FLAT} SELECT k AS doc_id, full_name AS nome, cpf, ['A', 'B', 'AB', 'AC', 'D'][k % 5 + 1] AS categoria, p_nasc AS data_nascimento, '31/12/20' || (30 + k % 60) AS validade, CASE WHEN k % 2 = 0 THEN 'PR' ELSE 'SC' END AS uf_nascimento FROM flat WHERE has_licence_registry")
def x6_extract_licence_registry(spark, sf_dir):
    f = casegen.flat(spark, sf_dir).where("has_licence_registry")
    text = F.concat(F.lit("CARTEIRA NACIONAL DE HABILITACAO\nNOME\n"), F.col("full_name"), F.lit("\n"), F.col("p_nasc"), F.when(F.col("k") % 2 == 0, F.lit(", CURITIBA, PR\nCPF ")).otherwise(F.lit(", LAGES, SC\nCPF ")), F.col("cpf"), F.lit("\nVALIDADE 31/12/20"), (30 + F.col("k") % 60).cast("string"),
                    F.when(F.col("k") % 3 == 0, F.lit("\nCAT. ")).otherwise(F.lit("\nCATEGORIA ")), F.element_at(F.array(*map(F.lit, ("A", "B", "AB", "AC", "D"))), (F.col("k") % 5 + 1).cast("int")), F.lit("\nFILIACAO\nJOSE DA SILVA\nMARIA DE SOUZA\nPERMISSAO\n"))
    got = extract.extract_licence_registry(f.select(F.col("k").alias("doc_id"), text.alias("text")))
    return got.select("doc_id", "nome", "cpf", "categoria", "data_nascimento", "validade", "uf_nascimento")


def payslip_texts(spark, sf_dir) -> DataFrame:
    """Values on their labels' lines, below them, and without any label; some have no total."""
    f = casegen.flat(spark, sf_dir).where("has_payslip")
    total = lambda before, after: F.coalesce(F.concat(F.lit(before), F.col("h_total"), F.lit(after)), F.lit(""))
    k, acme = F.col("k"), F.concat(F.lit("ACME "), F.col("k").cast("string"), F.lit(" LTDA"))
    same = F.concat(F.lit("DEMONSTRATIVO DE PAGAMENTO\nEmpresa: "), acme, F.lit("\nFuncionário: "), F.col("full_name"), F.lit("\nCPF "), F.col("p_cpf"), F.lit("\nAdmissão: "), F.col("p_nasc"), total("\nTotal de Vencimentos ", " 12,00"))
    below = F.concat(F.lit("RECIBO\nRAZAO SOCIAL\n"), acme, F.lit("\nNOME\n"), F.col("full_name"), F.lit("\nCPF\n"), F.col("p_cpf"), F.lit("\nDT ADMISSAO\n"), F.col("p_nasc"), total("\nTOTAL PROVENTOS\n", "\n1,00"))
    bare = F.concat(acme, F.lit("  "), F.lit("\n"), F.col("full_name"), F.lit("\n"), F.col("p_cpf"), F.lit("\n"), F.col("p_nasc"), total("\n5,00 ", ""))
    text = F.when(k % 3 == 0, same).when((k % 3 == 1) | (F.length(acme) < 12), below).otherwise(bare)
    return f.select(k.alias("doc_id"), text.alias("text"))


@query(f"WITH {FLAT} SELECT k AS doc_id, full_name AS nome, cpf, 'ACME ' || k || ' LTDA' AS empregador, p_nasc AS data_admissao, h_total AS total_vencimentos FROM flat WHERE has_payslip")
def x7_extract_payslip(spark, sf_dir):
    return extract.extract_payslip(payslip_texts(spark, sf_dir))


def transfer_texts(spark, sf_dir) -> DataFrame:
    f = casegen.flat(spark, sf_dir).where("has_transfer")
    opt = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c)))
    text = F.concat_ws("\n", F.lit("AUTORIZAÇÃO PARA TRANSFERÊNCIA"), F.lit("Placa: ABC1D23"), opt("Renavam", "t_renavam"), opt("Valor da Venda R$", "p_compra"), F.lit("DADOS DO VENDEDOR"), opt("Nome", "t_vendedor"), opt("CPF/CNPJ", "t_vendedor_doc"), F.lit("DADOS DO COMPRADOR"), opt("Nome", "t_comprador"), opt("CPF/CNPJ", "t_comprador_doc"))
    return f.select(F.col("k").alias("doc_id"), text.alias("text"))


@query(f"WITH {FLAT} SELECT k AS doc_id, 'ABC1D23' AS placa, t_renavam AS renavam, p_compra AS valor, coalesce(t_comprador, '') AS comprador_nome, coalesce(t_comprador_doc, '') AS comprador_cpf_cnpj, t_vendedor AS vendedor_nome, t_vendedor_doc AS vendedor_cpf_cnpj FROM (SELECT * REPLACE (CASE WHEN t_renavam = renavam_ok THEN t_renavam END AS t_renavam) FROM flat) WHERE has_transfer")
def x15_extract_transfer(spark, sf_dir):
    return extract.extract_transfer(transfer_texts(spark, sf_dir)).drop("chassi")


def _registry_texts(spark, sf_dir) -> DataFrame:
    f, k = casegen.flat(spark, sf_dir).where("has_registry"), F.col("k")
    owner = F.when(k % 25 == 0, F.lit("S*** F***")).otherwise(F.col("t_vendedor"))
    named = F.when(k % 2 == 0, F.concat(F.lit("Nome do proprietário atual\n"), owner)).otherwise(F.concat(F.lit("Proprietário: "), owner))
    text = F.concat_ws("\n", F.lit("CONSULTA DETRAN, Secretaria"), named, F.lit("Marca/Modelo: VW GOL"), F.concat(F.lit("CPF/CNPJ: "), F.regexp_replace("r_owner", r"(...)(...)(...)(..)", "$1.$2.$3-$4")), F.concat(F.lit("Renavam: "), F.col("renavam_ok")),
                       F.lit("Débitos"), F.concat(F.when(k % 15 == 0, F.lit("1) IPVA em aberto R$ ")).otherwise(F.lit("1) IPVA R$ ")), money.pt_br((F.col("cents") - 100) / 100)), F.lit("2) taxa R$ 1,00"), F.lit("Multas"), F.lit("Nenhuma multa."),
                       F.when(k % 10 == 0, F.lit("Nada consta de gravame.")).otherwise(F.lit("Sem gravame")), F.when(k % 3 == 0, F.lit("Sem restrição.")).when(k % 3 == 1, F.lit("Impedimento judicial.")))
    return f.select(k.alias("doc_id"), text.alias("text"))


@query(f"""WITH {FLAT} SELECT k AS doc_id, CASE WHEN k % 25 = 0 THEN 'S*** F***' ELSE t_vendedor END AS proprietario_nome, coalesce(substr(r_owner, 1, 3) || '.' || substr(r_owner, 4, 3) || '.' || substr(r_owner, 7, 3) || '-' || substr(r_owner, 10, 2), renavam_ok) AS proprietario_doc, renavam_ok AS renavam, k % 25 = 0 AS proprietario_nome_ofuscado, CASE WHEN k % 25 = 0 THEN 'SF' END AS proprietario_iniciais,
  CASE WHEN k % 25 = 0 THEN 'aberta' ELSE 'despachante' END AS modo, cents AS debitos_total_cents, 0::bigint AS multas_total_cents, 'VW GOL' AS marca_modelo, CASE WHEN k % 10 = 0 THEN 'desconhecida' ELSE 'ausente' END AS alienacao_fiduciaria_status,
  CASE WHEN k % 3 = 0 THEN false WHEN k % 3 = 1 THEN true END AS restricao_administrativa_ativa, k % 15 = 0 AS ipva_em_atraso, true AS debitos_em_aberto, false AS multas_em_aberto FROM flat WHERE has_registry""")
def x16_extract_registry_lookup(spark, sf_dir):
    got = extract.extract_registry_lookup(_registry_texts(spark, sf_dir))
    return got.select("doc_id", "proprietario_nome", "proprietario_doc", "renavam", "proprietario_nome_ofuscado", "proprietario_iniciais", "modo", "debitos_total_cents", "multas_total_cents", "marca_modelo", "alienacao_fiduciaria_status", "restricao_administrativa_ativa", "ipva_em_atraso", "debitos_em_aberto", "multas_em_aberto")


@query(f"WITH {FLAT} SELECT k AS doc_id, 'aberta' AS modo, true AS proprietario_nome_ofuscado FROM flat WHERE has_registry")
def x16e_lookup_mode(spark, sf_dir):
    return extract.extract_registry_lookup(_registry_texts(spark, sf_dir), mode="aberta").select("doc_id", "modo", "proprietario_nome_ofuscado")


# Further surfaces


@query(f"WITH {INTAKE} SELECT case_id, max(value) FILTER (WHERE doc_type = 'purchase' AND file_name = p) AS purchase, max(value) FILTER (WHERE doc_type = 'signup' AND file_name = s) AS signup FROM (SELECT *, max(file_name) FILTER (WHERE doc_type = 'purchase') OVER (PARTITION BY case_id) AS p, max(file_name) FILTER (WHERE doc_type = 'signup') OVER (PARTITION BY case_id) AS s FROM intake) GROUP BY case_id")
def k1_pivot_latest(spark, sf_dir):
    i = intake(spark, sf_dir).withColumnRenamed("value", "data")
    return C.pivot_latest(i, ("purchase", "signup")).select("case_id", "purchase", "signup")


@query(f"WITH {CHECKS} SELECT case_id, count(*) + count(*) FILTER (WHERE check_id = 'click') AS n, count(*) + count(*) FILTER (WHERE check_id = 'click') AS last_seq, count(*) FILTER (WHERE check_id = 'click') AS n_more FROM checks GROUP BY case_id")
def u1_union_checks(spark, sf_dir):
    c = event_checks(spark, sf_dir)
    more = c.where("check_id = 'click'").withColumn("check_id", F.lit("more"))
    return C.union_checks([c, more]).groupBy("case_id").agg(F.count("*").alias("n"), F.max("seq").cast("bigint").alias("last_seq"), F.count_if(F.col("check_id") == "more").alias("n_more"))


@query(f"WITH v AS ({SQL['v5_field_comparison']}) SELECT status, count(*) AS n FROM v GROUP BY status")
def g13_section_summary(spark, sf_dir):
    return v5_field_comparison(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH t AS ({casegen.TX_SQL}) SELECT doc_id, {KIND} AS strategy, count(*) AS n_tx, cast(0 AS bigint) AS n_discarded FROM t GROUP BY doc_id")
def g11_strategy_score(spark, sf_dir):
    found = statements.strategy_score(statements.candidates(statements.statement_lines(statement_texts(spark, sf_dir))))
    own = F.element_at(F.array(*(F.lit(n) for n, _ in statements.STRATEGIES)), (F.col("doc_id") % 6 + 1).cast("int"))
    return found.where(F.col("strategy") == own).select("doc_id", "strategy", "n_tx", "n_discarded")


def _simple(spark, sf_dir):
    tx = casegen.transactions(spark, sf_dir)
    line = F.concat_ws(" ", F.date_format("d", "dd/MM/yyyy"), F.lit("PIX COMPRA"), money.pt_br(F.col("cents") / 100))
    return tx.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))


@query(f"""WITH t AS ({casegen.TX_SQL}) SELECT doc_id, count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS n_tx, doc_id % 4 <> 0 AND count(*) > 0 AS has_pix,
  CASE doc_id % 3 WHEN 0 THEN 'Caixa' WHEN 1 THEN 'Banco do Brasil' END AS bank FROM t GROUP BY doc_id""")
def g12_transaction_rollup(spark, sf_dir):
    """Every fifth order's line is not in the simple layout and doesn't count."""
    tx = casegen.transactions(spark, sf_dir)
    what = F.when(F.col("doc_id") % 4 == 0, F.lit("TED COMPRA")).otherwise(F.lit("PIX COMPRA"))
    line = F.concat_ws(" ", F.when(F.col("o_orderkey") % 5 == 0, F.date_format("d", "dd/MM")).otherwise(F.date_format("d", "dd/MM/yyyy")), what, money.pt_br(F.col("cents") / 100))
    bank = F.when(F.col("doc_id") % 3 == 0, F.lit("caixa")).when(F.col("doc_id") % 3 == 1, F.lit("Banco do Brasil")).otherwise(F.lit("NUBANK"))
    texts = tx.groupBy("doc_id").agg(F.concat(F.lit("EXTRATO "), bank, F.lit("\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))
    return statements.transaction_rollup(texts)


@query(f"WITH t AS ({casegen.TX_SQL}) SELECT doc_id, strftime(d, '%d/%m/%Y') AS data, 'PIX COMPRA' AS descricao, cents FROM t")
def x8_extract_statement_simple(spark, sf_dir):
    got = statements.extract_statement_simple(_simple(spark, sf_dir))
    return got.select("doc_id", "data", "descricao", F.regexp_replace("valor", "[.,]", "").cast("bigint").alias("cents"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'cnh' WHEN doc_id % 5 = 2 THEN 'folha_pagamento' WHEN doc_id % 5 = 3 THEN 'extrato_bancario'
  ELSE {_listed(BY_WORDS_INTAKE)}[doc_id % 12 + 1] END AS doc_class FROM documents""")
def x2_classify_for_intake(spark, sf_dir):
    return extract.classify_for_intake(_opened(spark, sf_dir)).select("doc_id", "doc_class")


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) >= 800 THEN 'native' ELSE 'other' END AS chosen_from FROM documents")
def x3_text_source_policy(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("native"), F.concat(F.lit("x"), T.text("text")).alias("other"))
    return extract.text_source_policy(d).select("doc_id", "chosen_from")


def _licence_texts(spark, sf_dir):
    f = casegen.flat(spark, sf_dir).where("has_licence")
    text = F.concat(F.lit("CARTEIRA NACIONAL DE HABILITACAO\nNOME\n"), F.col("full_name"), F.lit("\n"), F.col("p_nasc"), F.lit(", CURITIBA, PR\nCPF "), F.col("cpf"), F.lit("\nVALIDADE 31/12/2031\nFILIACAO\nJOSE DA SILVA\nMARIA DE SOUZA\nPERMISSAO\n"))
    return f.select(F.col("k").alias("doc_id"), text.alias("text"))


@query(f"WITH {FLAT} SELECT k AS doc_id, full_name AS nome, cpf, p_nasc AS data_nascimento, '31/12/2031' AS validade, 'CURITIBA' AS cidade_nascimento, 'JOSE DA SILVA,MARIA DE SOUZA' AS pais, true AS low_signal FROM flat WHERE has_licence")
def x5_extract_licence(spark, sf_dir):
    got = extract.extract_licence(_licence_texts(spark, sf_dir))
    return got.select("doc_id", "nome", "cpf", "data_nascimento", "validade", "cidade_nascimento", F.array_join(F.array_sort("filiacao"), ",").alias("pais"), "low_signal")


def residence_texts(spark, sf_dir) -> DataFrame:
    """Labels with and without colon, tails behind address and town, and the due date in each of its readings."""
    f, k = casegen.flat(spark, sf_dir), F.col("k")
    t = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    holder = F.when(k % 3 == 0, t("CLIENTE: 6969640\nNOME DO CONSUMIDOR: ", F.col("full_name"))).when(k % 3 == 1, t("Nome do titular ", F.col("full_name"))).otherwise(t("NOME - ", F.col("full_name")))
    address = F.when(k % 2 == 0, t("\nENDEREÇO: Rua do Contrato Novo 7, ", k.cast("string"), " Cliente:6969640")).otherwise(t("\nEndereco Rua das Flores ", k.cast("string"), " UC 77 NOTA FISCAL 3"))
    town = F.when(k % 2 == 0, F.lit("\nCIDADE: CURITIBA - PR GRUPO / SUBGRUPO: B1")).otherwise(F.lit("\nCidade LAGES SC https://x.y/z"))
    due = (F.when(k % 5 == 0, t("DATA DE VENCIMENTO: ", F.col("p_nasc"))).when(k % 5 == 1, t("VENC. ", F.col("p_nasc"))).when(k % 5 == 2, t("PAGAR ATÉ ", F.col("p_nasc")))
           .when(k % 5 == 3, t("VENC EMIS 02/01/2039\nVENC da fatura em ", F.col("p_nasc"), " x")).otherwise(t("leitura ", F.col("p_nasc"), " proxima 01/01/2031")))
    return f.select(k.alias("doc_id"), t(holder, address, "\nCEP ", (80000 + k % 1000).cast("string"), "-000", town, "\nEMISSÃO 01/01/2040\n", due).alias("text"))


@query(f"WITH {FLAT} SELECT k AS doc_id, full_name AS nome_titular, CASE WHEN k % 2 = 0 THEN 'Rua do Contrato Novo 7, ' || k ELSE 'Rua das Flores ' || k END AS endereco, (80000 + k % 1000) || '-000' AS cep, CASE WHEN k % 2 = 0 THEN 'CURITIBA' ELSE 'LAGES' END AS cidade, CASE WHEN k % 2 = 0 THEN 'PR' ELSE 'SC' END AS uf, CASE WHEN k % 5 = 4 THEN '01/01/2031' ELSE p_nasc END AS vencimento FROM flat")
def x10_extract_residence(spark, sf_dir):
    return extract.extract_residence(residence_texts(spark, sf_dir))


def certificate_texts(spark, sf_dir) -> DataFrame:
    """Values on their labels' lines, or below them; one in four lacks years, colour and date."""
    f, k = casegen.flat(spark, sf_dir).where("has_vehicle"), F.col("k")
    t = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    nn = F.lpad((k % 100).cast("string"), 2, "0")
    same = t("QR CODE\nPLACA ABC1D", nn, " CODIGO RENAVAM ", F.col("renavam_ok"), "\nDENATRAN 11122233344\nMARCA/MODELO: VW GOL ", k.cast("string"), "\nANO FAB/MOD 2009/2010\nCHASSI 9BWZZZ377VT004251\nCATEGORIA PARTICULAR\nCOMBUST: FLEX\nCOR: PRATA\nPROPRIET: ", F.col("full_name"), " 529.982.247-25\nUF SC\nLOCAL: LAGES DATA 5/3/2024 6/4/2024")
    below = t("placa\nabc1d", nn, "\nrenavam\n", F.col("renavam_ok"), "\nMARCA/MODELO\nFIAT UNO\nchassi 9BWZZZ377VT004251\nCATEGORIA\nALUGUEL\nCOMBUST\nGASOLINA\nPROPRIET\n", F.col("full_name"), "\nUF\nPR\nLOCAL\nCURITIBA", F.when(k % 16 == 12, F.lit("")).otherwise(F.lit("\nANO FAB/MOD\n2015\nCOR\nAZUL\n15/12/2023")))
    return f.select(k.alias("doc_id"), F.when(k % 8 == 0, same).otherwise(below).alias("text"))


@query(f"""WITH {FLAT} SELECT k AS doc_id, 'ABC1D' || lpad((k % 100)::varchar, 2, '0') AS placa, renavam_ok AS renavam, '9BWZZZ377VT004251' AS chassi, CASE WHEN k % 8 = 0 THEN 'VW GOL ' || k ELSE 'FIAT UNO' END AS marca_modelo, CASE WHEN k % 8 = 0 THEN 'PARTICULAR' ELSE 'ALUGUEL' END AS categoria,
  CASE WHEN k % 8 = 0 THEN 'FLEX' ELSE 'GASOLINA' END AS combustivel, CASE WHEN k % 8 = 0 THEN 'PRATA' WHEN k % 16 = 4 THEN 'AZUL' END AS cor, full_name || CASE WHEN k % 8 = 0 THEN ' 529.982.247-25' ELSE '' END AS proprietario_nome, CASE WHEN k % 8 = 0 THEN 'SC' ELSE 'PR' END AS uf_licenciamento,
  CASE WHEN k % 8 = 0 THEN 'LAGES DATA 5/3/2024 6/4/2024' ELSE 'CURITIBA' END AS local_emissao, CASE WHEN k % 8 = 0 THEN '2009' WHEN k % 16 = 4 THEN '2015' END AS ano_fabricacao, CASE WHEN k % 8 = 0 THEN '2010' WHEN k % 16 = 4 THEN '2015' END AS ano_modelo,
  CASE WHEN k % 8 = 0 THEN '529.982.247-25' END AS proprietario_doc, CASE WHEN k % 8 = 0 THEN '05/03/2024' WHEN k % 16 = 4 THEN '15/12/2023' END AS data_emissao FROM flat WHERE has_vehicle""")
def x11_extract_vehicle_certificate(spark, sf_dir):
    return extract.extract_vehicle_certificate(certificate_texts(spark, sf_dir))


def vehicle_texts(spark, sf_dir) -> DataFrame:
    """The new layout (with and without labels), and old ones that only its readings see: spaces inside the plate, confused glyphs."""
    f, k = casegen.flat(spark, sf_dir).where("has_vehicle"), F.col("k")
    nn = F.lpad((k % 100).cast("string"), 2, "0")
    new = F.concat(F.lit("1980 x\nPlaca ABC10"), nn, F.when(k % 16 == 0, F.lit(" Renavam ")).otherwise(F.lit(" ")), F.col("renavam_ok"), F.lit(" chassi 9BWZZZ377VT004251\nANO FABRICAÇÃO/MODELO: 2009/2009 NOME "), F.col("full_name"), F.lit(" CPF 1"))
    spaced = F.concat_ws(" ", F.lit("PLACA: A B C 1 O"), F.substring(nn, 1, 1), F.substring(nn, 2, 1), F.lit("anos 2007 2008"))
    swapped = F.concat(F.lit("Placa: XYZIB"), nn)
    return f.select(k.alias("doc_id"), F.when(k % 8 == 0, new).when(k % 16 == 4, spaced).otherwise(swapped).alias("text"))


@query(f"""WITH {FLAT} SELECT k AS doc_id, CASE WHEN k % 8 = 0 THEN 'new' ELSE 'legacy' END AS layout, CASE WHEN k % 8 = 0 OR k % 16 = 4 THEN 'ABC10' ELSE 'XYZ18' END || lpad(cast(k % 100 AS varchar), 2, '0') AS placa, CASE WHEN k % 8 = 0 THEN renavam_ok WHEN k % 16 = 4 THEN '1' || lpad(cast(k % 100 AS varchar), 2, '0') || '20072008' END AS renavam,
  CASE WHEN k % 8 = 0 THEN '9BWZZZ377VT004251' WHEN k % 16 = 4 THEN 'PLACAABC1O' || lpad(cast(k % 100 AS varchar), 2, '0') || 'ANOS2' END AS chassi, CASE WHEN k % 8 = 0 THEN 2009 WHEN k % 16 = 4 THEN 2007 END::int AS ano_fabricacao, CASE WHEN k % 8 = 0 THEN 2009 WHEN k % 16 = 4 THEN 2008 END::int AS ano_modelo, CASE WHEN k % 8 = 0 THEN full_name END AS proprietario FROM flat WHERE has_vehicle""")
def x14_route_vehicle_document(spark, sf_dir):
    return extract.route_vehicle_document(vehicle_texts(spark, sf_dir))


@query(f"WITH {FLAT} SELECT case_id, CASE WHEN cpf_valid THEN 'ok' ELSE 'dv_mismatch' END AS cpf_reason, CASE WHEN cpf_valid THEN '' ELSE 'cpf:dv_mismatch,' END || CASE WHEN p_nome IS NULL THEN 'nome:missing,' ELSE '' END || CASE WHEN h_total IS NULL THEN 'total_vencimentos:missing,' ELSE '' END AS warnings FROM flat WHERE has_payslip")
def v2_payslip_soft_checks(spark, sf_dir):
    f = casegen.flat(spark, sf_dir).where("has_payslip").select("case_id", "cpf", F.col("p_nome").alias("nome"), F.col("h_total").alias("total_vencimentos"))
    return rules.payslip_soft_checks(f).select("case_id", "cpf_reason", F.array_join(F.transform("warnings", lambda x: F.concat(x, F.lit(","))), "").alias("warnings"))


@query(f"WITH {FLAT} SELECT case_id, {REN_OK('v_renavam')} AS dv_ok, CASE WHEN {REN_OK('v_renavam')} THEN 'ok' ELSE 'dv_mismatch' END AS reason FROM flat WHERE has_vehicle")
def v3_certificate_soft_checks(spark, sf_dir):
    f = casegen.flat(spark, sf_dir).where("has_vehicle").select("case_id", F.col("v_renavam").alias("renavam"))
    return rules.certificate_soft_checks(f).select("case_id", "dv_ok", "reason")


@query(f"WITH {FLAT}, d AS (SELECT case_id, k, CASE WHEN regexp_full_match(l_validade, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN try_strptime(l_validade, '%d/%m/%Y')::DATE END AS v FROM flat WHERE has_licence) SELECT case_id, CASE WHEN k % 3 = 0 THEN 'unknown_state,' ELSE '' END || CASE WHEN v IS NULL THEN 'expiry_missing,' ELSE '' END || CASE WHEN v < DATE '{TODAY}' + 30 THEN 'expiry_soon,' ELSE '' END AS critiques FROM d")
def v4_licence_critique(spark, sf_dir):
    f = casegen.flat(spark, sf_dir).where("has_licence").select("case_id", "cpf", F.when(F.col("k") % 3 == 0, F.lit("XX")).otherwise(F.lit("pr")).alias("uf"), F.col("l_validade").alias("validade"), F.col("p_nasc").alias("data_nascimento"))
    return rules.licence_critique(f, F.lit(TODAY).cast("date")).select("case_id", F.array_join(F.transform("critiques", lambda x: F.concat(x, F.lit(","))), "").alias("critiques"))


@query(f"WITH {FLAT} SELECT case_id, CASE WHEN k % 3 = 0 THEN 'unknown_state' ELSE '' END AS critiques FROM flat")
def v4_residence_critique(spark, sf_dir):
    f = casegen.flat(spark, sf_dir).select("case_id", F.when(F.col("k") % 3 == 0, F.lit("XX")).when(F.col("k") % 3 == 1, F.lit(" sc ")).alias("uf"))
    return rules.residence_critique(f).select("case_id", F.array_join("critiques", ",").alias("critiques"))


@query(f"WITH m AS ({SQL['v13_master_report']}), {FLAT} SELECT f.case_id, coalesce(overall_status, 'WARN') AS overall_status FROM flat f LEFT JOIN m ON f.case_id = m.case_id")
def v14_safe_master_report(spark, sf_dir):
    cases = casegen.flat(spark, sf_dir)
    return report.safe_master_report(cases, store(spark, sf_dir), F.lit(TODAY)).select("case_id", "overall_status")


@query(f"WITH {FLAT} SELECT case_id, 'nome,cpf' AS shown, '***.' || substr(cpf, 8, 4) AS cpf FROM flat WHERE has_licence")
def j3_project_whitelist(spark, sf_dir):
    f = casegen.flat(spark, sf_dir).where("has_licence")
    rows = f.select("case_id", F.lit("licence").alias("doc_type"), F.create_map(F.lit("other"), F.lit("x"), F.lit("cpf"), F.col("cpf"), F.lit("nome"), F.coalesce("l_nome", F.lit(""))).alias("fields"))
    return N.project_whitelist(rows).select("case_id", F.array_join(F.map_keys("shown"), ",").alias("shown"), F.element_at("shown", F.lit("cpf")).alias("cpf"))


@query(f"WITH {FLAT} SELECT case_id, p_compra AS valor_venda, '9BW' AS chassi FROM flat")
def j5_canonical_keys(spark, sf_dir):
    f = casegen.flat(spark, sf_dir).select("case_id", F.lit("").alias("chassi"), F.lit("9BW").alias("vin"), F.lit(None).cast("string").alias("valor_compra"), F.col("p_compra").alias("valor"))
    return rules.canonical_keys(f).select("case_id", "valor_venda", "chassi")


# Single operators over lines: texts of one registry-like document a case


def line_texts(spark, sf_dir) -> DataFrame:
    """doc_id and text, with labels on their line, below it and in sections."""
    f, k = casegen.flat(spark, sf_dir), F.col("k").cast("string")
    return f.select(F.col("k").alias("doc_id"), F.concat(
        F.lit("DENATRAN aviso\nMarca: FORD "), k, F.lit("\n\n  Cor  \nAZUL "), k, F.lit("\nEmpresa: X "), k, F.lit(" LTDA\nCPF\n"), F.col("cpf"), F.lit("\nDADOS DO VENDEDOR\nNome: "), F.col("full_name"), F.lit("\nitem 1\nitem "), k,
        F.lit("\nDADOS DO COMPRADOR\nNome: "), F.reverse("full_name"), F.lit("\nDébitos\n1) IPVA "), k, F.lit("\n2) taxa 1,00\nMultas\nsegurado DPVAT\nfim.")).alias("text"))


def _lines(spark, sf_dir) -> DataFrame:
    return L.explode_lines(line_texts(spark, sf_dir))


def _line_query(name: str, job, expected: str) -> None:
    """job: lines to (doc_id, value); expected: SQL over the flat cases."""
    def run(spark, sf_dir):
        return job(_lines(spark, sf_dir)).select("doc_id", "value")

    run.__name__ = name
    query(f"WITH {FLAT} SELECT k AS doc_id, {expected} AS value FROM flat")(run)


def _joined_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "|").alias("value"))


_line_query("l2_drop_noise_lines", lambda x: L.drop_noise_lines(x).groupBy("doc_id").agg(F.count("*").alias("value")), "cast(17 AS bigint)")
_line_query("l6_value_after_label", lambda x: L.value_after_label(x, "Cor"), "'AZUL ' || k")
_line_query("l7_tabular_value", lambda x: L.tabular_value(x, "Marca"), "'FORD ' || k")
_line_query("l8_label_colon_value", lambda x: L.label_colon_value(x, "EMPRESA"), "'X ' || k || ' LTDA'")
_line_query("l9_labelled_match", lambda x: L.labelled_match(x, ("CPF",), extract.CPF), "cpf")
_line_query("l10_slice_between", lambda x: _joined_lines(L.slice_between(x, ("DADOS DO VENDEDOR",), ("DADOS DO COMPRADOR",))), "'Nome: ' || full_name || '|item 1|item ' || k")
_line_query("l10_slice_from", lambda x: _joined_lines(L.slice_from(x, ("DADOS DO COMPRADOR",))), "'Nome: ' || reverse(full_name) || '|Débitos|1) IPVA ' || k || '|2) taxa 1,00|Multas|segurado DPVAT|fim.'")
_line_query("l11_block_after", lambda x: L.block_after(x, "Débitos"), "'1) IPVA ' || k || ' 2) taxa 1,00'")
_line_query("l15_text_window_before", lambda x: _joined_lines(L.text_window_before(x, "^DADOS DO COMPRADOR", 2)), "'item 1|item ' || k")


@query("WITH n AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, length(o_orderpriority) AS native_len FROM orders), o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, 2 * length(o_orderpriority) AS other_len FROM orders WHERE o_orderstatus = 'F') SELECT doc_id, page::int AS page, coalesce(native_len, 0)::int AS native_len, coalesce(other_len, 0)::int AS other_len FROM n FULL JOIN o USING (doc_id, page)")
def l16_merge_page_stats(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("text"), "o_orderstatus")
    numbered = lambda df: df.withColumn("page", F.row_number().over(L._by_doc()))
    native, other = numbered(o), numbered(o.where("o_orderstatus = 'F'")).withColumn("text", F.repeat("text", 2))
    return L.merge_page_stats(native, other)


@query("SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::int AS page, length(o_orderpriority)::int AS text_len FROM orders")
def l16_page_lengths(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("text"))
    return L.page_lengths(o)


def _licence_candidates(spark, sf_dir) -> DataFrame:
    """Four candidate texts of each licence: blank, a cover, the words alone, the whole text (which candidate it is varies)."""
    t = _licence_texts(spark, sf_dir)
    texts = F.array(F.lit("  "), F.lit("SENATRAN"), F.concat(F.lit("SECRETARIA NACIONAL "), F.substring("text", 1, 50)), F.col("text"))
    rows = t.select("doc_id", F.posexplode(texts).alias("n", "text"))
    return rows.select("doc_id", ((F.col("n") + F.col("doc_id")) % 4).alias("candidate"), "n", "text")


@query(f"WITH {FLAT}, n AS (SELECT unnest([0, 1, 2, 3]) AS n) SELECT k AS doc_id, n.n, CASE n.n WHEN 0 THEN -5 WHEN 1 THEN 2 - 5 WHEN 3 THEN 8 + 3 + 10 + 6 + 4 + 4 + 6 - 5 END AS score FROM flat, n WHERE has_licence AND n.n <> 2")
def w2_text_quality_score(spark, sf_dir):
    return extract.text_quality_score(_licence_candidates(spark, sf_dir)).where("n <> 2").select("doc_id", "n", "score")


@query(f"WITH {FLAT} SELECT k AS doc_id, 36 AS score, 'CARTEIRA NACIONAL' AS opening, true AS whole FROM flat WHERE has_licence")
def w3_best_text_candidate(spark, sf_dir):
    got = extract.best_text_candidate(_licence_candidates(spark, sf_dir))
    return got.select("doc_id", "score", F.substring("text", 1, 17).alias("opening"), F.endswith("text", F.lit("PERMISSAO")).alias("whole"))


@query("SELECT event_id FROM events WHERE event_type NOT IN ('signup', 'purchase')")
def x17_optional_doc_gate(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("doc_type"))
    return extract.optional_doc_gate(e, False, ("signup", "purchase")).select("event_id")


@query("SELECT doc_id, CASE WHEN trim(coalesce(CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE text END, '')) = '' THEN 'ExtractorError' WHEN doc_id % 4 = 1 THEN 'ParserError' END AS error FROM documents")
def x18_parse_outcome(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 4 != 1, F.lit("x")).alias("field"))
    return d.select("doc_id", parse_outcome("text", F.struct("field"))["type"].alias("error"))


@query("WITH l AS (SELECT o_custkey AS doc_id, count(DISTINCT (o_orderdate, round(o_totalprice * 100))) AS n FROM orders GROUP BY 1) SELECT doc_id, n FROM l")
def u4_distinct_transactions(spark, sf_dir):
    tx = casegen.transactions(spark, sf_dir)
    return tx.unionByName(tx).select("doc_id", "d", "cents").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {FLAT} SELECT case_id, CASE WHEN has_proposal THEN p_cpf END AS p_cpf, CASE WHEN has_licence THEN cpf END AS l_cpf, CASE WHEN has_vehicle THEN v_renavam END AS renavam FROM flat WHERE {HAS_ANY}")
def k6_enrich_left(spark, sf_dir):
    rows, _ = rules.planned(wide(spark, sf_dir), lambda: F.struct(rules.field("proposal", "cpf"), rules.field("licence", "cpf"), rules.field("vehicle_data", "renavam")))
    return rows.select("case_id", F.col("v__proposal__cpf__string").alias("p_cpf"), F.col("v__licence__cpf__string").alias("l_cpf"), F.col("v__vehicle_data__renavam__string").alias("renavam"))


def _event_lines(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("line"))


@query(f"WITH {FLAT} SELECT k AS doc_id, '1.666,44 -R$ 5,00 01/02/2020 LOJA ' || k AS line FROM flat")
def l3_normalize_statement_lines(spark, sf_dir):
    f = casegen.flat(spark, sf_dir)
    lines = f.select(F.col("k").alias("doc_id"), F.lit(0).alias("pos"), F.concat(F.lit("1. 666, 44  - R$ 5,00 01/02/2020LOJA "), F.col("k").cast("string")).alias("line"))
    return L.normalize_statement_lines(lines.unionByName(lines.withColumn("line", F.lit("  ")))).select("doc_id", "line")


@query(f"WITH {FLAT} SELECT k AS doc_id, x.pos, x.line FROM flat, LATERAL (SELECT unnest([0, 1, 2]) AS pos, unnest(['01/02/2020 a' || k || 'x', '03/04/2020 b', 'plain ' || k]) AS line) x")
def l4_explode_on_dates(spark, sf_dir):
    k = F.col("k").cast("string")
    rows = casegen.flat(spark, sf_dir).select(F.col("k").alias("doc_id"), F.posexplode(F.array(F.concat(F.lit("x 01/02/2020 a"), k, F.lit("x 03/04/2020 b")), F.concat(F.lit("plain "), k))).alias("pos", "line"))
    return L.explode_on_dates(rows)


@query("SELECT user_id AS doc_id, event_id AS pos, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events")
def l12_carry_forward_header(spark, sf_dir):
    header = F.when(F.col("line") == "signup", F.struct(F.col("pos").alias("at")))
    return L.carry_forward_header(_event_lines(spark, sf_dir), header, "h").select("doc_id", "pos", F.col("h.at").alias("header"))


@query("""WITH l AS (SELECT user_id AS doc_id, event_id AS pos, event_type AS line, event_type = 'signup' AS dated, event_id % 2 = 0 AS own, event_type = 'error' AS noise FROM events),
  n AS (SELECT *, lead(line) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  SELECT doc_id, pos, CASE WHEN own THEN line ELSE trim(line || CASE WHEN l1 IS NOT NULL AND l1 NOT IN ('signup', 'error') THEN ' ' || l1 ELSE '' END || CASE WHEN l1 <> 'signup' AND l2 IS NOT NULL AND l2 NOT IN ('signup', 'error') THEN ' ' || l2 ELSE '' END) END AS combined FROM n""")
def l13_row_assembly(spark, sf_dir):
    lines = _event_lines(spark, sf_dir)
    return L.row_assembly_lookahead(lines, F.col("line") == "signup", F.col("pos") % 2 == 0, F.col("line") == "error", F.col("line")).select("doc_id", "pos", "combined")


@query("""WITH l AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_type IN ('click', 'signup', 'purchase'))
  SELECT a.user_id AS doc_id, a.k, a.event_id::varchar AS date, b.event_id::varchar AS description, c.event_id::varchar AS value FROM l a JOIN l b USING (user_id, k) JOIN l c USING (user_id, k) WHERE a.event_type = 'click' AND b.event_type = 'signup' AND c.event_type = 'purchase'""")
def l14_columnar_zip(spark, sf_dir):
    lines = _event_lines(spark, sf_dir)
    mode = F.when(F.col("line") == "click", F.lit("date")).when(F.col("line") == "signup", F.lit("description")).when(F.col("line") == "purchase", F.lit("value"))
    return L.columnar_zip(lines, F.lit(0), mode, F.col("pos").cast("string")).select("doc_id", F.col("k").cast("long").alias("k"), "date", "description", "value")


@query(f"WITH {FLAT}, {INCOME} SELECT case_id, round(declared, 2) AS declared, round(proven, 2) AS proven FROM income WHERE {HAS_ANY}")
def g10_incomes(spark, sf_dir):
    rows, both = rules.planned(wide(spark, sf_dir), lambda: F.struct(rules.declared_income().alias("d"), rules.proven_income().alias("p")))
    return rows.select("case_id", F.round(both["d"], 2).alias("declared"), F.round(both["p"], 2).alias("proven"))


@query(f"WITH {FLAT} SELECT case_id, coalesce(CASE WHEN has_proposal THEN p_nome END, 'none') AS name, CASE WHEN has_registry THEN r_restricao END AS restricted FROM flat WHERE {HAS_ANY}")
def j1_variant_field(spark, sf_dir):
    w = wide(spark, sf_dir)
    return w.select("case_id", F.coalesce(rules.field("proposal", "absent", "nome_financiado"), F.lit("none")).alias("name"), rules.raw("registry_lookup", "restricao_administrativa_ativa", "boolean").alias("restricted"))


#: For each type of the dispatch query: its texts, the field shown, and what it must be as SQL with its condition.
DISPATCHED = {
    "proposal": (proposal_texts, "nome_financiado", "p_nome", "has_proposal"), "licence": (_licence_texts, "nome", "full_name", "has_licence"), "payslip": (payslip_texts, "nome", "full_name", "has_payslip"),
    "payroll": (payslip_texts, "cpf", "cpf", "has_payslip"), "residence_proof": (residence_texts, "nome_titular", "full_name", "true"), "vehicle_certificate": (certificate_texts, "renavam", "renavam_ok", "has_vehicle"),
    "vehicle_document": (vehicle_texts, "proprietario", "CASE WHEN k % 8 = 0 THEN full_name END", "has_vehicle"), "transfer": (transfer_texts, "vendedor_nome", "t_vendedor", "has_transfer"),
    "registry_lookup": (_registry_texts, "proprietario_nome", "CASE WHEN k % 25 = 0 THEN 'S*** F***' ELSE t_vendedor END", "has_registry"),
}


def mixed_texts(spark, sf_dir) -> DataFrame:
    """Texts of all types in one written table."""
    out = statement_texts(spark, sf_dir).select("doc_id", "text", F.lit("bank_statement").alias("doc_type"))
    for kind, (texts, *_) in DISPATCHED.items():
        out = out.unionByName(texts(spark, sf_dir).select(F.col("doc_id").cast(out.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(kind).alias("doc_type")))
    path = _folder(spark)
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


@query(f"WITH {FLAT}, t AS ({casegen.TX_SQL}) " + " UNION ALL ".join(f"SELECT k AS doc_id, '{kind}' AS doc_type, {value} AS shown, NULL::bigint AS n_tx FROM flat WHERE {when}" for kind, (_, _, value, when) in DISPATCHED.items()) + f" UNION ALL SELECT doc_id, 'bank_statement', {KIND}, count(*) FROM t GROUP BY doc_id")
def f1_extract_all(spark, sf_dir):
    """Every document type, bank statements among them, from one scan."""
    shown = F.try_variant_get("data", "$.estrategia", "string")
    for kind, (_, field, _, _) in DISPATCHED.items():
        shown = F.when(F.col("doc_type") == kind, F.try_variant_get("data", f"$.{field}", "string")).otherwise(shown)
    n = F.size(F.try_variant_get("data", "$.lancamentos", "array<variant>"))
    return extract.extract_all(mixed_texts(spark, sf_dir)).select("doc_id", "doc_type", shown.alias("shown"), F.when(F.col("doc_type") == "bank_statement", n).cast("long").alias("n_tx"))


# Sources and sinks, over files that are written from the tables to the shared folder


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/verifold/{uuid.uuid4().hex}"


def _written_store(spark, sf_dir) -> str:
    """One JSON file for each supplier: every third has data, every third null data, the others no object."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    value = F.when(k % 3 == 0, F.to_json(F.struct(F.struct(F.col("s_name").alias("nome")).alias("data")))).when(k % 3 == 1, F.lit('{"data": null}')).otherwise(F.lit("[1"))
    path = _folder(spark)
    rows = s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("case_id"), k.cast("string").alias("doc_type"), value.alias("value"))
    rows.repartition("doc_type").write.partitionBy("case_id", "doc_type").text(path)
    return path


def _suffixed(files: DataFrame) -> DataFrame:
    return files.withColumns({c: F.regexp_replace(c, "^.*=", "") for c in ("case_id", "doc_type")})


@query("SELECT 'n' || s_nationkey AS case_id, s_suppkey::varchar AS doc_type, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS nome, CASE WHEN s_suppkey % 3 = 2 THEN 'invalid_json' END AS read_error FROM supplier")
def a1_scan_document_store(spark, sf_dir):
    files = _suffixed(scan_document_store(spark, _written_store(spark, sf_dir), "*.txt"))
    got = classify_read(files)
    return got.select("case_id", "doc_type", F.try_variant_get("data", "$.nome", "string").alias("nome"), "read_error")


@query("SELECT e.event_type AS doc_type, 2 * count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events e GROUP BY 1")
def a3_append_documents(spark, sf_dir):
    path, rows = _folder(spark), intake(spark, sf_dir)
    for _ in range(2):
        append_documents(rows, path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("doc_type").agg(F.count("*").alias("n"), F.count_distinct("file_name").alias("n_distinct"))


@query("SELECT doc_id, length(coalesce(text, '')) AS text_len, CASE doc_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime_type, 4 * ceil(n_chars / 3.0)::bigint AS raw_b64_len, '2026-01-05' AS created_at, CASE WHEN trim(coalesce(text, '')) = '' THEN 'ExtractorError' END AS error FROM documents")
def a4_document_envelope(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("file_name", F.concat(F.lit("x."), F.element_at(F.array(*map(F.lit, ("PDF", "jpeg", "bin"))), (F.col("doc_id") % 3 + 1).cast("int")))).withColumn("raw_len", F.col("n_chars"))
    return document_envelope(d, F.lit(TODAY)).select("doc_id", F.col("text_len").cast("long").alias("text_len"), "mime_type", "raw_b64_len", "created_at", F.col("parse_error.type").alias("error"))


@query("SELECT s_suppkey::varchar AS doc_type, 'application/octet-stream' AS mime_type, CASE s_suppkey % 3 WHEN 0 THEN length('{\"data\":{\"nome\":\"' || s_name || '\"}}') WHEN 1 THEN 14 ELSE 2 END + 1 AS n_bytes FROM supplier")
def a5_file_inventory(spark, sf_dir):
    got = file_inventory(spark, _written_store(spark, sf_dir)).where(F.col("path").endswith(".txt"))
    return got.select(F.regexp_extract("path", "doc_type=([0-9]+)", 1).alias("doc_type"), "mime_type", "n_bytes")


@query("SELECT n_name AS name, 'NATION ' || n_nationkey || chr(10) || 'line two' AS text FROM nation")
def a8_scan_texts(spark, sf_dir):
    path = _folder(spark)
    n = read(spark, sf_dir, "nation")
    n.select("n_name", F.concat(F.lit("NATION "), F.col("n_nationkey").cast("string"), F.lit("\nline two")).alias("value")).repartition("n_name").write.partitionBy("n_name").text(path)
    got = scan_texts(spark, f"{path}/*")
    return got.select(F.concat(F.lit("NATION_"), F.regexp_extract("text", r"NATION (\d+)", 1)).alias("name"), F.regexp_replace("text", r"\n$", "").alias("text"))


def _reports_written(spark, sf_dir) -> str:
    path = f"{_folder(spark)}/reports"
    rows = report.master_report(store(spark, sf_dir), F.lit(TODAY))
    write_reports(rows, path, 16)
    write_reports(rows, path, 16)  # a rerun replaces what is there
    return path


@query(f"WITH m AS ({SQL['v13_master_report']}) SELECT case_id, overall_status, 1::bigint AS n FROM m")
def a6_write_reports(spark, sf_dir):
    path = _reports_written(spark, sf_dir)
    rows = spark.read.schema("case_id string, overall_status string, bucket int").json(path)
    return rows.groupBy("case_id").agg(F.first("overall_status").alias("overall_status"), F.count("*").alias("n"))


@query(f"WITH {FLAT} SELECT case_id, 'proposal' AS doc_type, p_nome AS nome FROM flat WHERE has_proposal UNION ALL SELECT case_id, 'licence', l_nome FROM flat WHERE has_licence")
def a7_load_report_inputs(spark, sf_dir):
    s = store(spark, sf_dir)
    reports = report.master_report(s, F.lit(TODAY)).select("case_id", "inputs")
    got = load_report_inputs(reports, s).where("doc_type in ('proposal', 'licence')")
    return got.select("case_id", "doc_type", F.coalesce(F.try_variant_get("data", "$.nome_financiado", "string"), F.try_variant_get("data", "$.nome", "string")).alias("nome"))


INCOMING = "case_id string, doc_type string, file_name string, path string, raw string"


@query(SQL["v13_master_report"])
def t1_stream_intake(spark, sf_dir):
    """Documents arrive in files, some twice, over several batches; the current reports are those of a batch run."""
    base = _folder(spark)
    docs = casegen.store(casegen.flat(spark, sf_dir))
    docs.repartition(3, "case_id", "doc_type").write.json(f"{base}/in")
    docs.where("substring(case_id, 2, 9) % 4 = 0").repartition(1).write.mode("append").json(f"{base}/in")
    evaluate = lambda rows: _shown(report.master_report(classify_read(rows), F.lit(TODAY)))
    stream_intake(spark, f"{base}/in", INCOMING, f"{base}/store", f"{base}/reports", evaluate, f"{base}/checkpoint", 16, files_per_batch=2).awaitTermination()
    return current(spark, f"{base}/reports").drop("generation")


@query(SQL["v13_master_report"])
def a6_report_generations(spark, sf_dir):
    """Reports of all cases as a first generation, a third of them wrong; those cases again, folded into a base, and the old ones deleted."""
    path, reports = f"{_folder(spark)}/reports", v13_master_report(spark, sf_dir)
    third = F.substring("case_id", 2, 9).cast("long") % 3 == 0
    publish(reports.withColumn("overall_status", F.when(third, F.lit("OK")).otherwise(F.col("overall_status"))), path, "first")
    publish(reports.where(third), path, "second")
    publish(reports.where("false"), path, "second")  # a batch that is run again
    compact(spark, path, 8)
    vacuum(spark, path)
    return current(spark, path).drop("generation")


@query(SQL["v13_master_report"])
def a3_variant_store(spark, sf_dir):
    """Documents as shredded VARIANT at rest; reports from just the fields that rules read."""
    path = f"{_folder(spark)}/store"
    append_variants(store(spark, sf_dir).drop("raw"), path)
    return _shown(report.master_report(spark.read.parquet(path), F.lit(TODAY), only_asked=True))


@query("SELECT 'n' || s_nationkey AS case_id, arg_max(s_name, s_suppkey) AS nome, count(*) AS n_docs FROM supplier GROUP BY 1")
def a1_ingest_newest(spark, sf_dir):
    """Three files a supplier's nation and more: only the newest of each case is opened."""
    s = read(spark, sf_dir, "supplier")
    root = _folder(spark)
    names = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".d"))
    rows = s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("case_id"), names.alias("doc_type"), F.to_json(F.struct(F.struct(F.col("s_name").alias("nome")).alias("data"))).alias("value"))
    rows.repartition("doc_type").write.partitionBy("case_id", "doc_type").text(root)
    listed = list_documents(spark, root, pattern="*.txt")
    # The folder is the supplier here, so it stands for the file's name.
    value = lambda c: F.regexp_replace(c, "^[^=]*=", "")
    newest = newest_documents(listed.select(value("case_id").alias("case_id"), F.lit("x").alias("doc_type"), value("doc_type").alias("file_name"), "path", "n_bytes"))
    parts = F.split("path", "/")
    files = newest.withColumns({"own": F.col("case_id"), "case_id": F.element_at(parts, -3), "doc_type": F.element_at(parts, -2), "file_name": F.element_at(parts, -1)})
    return classify_read(read_listed(files)).select(F.col("own").alias("case_id"), F.try_variant_get("data", "$.nome", "string").alias("nome"), "n_docs")


def _raising():
    """A family that raises for some cases."""
    fails = F.substring("case_id", 2, 9).cast("long") % 700 == 7
    return F.when(fails, F.raise_error(F.lit("unreadable")).cast(rules.CHECK)).otherwise(F.array().cast(rules.CHECK))


@query(f"SELECT case_id, CASE WHEN substr(case_id, 2)::bigint % 700 = 7 THEN 'WARN' ELSE overall_status END AS overall_status, CASE WHEN substr(case_id, 2)::bigint % 700 = 7 THEN 1 ELSE n_ok + n_warn + n_missing + n_fail END AS n_checks, substr(case_id, 2)::bigint % 700 = 7 AS failed FROM ({SQL['v13_master_report']})")
def v14_isolated_report(spark, sf_dir):
    """One family raises for a few cases: these get the minimal report, all others their own."""
    r = report.isolated_report(store(spark, sf_dir), F.lit(TODAY), _folder(spark), [*rules.FAMILIES, _raising])
    return r.select("case_id", "overall_status", F.size("checks").cast("long").alias("n_checks"), F.exists("checks", lambda c: c["check_id"] == report.FAULT).alias("failed"))


def _raising_strategy(lines):
    """The layout of lines that end with their value, raising for some documents."""
    rows, own = statements.line_end_value(lines)
    return rows.withColumn("line", F.when(F.col("doc_id") % 300 == 6, F.raise_error(F.lit("unreadable")).cast("string")).otherwise(F.col("line"))), own


@query(SQL["x9_extract_statement"].replace("CASE doc_id % 6 WHEN 0 THEN 'line_end_value'", "CASE doc_id % 6 WHEN 0 THEN CASE WHEN doc_id % 300 = 6 THEN 'date_last_value' ELSE 'line_end_value' END").replace("WHEN doc_id % 6 = 0 THEN -cents", "WHEN doc_id % 6 = 0 AND doc_id % 300 <> 6 THEN -cents"))
def f2_isolated_strategies(spark, sf_dir):
    """The first strategy raises for a few documents: there another one that reads them wins, without the sign it knows of."""
    chosen = [("line_end_value", _raising_strategy), *statements.STRATEGIES[1:]]
    got = statements.extract_statement_isolated(statement_texts(spark, sf_dir), _folder(spark), chosen)
    return got.select("doc_id", "strategy", "data", F.round(F.col("valor") * 100).cast("bigint").alias("cents"))


def queries() -> dict:
    return {**QUERIES, **probes.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**SQL, **probes.SQL}
