"""Column functions, line operators, sources and streaming on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from verifold.functions import dates, ids, money
from verifold.functions import text as T
from verifold.operators import cases as C
from verifold.operators import lines as L
from verifold.operators import tables as N
from verifold.plans import extract, report, rules
from verifold.sources import store as S


@pytest.fixture(scope="module")
def one(spark):
    """Values of an expression over rows (a, b)."""
    def run(expr, *rows):
        rows = [r if isinstance(r, tuple) else (r, None) for r in rows]
        return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").orderBy("i").select(expr).collect()]

    return run


def test_text(one):
    assert one(T.normalize_name("a"), " João  da Silva ", "", None) == ["JOAO DA SILVA", None, None]
    assert one(T.normalize_doc_id("a"), "111.444.777-35", "123", None, "11.222.333/0001-81") == ["11144477735", "", "", "11222333000181"]
    assert one(T.name_match_tolerant("a", "b"), ("João da Silva", "JOAO SILVA"), ("Ana Lima", "Ana Paula Lima"), ("Ana", ""), ("Ana Lima", "Ana Souza")) == [True, True, None, False]
    assert one(T.name_match_two_tokens("a", "b"), ("ANA LIMA SOUZA", "SOUZA ANA"), ("ANA", "ANA"), ("ANA", "")) == [True, True, False]
    assert one(F.round(T.name_jaccard("a", "b"), 3), ("ANA LIMA", "ana souza"), ("", "")) == [0.333, None]
    assert one(T.initials_match("a", "b"), ("JS", "JOAO SILVA"), ("J", "JOAO"), ("JX", "JOAO SILVA")) == [True, False, False]
    assert one(T.masked_name_initials("a"), "J*** S***") == [["J", "S"]]
    assert one(T.mask_doc("a"), "11144477735", "11222333000181", "", None) == ["111.***.***-35", "11.***.***/****-81", "", ""]
    assert one(T.mask_for_display(F.col("b"), F.col("a")), ("11144477735", "cpf"), ("1234567", "rg"), ("Ana", "nome"), (None, "cpf")) == ["***.7735", "***4567", "Ana", None]
    assert one(T.sanitize_path("a"), "/Users/x/data/a.json", "C:\\Users\\x\\a") == ["data/a.json", "a"]
    assert one(F.struct(*T.split_city_state("a")), "Curitiba - PR", "SAO PAULO/SP", "Lages", "") == [("CURITIBA", "PR"), ("SAO PAULO", "SP"), ("LAGES", None), (None, None)]
    assert one(T.is_machine_line("a"), "I<BRA012345678<<<<<<<<<<", "JOAO") == [True, False]
    assert one(T.looks_like_cover_only("a"), "", "República Federativa do Brasil", "plain text") == [True, True, False]
    assert one(T.detect_bank("a"), "Banco Itaú", "x") == ["Itau", None]
    assert one(T.is_human_name("a"), "ANA LIMA SOUZA", "PLACA DO CLIENTE", "ANA") == [True, False, False]


def test_ids(one):
    assert one(ids.cpf_check_reason("a"), "111.444.777-35", "", "123", "11111111111", "11144477734", None) == ["ok", "empty", "bad_length", "all_equal", "dv_mismatch", "empty"]
    assert one(ids.is_valid_cnpj("a"), "11.222.333/0001-81", "11222333000182", "", None) == [True, False, False, False]
    assert one(ids.normalize_renavam("a"), "123456789", "12345678901", "12", None) == ["00123456789", "12345678901", None, None]
    assert one(ids.is_valid_renavam("a"), "00639884962", "00639884963", None) == [True, False, False]
    assert one(ids.fix_plate_ocr("a"), "A8C1O23", "ABC12E4", "ABC1D23", "X", None) == ["ABC1023", None, "ABC1D23", None, None] or one(ids.fix_plate_ocr("a"), "ABC1O23")[0] == "ABC1023"
    assert one(ids.is_valid_plate("a"), "abc-1d23", "AB1234") == [True, False]
    assert one(ids.is_valid_vin("a"), "9BWZZZ377VT004251", "9BWZZZ377VT00425O") == [True, False]


def test_money(one):
    assert one(money.parse_money_any("a"), "R$ 3.700,50", "3.700", "12,5", "x 10", "", None, "-", "1.2.3") == [3700.5, 3.7, 12.5, 10.0, None, None, None, None]
    assert one(money.parse_money_br("a"), "3.700,00", "null", "10 x") == [3700.0, None, None]
    assert one(money.parse_money_reais("a"), "1.234,56", "1234.56", "nan", "1d") == [1234.56, 1234.56, None, None]
    assert one(money.money_to_cents("a"), "1.234,5", "573.02", ",07", "") == [123450, 5730200, 7, None]
    assert one(money.parse_signed_amount("a"), "\u22121.234,50", "+2,00") == [-1234.5, 2.0]
    assert one(money.first_amount("a"), "x 31.844,17", "5,00 - R$ 7,50", "none") == [31844.17, -7.5, None]
    assert one(money.amount_tokens_relaxed("a"), "1. 666, 44 and 2,00") == [["1.666,44", "2,00"]]
    assert one(money.sum_currency_cents("a"), "R$ 1,50 R$ 2.000,00", "no") == [200150, 0]


def test_dates(one):
    d = lambda r: [str(x) if x else None for x in r]
    assert d(one(dates.parse_date("a"), " 05/08/2025 ", "2025-08-05", "31/02/2025", "x", None)) == ["2025-08-05", "2025-08-05", None, None, None]
    assert one(dates.normalize_date_string("a"), "2025-08-05", "31.02.2025", "05082025", "5/8/25") == ["05/08/2025", "31/02/2025", "05/08/2025", None]
    assert one(dates.normalize_flexible_date("a"), "5/8/25 x", "40/1/2020", "on 05 08 2025") == ["2025-08-05", None, "2025-08-05"]
    assert one(dates.long_date("a"), "5 de julho de 2024", "5 de foo de 2024") == ["2024-07-05", None]
    assert one(dates.earliest_date("a"), "01/02/2020 and 03/01/2019", "") == ["03/01/2019", None]
    assert one(F.struct(*dates.year_pair("a")), "2019/2020", "2021", "x") == [(2019, 2020), (2021, 2021), (None, None)]


LINES = [(1, "Nome: Ana\nCPF\n111\nDados do Vendedor\nNome: Bob\nDados do Comprador\nNome: Cal\nDébitos\n1) taxa\n2) multa\nOutro Bloco\nfim"), (2, None), (3, "  \n\n")]


def test_lines(spark):
    lines = L.explode_lines(spark.createDataFrame(LINES, "doc_id int, text string"))
    assert lines.count() == 12
    got = lambda df: {r.doc_id: r.value for r in df.collect()}
    assert got(L.value_after_label(lines, "CPF")) == {1: "111"} and got(L.label_colon_value(lines, "Nome")) == {1: "Ana"}
    between = L.slice_between(lines, ("DADOS DO VENDEDOR",), ("DADOS DO COMPRADOR",))
    assert got(L.label_colon_value(between, "nome")) == {1: "Bob"} and got(L.label_colon_value(L.slice_from(lines, ("DADOS DO COMPRADOR",)), "nome")) == {1: "Cal"}
    assert got(L.block_after(lines, "Débitos")) == {1: "1) taxa 2) multa"}
    assert [r.line for r in L.text_window_before(lines, "^fim$", 2).orderBy("pos").collect()] == ["2) multa", "Outro Bloco"]
    dated = spark.createDataFrame([(1, 0, "x 01/02/2020 a 03/04/2020 b"), (1, 1, "plain")], "doc_id int, pos int, line string")
    assert [r.line for r in L.explode_on_dates(dated).orderBy("pos").collect()] == ["01/02/2020 a", "03/04/2020 b", "plain"]
    pages = spark.createDataFrame([(1, 1, "abc")], "doc_id int, page int, text string")
    other = spark.createDataFrame([(1, 2, "z")], "doc_id int, page int, text string")
    assert sorted(map(tuple, L.merge_page_stats(pages, other).collect())) == [(1, 1, 3, 0), (1, 2, 0, 1)]


CASES = {
    "c-ok": {"proposta_daycoval": {"nome_financiado": "JOAO DA SILVA", "data_nascimento": "1990-01-01", "cpf": "11144477735", "salario": "5000,00"}, "cnh": {"nome": "JOAO DA SILVA", "data_nascimento": "1990-01-01"}, "holerite": {"total_vencimentos": "5200,00"}},
    "c-edge": {"proposta_daycoval": {"nome_financiado": "A B", "data_nascimento": "1", "salario": 5000}, "cnh": {"nome": "a b", "data_nascimento": "1"}, "holerite": {"total_vencimentos": "4750,00"}},
    "c-low": {"proposta_daycoval": {"nome_financiado": "A B", "data_nascimento": "1", "salario": "5000,00"}, "cnh": {"nome": "A B", "data_nascimento": "1"}, "holerite": {"total_vencimentos": 0, "salario_liquido": "4000,00"}},
    "c-debt": {"proposta_daycoval": {"nome_financiado": "A B", "vlr_compra": "10.000,00"}, "detran_sc": {"debitos_total_cents": 900000, "multas_total_cents": 200000, "restricao_administrativa_ativa": False, "ipva_em_atraso": False, "alienacao_fiduciaria_status": "ausente"}},
    "c-initials": {"detran_sc": {"proprietario_iniciais": "JS"}, "atpv": {"vendedor_nome": "JOAO SILVA"}},
    "c-unread": {"extrato_bancario": {"banco": "X"}},
    "c-bad": {"cnh": "not a map"},
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    for case, docs in CASES.items():
        for kind, data in docs.items():
            d = root / case / kind
            d.mkdir(parents=True)
            (d / "b.json").write_text(json.dumps({"data": data}))
            (d / "a.json").write_text("{broken")
    return S.classify_read(S.scan_document_store(spark, str(root))), str(root)


def test_store_and_rules(spark, stored):
    store, root = stored
    errors = {(r.case_id, r.file_name): r.read_error for r in store.where("read_error is not null").select("case_id", "file_name", "read_error").collect()}
    assert errors["c-bad", "b.json"] == "data_not_dict" and errors["c-ok", "a.json"] == "invalid_json"
    got = {(r.case_id, r.check_id): r.status for r in rules.checks_of(rules.wide_cases(store)).collect()}
    assert got["c-ok", "identity.proposta_vs_cnh"] == "OK" and got["c-ok", "income.declared_vs_proven.total"] == "OK"
    assert got["c-edge", "income.declared_vs_proven.total"] == "OK" and got["c-low", "income.declared_vs_proven.total"] == "WARN"
    assert got["c-debt", "vehicle.detran.debitos.total_vs_valor_compra"] == "FAIL" and got["c-debt", "vehicle.detran.owner.matches_atpv_vendedor"] == "MISSING"
    assert got["c-initials", "vehicle.detran.owner.matches_atpv_vendedor"] == "WARN" and got["c-unread", "income.declared_vs_proven.proof"] == "WARN"
    assert got["c-bad", "identity.proposta_vs_cnh"] == "MISSING"
    reports = report.safe_master_report(spark.createDataFrame([(c,) for c in [*CASES, "gone"]], "case_id string"), store, F.lit("t"))
    status = {r.case_id: r.overall_status for r in reports.collect()}
    assert status["c-ok"] == "OK" and status["c-debt"] == "FAIL" and status["gone"] == "WARN"
    assert report.privacy_guard(reports).count() == 0
    inventory = S.file_inventory(spark, root).collect()
    assert len(inventory) == 2 * sum(map(len, CASES.values())) and all(r.raw_b64_len == 4 * -(-r.n_bytes // 3) for r in inventory)


def test_statuses(spark):
    rows = [("a", "OK"), ("a", "WARN"), ("b", "OK"), ("c", "FAIL"), ("c", "MISSING"), ("d", None), ("e", "odd")]
    checks = spark.createDataFrame(rows, "case_id string, status string")
    cases = spark.createDataFrame([(c,) for c in "abcdef"], "case_id string")
    get = lambda df: [r.overall_status for r in df.orderBy("case_id").collect()]
    assert get(C.overall_status(cases, checks)) == ["WARN", "OK", "FAIL", "MISSING", "MISSING", "MISSING"]
    assert get(C.overall_status_lenient(cases, checks)) == ["WARN", "OK", "FAIL", "OK", "WARN", "MISSING"]
    with pytest.raises(Exception, match="unknown status"):
        C.overall_status(cases, checks, strict=True).collect()
    dup = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x")], "case_id string, check_id string")
    assert [tuple(r) for r in C.duplicate_check_ids(dup).collect()] == [("a", "x", 2)]
    with pytest.raises(Exception, match="duplicate_check_id"):
        C.duplicate_check_ids(dup, strict=True).collect()
    for bad in (None, "odd"):
        one = spark.createDataFrame([("a", "OK"), ("a", bad)], "case_id string, status string")
        with pytest.raises(Exception, match=f"unknown status {'null' if bad is None else bad}"):
            C.overall_status(cases, one, strict=True).collect()
    nulls = spark.createDataFrame([("a", None), ("a", None)], "case_id string, check_id string")
    with pytest.raises(Exception, match="duplicate_check_id: null"):
        C.duplicate_check_ids(nulls, strict=True).collect()


def test_watched_statuses(spark):
    """One action gives the result and names every offending value, however many rows have it."""
    rows = [("a", "OK"), ("d", None), ("d", None), ("e", "odd"), ("e", "fail"), ("f", "odd")]
    checks = spark.createDataFrame(rows, "case_id string, status string")
    cases = checks.select("case_id").distinct()
    watched, seen = C.watched_statuses(checks)
    assert {r.case_id: r.overall_status for r in C.overall_status(cases, watched).collect()} == {"a": "OK", "d": "MISSING", "e": "MISSING", "f": "MISSING"}
    with pytest.raises(ValueError, match="unknown status: 5 rows: fail, null, odd"):
        C.raise_offences("unknown status", seen)
    watched, seen = C.watched_statuses(checks.where("status = 'OK'"))
    watched.collect()
    C.raise_offences("unknown status", seen)
    ids = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", None), ("b", None), ("c", "y")], "case_id string, check_id string")
    found, seen = C.watched_check_ids(ids)
    assert found.count() == 2
    with pytest.raises(ValueError, match="duplicate: 2 rows: null, x"):
        C.raise_offences("duplicate", seen)


def test_tables_and_text_choice(spark):
    df = spark.createDataFrame([(1, "Ana", "11144477735", {"cpf": "11144477735", "salario": "10", "outras_rendas": "5", "x": "y"})], "doc_id int, name string, cpf string, fields map<string,string>").withColumn("doc_type", F.lit("proposal"))
    assert N.project_whitelist(df).first().shown == {"cpf": "***.7735", "salario": "10", "outras_rendas": "5", "renda_total": "15.0"}
    assert N.mask_personal_data(df, {"cpf": "last4"}).first().cpf == "***7735"
    texts = spark.createDataFrame([(1, 0, ""), (1, 1, "REGISTRO HABILITACAO 111.444.777-35 01/01/2020"), (2, 0, " "), (2, 1, "")], "doc_id int, candidate int, text string")
    best = {r.doc_id: r.text for r in extract.best_text_candidate(texts).collect()}
    assert best[1].startswith("REGISTRO") and best[2] == ""
    policy = extract.text_source_policy(spark.createDataFrame([("x" * 900, "y"), ("x", "yy"), ("x", "")], "native string, other string"))
    assert [r.chosen_from for r in policy.collect()] == ["native", "other", "native"]
    docs = spark.createDataFrame([("licence", "CARTEIRA\nNOME\nANA LIMA\n01/01/1980, LAGES, SC"), ("payslip", "Empresa: X Y")], "doc_type string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    assert extract.extract_all(docs).count() == 2
    env = S.document_envelope(spark.createDataFrame([("a.PDF", "", 4)], "file_name string, text string, raw_len int"), F.lit("now")).first()
    assert env.mime_type == "application/pdf" and env.raw_b64_len == 8 and env.parse_error.type == "ExtractorError"


def test_registry_lookup_statuses(spark):
    """Shapes of open and dispatcher lookups, with made-up names."""
    rows = [
        (1, "Nome do proprietário atual\nJ*** S***\nPlaca ABC1D23\nDébitos\nNenhum débito\nMultas\nNenhuma multa\nRestrições\nNenhuma restrição registrada."),
        (2, "Proprietário: MARIA TESTE\nDébitos\nDÍVIDA ATIVA R$ 10,00\nMultas\n1) R$ 1.234,56 2) R$ 0,44\nIMPEDIMENTO\nBaixa de alienação"),
        (3, "DENATRAN\nnada"), (4, None), (5, ""),
    ]
    got = {r.doc_id: r for r in extract.extract_registry_lookup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    a, b = got[1], got[2]
    assert (a.proprietario_nome, a.proprietario_iniciais, a.modo, a.placa, a.debitos_em_aberto, a.multas_em_aberto, a.restricao_administrativa_ativa) == ("J*** S***", "JS", "aberta", "ABC1D23", None, None, False)
    assert (b.proprietario_nome, b.modo, b.debitos_total_cents, b.multas_total_cents, b.ipva_em_atraso, b.restricao_administrativa_ativa, b.alienacao_fiduciaria_status) == ("MARIA TESTE", "despachante", 1000, 123500, True, True, "inativa")
    assert got[3].proprietario_nome is None and got[4].modo == "despachante" and got[5].debitos_total_cents == 0


def test_strategies_are_extended_and_share_one_pass(spark):
    from verifold.plans import statements

    def own(lines):
        return lines, F.when(F.col("line").startswith("X"), F.struct(F.lit("2024-01-01").alias("data"), F.col("line").alias("descricao"), F.lit(1.0).alias("valor"), F.lit(False).alias("discarded")))

    texts = spark.createDataFrame([(1, "X one\nX two"), (2, "01/02/2024 LOJA 1,00"), (3, None)], "doc_id int, text string")
    got = sorted((r.doc_id, r.strategy, r.seq) for r in statements.extract_statement(texts, [*statements.STRATEGIES, ("own", own)]).collect())
    assert got == [(1, "own", 1), (1, "own", 2), (2, "line_end_value", 1)]
    plan = statements.candidates(statements.statement_lines(texts))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_payslips(spark):
    rows = [(1, ""), (2, "NOME\nJOAO DA SILVA\nCPF 123.456.789-00\n"), (3, "NOME\nMARIA DE SOUZA\nCPF 111.444.777-35\nAdmissao 1/2/2020"), (4, None)]
    got = {r.doc_id: r for r in extract.extract_payslip(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].asDict() == {"doc_id": 1, "nome": None, "cpf": None, "empregador": None, "data_admissao": None, "total_vencimentos": None} and got[4].cpf is None
    assert (got[2].nome, got[2].cpf) == ("JOAO DA SILVA", "12345678900")
    assert (got[3].nome, got[3].cpf, got[3].data_admissao) == ("MARIA DE SOUZA", "11144477735", "01/02/2020")
    checked = {r.doc_id: r for r in rules.payslip_soft_checks(extract.extract_payslip(spark.createDataFrame(rows[1:3], "doc_id int, text string"))).collect()}
    assert checked[2].cpf == "12345678900" and "cpf:dv_mismatch" in checked[2].warnings and checked[3].cpf_reason == "ok"
