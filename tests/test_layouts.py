"""Extraction over literal texts in the printed layouts, field by field, and the plan of the dispatch."""

import pytest
from pyspark.sql import functions as F

from verifold.functions import dates
from verifold.functions import text as T
from verifold.plans import extract, rules


def one(spark, job, text):
    row = job(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().asDict()
    row.pop("doc_id")
    return row


PROPOSAL = """PLANILHA DE PROPOSTA
Proposta: 12345678 LOJA: AUTO CENTRO SUL DIVERSOS: 1
FINANCIADO: ANA LIMA\u00a0SILVA (111.444.777-35F)
Data de Nasc.: 01/02/1990
Naturalidade: SÃO JOSÉ UF Naturalidade: SC
Fil. Pai: JOSE Fil. Mãe: MARIA DE
SOUZA Qtde Dependentes: 0

LIMA
Nome Cônjuge: PEDRO
Endereço: RUA DAS FLORES Nº . :35 Compl.: apto 3 Cep: 88000-000
Empresa: ACME LTDA C.N.P.J: 1
Data Adm.: 03/04/2015 Cargo: VENDEDOR
Salário: 3.500,00 Outras Rendas: 500,00 Vlr. Parcela: 700,10
Vlr. Compra: R$ 45.000,00
"""


def test_proposal(spark):
    got = one(spark, extract.extract_proposal, PROPOSAL)
    assert got == {
        "proposta": "12345678", "nome_financiado": "ANA LIMA SILVA", "nome_loja": "AUTO CENTRO SUL", "cpf": "11144477735", "data_nascimento": "01/02/1990", "cidade_nascimento": "SÃO JOSÉ", "uf": "SC", "nome_mae": "MARIA DE SOUZA LIMA",
        "endereco": "RUA DAS FLORES", "numero": "35", "complemento": "APTO 3", "empresa": "ACME LTDA", "data_admissao": "03/04/2015", "salario": "3.500,00", "outras_rendas": "500,00", "valor_parcela": "700,10", "valor_compra": "45.000,00",
    }
    assert set(one(spark, extract.extract_proposal, None).values()) == {None}


@pytest.mark.parametrize("below,name", [("Qtde Dependentes: 0\nDA LUZ\nX", "ROSA DA LUZ"), ("Qtde: 0\n\n\n\n\n\nLIMA", "ROSA"), ("Qtde\nEndereço: R\nLIMA", "ROSA"), ("Qtde\nSEU CEP\nLIMA", "ROSA"), ("Qtde\nLIMA 3", "ROSA"), ("Qtde\n" + "A" * 41, "ROSA"), ("Qtde\nDEPENDENTES MENORES\nD'AVILA-REIS", "ROSA D'AVILA-REIS"), ("Qtde\nX", "ROSA")])
def test_mother(spark, below, name):
    assert one(spark, extract.extract_proposal, f"Fil.Mãe: ROSA {below}")["nome_mae"] == name


def test_residence(spark):
    text = "CLIENTE: 6969640\nNOME DO CONSUMIDOR ANA LIMA\nENDEREÇO: Rua do Contrato Novo 7 Cliente:6969640\nCIDADE: LAGES SC GRUPO / SUBGRUPO: B\nCEP 88500-000\nEMISSÃO 01/01/2040\nVENC EMIS 01/01/2041\n2a VENC em 05/06/2024\n07/08/2030"
    assert one(spark, extract.extract_residence, text) == {"nome_titular": "ANA LIMA", "endereco": "Rua do Contrato Novo 7", "cep": "88500-000", "cidade": "LAGES", "uf": "SC", "vencimento": "05/06/2024"}


def test_certificate(spark):
    text = "DENATRAN 99999999999\nPLACA\nABC1D23 12345678900\nMARCA/MODELO\nVW GOL\nANO FAB/MOD: 2009/2010\n9BWZZZ377VT004251\nCATEGORIA: PARTICULAR\nCOMBUST\nFLEX\nCOR PRATA\nPROPRIET: ANA 529.982.247-25\nUF: SC\nLOCAL\nLAGES\n5/3/2024"
    assert one(spark, extract.extract_vehicle_certificate, text) == {
        "placa": "ABC1D23", "renavam": "12345678900", "chassi": "9BWZZZ377VT004251", "marca_modelo": "VW GOL", "categoria": "PARTICULAR", "combustivel": "FLEX", "cor": "PRATA", "proprietario_nome": "ANA 529.982.247-25", "uf_licenciamento": "SC", "local_emissao": "LAGES",
        "ano_fabricacao": "2009", "ano_modelo": "2010", "proprietario_doc": "529.982.247-25", "data_emissao": "05/03/2024",
    }


def test_vehicle_documents(spark):
    new = one(spark, extract.extract_vehicle_document, "x 123456789 ABC1234 nome ANA  LIMA CPF 1 1985\nano fabricação/modelo: 2009/2009")
    assert new == {"placa": "ABC1234", "renavam": "123456789", "chassi": None, "ano_fabricacao": 2009, "ano_modelo": 2009, "proprietario": "ANA LIMA"}
    old = one(spark, extract.extract_vehicle_document_legacy, "A.Y.H.0.3.0.7 X 123456789 2007 9BWZZZ377VT004251")
    assert old == {"placa": "AYH0307", "renavam": "123456789", "chassi": "9BWZZZ377VT004251", "ano_fabricacao": 2007, "ano_modelo": 2007}
    # Separators inside RENAVAM and chassis.
    old = one(spark, extract.extract_vehicle_document_legacy, "AYH0307 9BW-ZZZ-377-VT-004-25")
    assert old["placa"] == "AYH0307" and old["renavam"] == "030793770" + "04" and old["chassi"] == "AYH03079BWZZZ377V"
    assert one(spark, extract.route_vehicle_document, "A Y H O 3 0 7")["placa"] == "AYH0307" and one(spark, extract.route_vehicle_document, "nada")["layout"] == "legacy"


def test_windows_and_tails(spark):
    get = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c.alias("x")).first().x
    assert get(dates.window_around(F.col("t"), "b+", 2, 3), "aaaabbbcccc") == "aabbbccc" and get(dates.window_around(F.col("t"), "b", 9, 9), "ab") == "ab" and get(dates.window_around(F.col("t"), "x", 1, 1), "ab") is None
    years = F.struct(*dates.anchored_year_pair("t"))
    assert tuple(get(years, "1901 " + "X" * 50 + " ANO FAB MOD " + "2011 " + "X" * 90 + " 2020")) == (2011, 2011)
    assert tuple(get(years, "2001\nANO X\nFAB MOD 2002/2003")) == (2002, 2003)  # the anchor's words are not on one line
    assert get(T.clean_address("t"), "Rua X 1 COD CLIENTE: 5") == "Rua X 1 COD" and get(T.clean_address("t"), "Rua Conta 5") == "Rua"


def test_lacking(spark):
    df = spark.createDataFrame([([], "[]", " ", [1])], "a array<int>, b string, c string, d array<int>")
    assert df.select(T.missing_fields({x: F.col(x) for x in "abcd"}).alias("m")).first().m == ["a", "c"]
    rows = spark.createDataFrame([("12345678900",), ("1234567890",), (None,), ("12345678901",), ("",)], "renavam string")
    got = [(r.dv_ok, r.reason, r.warning) for r in rules.certificate_soft_checks(rows).collect()]
    assert got == [(True, "ok", None), (False, "invalid", "renavam:invalid"), (False, "invalid", None), (False, "dv_mismatch", "renavam:dv_mismatch"), (False, "invalid", None)]


def test_dispatch_is_one_scan(spark, tmp_path):
    """All types in one pass over the texts: one scan, one shuffle, and texts don't move."""
    rows = [(1, "proposal", PROPOSAL), (1, "residence_proof", "NOME: ANA"), (1, "residence_proof", "NOME: ANA"), (2, "payroll", "Funcionário: ANA LIMA"), (3, "unknown", "x"), (4, "bank_statement", "BANCO DO BRASIL\n01/02/2024 PIX COMPRA 10,00 D\n02/02/2024 PADARIA 5,00 C"), (5, "bank_statement", None), (6, "transfer", None)]
    spark.createDataFrame(rows, "doc_id int, doc_type string, text string").write.parquet(str(tmp_path / "t"))
    df = extract.extract_all(spark.read.parquet(str(tmp_path / "t")))
    got = sorted((r.doc_id, r.doc_type, r.data) for r in df.select("doc_id", "doc_type", F.to_json("data").alias("data")).collect())
    assert [x[:2] for x in got] == [(1, "proposal"), (1, "residence_proof"), (1, "residence_proof"), (2, "payroll"), (4, "bank_statement"), (5, "bank_statement"), (6, "transfer")]
    assert '"nome_financiado":"ANA LIMA SILVA"' in got[0][2] and '"nome":"ANA LIMA"' in got[3][2]
    assert '"estrategia":"line_end_value"' in got[4][2] and '"lancamentos":[{"data":"2024-02-01","descricao":"PIX COMPRA","valor":-10}' in got[4][2].replace("-10.0", "-10") and '"banco":"Banco do Brasil"' in got[4][2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
