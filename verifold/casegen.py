"""A deterministic corpus of cases from the star-schema tables.

``FLAT_SQL`` is plain SQL that both Spark and DuckDB run over the views customer and nation: one row
a case with every field of every document, faults chosen by key. ``store`` renders it as stored
documents (JSON), as they would arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verifold.functions import money


def check_digit(s: str, weights: list[int]) -> str:
    total = " + ".join(f"cast(substr({s}, {i}, 1) as int) * {w}" for i, w in enumerate(weights, 1))
    return f"(case when ({total}) % 11 < 2 then 0 else 11 - ({total}) % 11 end)"


def br_amount(cents: str) -> str:
    """1.234,56 of whole cents below 100 million."""
    whole, rest = f"cast(floor(({cents}) / 100) as bigint)", f"lpad(cast(({cents}) % 100 as string), 2, '0')"
    thousands = f"cast(cast(floor({whole} / 1000) as bigint) as string) || '.' || lpad(cast({whole} % 1000 as string), 3, '0')"
    return f"(case when {whole} >= 1000 then {thousands} else cast({whole} as string) end || ',' || {rest})"


_CPF1, _CPF2 = list(range(10, 1, -1)), list(range(11, 1, -1))
_REN = [3, 2, 9, 8, 7, 6, 5, 4, 3, 2]

FLAT_SQL = f"""
WITH base AS (
  SELECT c_custkey AS k, 'c' || lpad(cast(c_custkey as string), 9, '0') AS case_id,
    (CASE c_custkey % 4 WHEN 0 THEN 'JOAO' WHEN 1 THEN 'MARIA' WHEN 2 THEN 'ANA' ELSE 'PEDRO' END) AS first_name, translate(n_name, '0123456789_ ', 'ABCDEFGHIJKL') AS middle, c_mktsegment AS last_name,
    lpad(cast(c_custkey * 7919 % 1000000000 as string), 9, '0') AS b9, lpad(cast(c_custkey * 104729 % 10000000000 as string), 10, '0') AS r10,
    cast(round(abs(c_acctbal) * 100) as bigint) + 100000 AS cents,
    lpad(cast(1 + c_custkey % 28 as string), 2, '0') AS dd, lpad(cast(1 + c_custkey % 12 as string), 2, '0') AS mm, cast(1960 + c_custkey % 40 as string) AS yyyy
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), digits AS (
  SELECT *, b9 || cast({check_digit("b9", _CPF1)} as string) AS b10,
    r10 || cast((case when (11 - ({" + ".join(f"cast(substr(r10, {i}, 1) as int) * {w}" for i, w in enumerate(_REN, 1))}) % 11) % 11 = 10 then 0 else (11 - ({" + ".join(f"cast(substr(r10, {i}, 1) as int) * {w}" for i, w in enumerate(_REN, 1))}) % 11) % 11 end) as string) AS renavam_ok
  FROM base
), made AS (
  SELECT *, b10 || cast(case when k % 7 = 0 then ({check_digit("b10", _CPF2)} + 1) % 10 else {check_digit("b10", _CPF2)} end as string) AS cpf, first_name || ' ' || middle || ' ' || last_name AS full_name FROM digits
)
SELECT k, case_id, cpf, full_name, renavam_ok, cents, (k % 7 <> 0) AS cpf_valid,
  k % 11 <> 3 AS has_proposal, k % 13 <> 5 AS has_licence, k % 3 = 0 AS has_licence_registry, k % 4 <> 1 AS has_payslip, k % 6 = 1 AS has_bank_statement, k % 2 = 0 AS has_transfer, k % 4 = 0 AS has_vehicle, k % 5 = 0 AS has_registry,
  case when k % 17 = 0 then null else full_name end AS p_nome, case when k % 2 = 0 then substr(cpf, 1, 3) || '.' || substr(cpf, 4, 3) || '.' || substr(cpf, 7, 3) || '-' || substr(cpf, 10, 2) else cpf end AS p_cpf,
  dd || '/' || mm || '/' || yyyy AS p_nasc, case when k % 19 = 0 then null else {br_amount("cents")} end AS p_salario, case when k % 3 = 0 then {br_amount("cast(floor(cents / 10) as bigint)")} end AS p_outras, case when k % 23 = 0 then null else {br_amount("cents * 3")} end AS p_compra,
  case when k % 5 = 0 then first_name || ' ' || last_name else full_name end AS l_nome, case when k % 6 = 0 then yyyy || '-' || mm || '-' || dd else dd || '/' || mm || '/' || yyyy end AS l_nasc,
  case when k % 10 = 0 then null when k % 10 = 1 then 'illegible' when k % 10 = 2 then '31/02/2027' when k % 2 = 0 then cast(2020 + k % 12 as string) || '-' || mm || '-' || dd else dd || '/' || mm || '/' || cast(2020 + k % 12 as string) end AS l_validade,
  case when k % 9 = 0 then first_name || ' DA ' || last_name when k % 9 = 3 then 'OTHER ' || last_name else full_name end AS s_nome, case when k % 12 = 0 then '11144477735' when k % 15 = 0 then null else cpf end AS s_cpf,
  case when k % 15 = 3 then 'bad' when k % 15 = 6 then null else dd || '/' || mm || '/2031' end AS s_validade, case when k % 21 = 0 then null else 'AB' end AS s_categoria,
  case when k % 8 = 0 then null else {br_amount("case when k % 16 = 2 then cents * 2 when k % 16 = 3 then cents - cents % 2 else cast(floor(cents * 0.9) as bigint) end")} end AS h_total, case when k % 12 = 7 then null else {br_amount("cents + 5000")} end AS e_renda,
  case when k % 22 = 0 then null else full_name end AS t_comprador, case when k % 14 = 0 then cpf when k % 18 = 0 then '11144477735' when k % 26 = 0 then null else cpf end AS t_comprador_doc, case when k % 12 = 0 then null when k % 16 = 0 then '12345678901' else renavam_ok end AS t_renavam,
  'SELLER ' || last_name || ' ' || middle AS t_vendedor, case when k % 10 = 0 then '52998224725' else '11144477735' end AS t_vendedor_doc,
  case when k % 20 = 4 then '12345678901' when k % 28 = 8 then '12345678900' else renavam_ok end AS v_renavam, case when k % 8 = 0 then '11144477735' else '52998224725' end AS v_owner,
  case when k % 15 = 0 then null when k % 20 = 0 then '52998224725' else '11144477735' end AS r_owner, case when k % 30 = 0 then 'S' || substr(last_name, 1, 1) else 'XY' end AS r_iniciais,
  case when k % 25 = 0 then null else k % 35 = 0 end AS r_restricao, case when k % 40 = 0 then 'ativa' when k % 45 = 0 then 'inativa' when k % 50 = 0 then null else 'ausente' end AS r_alienacao, case when k % 55 = 0 then null else k % 65 = 0 end AS r_ipva,
  case when k % 70 = 0 then null else cents * (k % 5 + k % 3 * 2) end AS r_debitos, case when k % 75 = 0 then null else cents * (k % 2) end AS r_multas
FROM made
"""

#: Fields of each document as producers name them: type, presence flag, field to column.
DOCUMENTS = {
    "proposta_daycoval": ("has_proposal", {"nome_financiado": "p_nome", "cpf": "p_cpf", "data_nascimento": "p_nasc", "salario": "p_salario", "outras_rendas": "p_outras", "vlr_compra": "p_compra"}),
    "cnh": ("has_licence", {"nome": "l_nome", "cpf": "cpf", "data_nascimento": "l_nasc", "validade": "l_validade"}),
    "cnh_senatran": ("has_licence_registry", {"nome": "s_nome", "cpf": "s_cpf", "validade": "s_validade", "categoria": "s_categoria"}),
    "holerite": ("has_payslip", {"total_vencimentos": "h_total"}),
    "extrato_bancario": ("has_bank_statement", {"renda_apurada": "e_renda"}),
    "atpv": ("has_transfer", {"placa": "'ABC1D23'", "chassi": "'9BWZZZ377VT004251'", "valor_venda": "p_compra", "comprador_nome": "t_comprador", "comprador_cpf_cnpj": "t_comprador_doc", "renavam": "t_renavam", "vendedor_nome": "t_vendedor", "vendedor_cpf_cnpj": "t_vendedor_doc"}),
    "crlv_e": ("has_vehicle", {"placa": "'ABC1D23'", "renavam": "v_renavam", "proprietario_doc": "v_owner"}),
    "detran_sc": ("has_registry", {"proprietario_doc": "r_owner", "proprietario_iniciais": "r_iniciais", "restricao_administrativa_ativa": "r_restricao", "alienacao_fiduciaria_status": "r_alienacao", "ipva_em_atraso": "r_ipva", "debitos_total_cents": "r_debitos", "multas_total_cents": "r_multas"}),
}


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a case."""
    sql = FLAT_SQL.replace("FROM customer JOIN nation", "FROM {customer} JOIN {nation}")
    return spark.sql(sql, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"), nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))




def store(cases: DataFrame) -> DataFrame:
    """case_id, doc_type, file_name, path, raw: stored documents, with stale versions for every tenth case."""
    docs = []
    for kind, (flag, fields) in DOCUMENTS.items():
        data = F.struct(*(F.expr(c).alias(n) for n, c in fields.items()))
        docs.append(F.when(F.col(flag), F.array(F.struct(F.lit(kind).alias("doc_type"), F.lit("b.json").alias("file_name"), F.to_json(F.struct(data.alias("data"))).alias("raw")))).otherwise(F.array().cast("array<struct<doc_type:string,file_name:string,raw:string>>")))
        docs.append(F.when(F.col(flag) & (F.col("k") % 10 == 0), F.array(F.struct(F.lit(kind).alias("doc_type"), F.lit("a.json").alias("file_name"), F.lit('{"data": {"nome": "STALE"}}').alias("raw")))).otherwise(F.array().cast("array<struct<doc_type:string,file_name:string,raw:string>>")))
    rows = cases.select("case_id", F.inline(F.concat(*docs)))
    return rows.withColumn("path", F.concat_ws("/", F.lit("/home/someone/store"), "case_id", "doc_type", "file_name"))


# Statement texts: one transaction an order, printed in layout c_custkey % 6

MONTH_NAMES = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
#: Transactions of each customer, as plain SQL over the view orders.
TX_SQL = "SELECT o_custkey AS doc_id, o_orderkey, cast(o_orderdate as date) AS d, cast(round(o_totalprice * 100) as bigint) AS cents, o_orderpriority AS priority FROM orders"


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TX_SQL.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def render_statements(tx: DataFrame) -> DataFrame:
    """doc_id and text. Descriptions are letters only; transactions stand by date and key."""
    month = F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month("d"))
    amount = money.pt_br(F.col("cents") / 100)
    what = F.concat(F.lit("COMPRA "), F.regexp_replace(F.upper("priority"), "[^A-Z]", ""), F.lit(" LOJA"))
    br, dm = F.date_format("d", "dd/MM/yyyy"), F.date_format("d", "dd/MM")
    head = F.concat(month, F.lit(" "), F.year("d").cast("string"))
    kind = F.col("doc_id") % 6
    line = (F.when(kind == 0, F.concat_ws(" ", br, what, amount, F.lit("D")))
            .when(kind == 1, F.concat_ws(" ", F.lit("REF"), br, what, amount, F.lit("88,00")))
            .when(kind == 2, F.concat(head, F.lit("\n"), F.concat_ws(" ", dm, dm, what, F.concat(F.lit("R$ "), amount))))
            .when(kind == 3, F.concat(F.date_format("d", "d"), F.lit(" de "), month, F.lit(" de "), F.year("d").cast("string"), F.lit("\n"), what, F.lit(" R$ "), amount))
            .when(kind == 4, F.concat(head, F.lit("\nData\n"), dm, F.lit("\nDescrição\n"), what, F.lit("\nValor\n"), amount))
            .otherwise(F.concat_ws(" ", br, what, F.concat(F.lit("R$ "), amount, F.lit(" ref")))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("d", "o_orderkey", line.alias("line")))), lambda x: x["line"])
    return tx.groupBy("doc_id").agg(F.concat(F.lit("EXTRATO BANCO ITAU\n"), F.array_join(ordered, "\n"), F.lit("\n")).alias("text"))
