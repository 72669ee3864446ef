"""Registered queries of the single functions: each over all cases, with inputs made of the cases' own values.

A probe lists pairs: an input as Spark SQL and what must come out as DuckDB SQL, both over the columns of
``casegen.FLAT_SQL``. Case k takes pair k % n, so the expected side never runs the function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verifold import casegen
from verifold.functions import dates, ids, money
from verifold.functions import text as T
from verifold.operators import lines as L
from verifold.operators.tables import required_fields_for
from verifold.plans import extract

QUERIES: dict = {}
SQL: dict[str, str] = {}
NULL = "cast(null as varchar)"
NOTHING = "cast(null as string)"
TODAY = "2026-01-05"


def probe(name: str, function: Callable[[Column], Column], *pairs: tuple[str, str], kind: str = "string") -> None:
    """Registers ``name``: case_id and the result (cast to ``kind``) of each case's input."""
    def run(spark, sf_dir):
        given = "CASE k % {} {} END".format(len(pairs), " ".join(f"WHEN {i} THEN {x}" for i, (x, _) in enumerate(pairs)))
        rows = casegen.flat(spark, sf_dir).select("case_id", F.expr(given).alias("given"))
        return rows.select("case_id", function(F.col("given")).cast(kind).alias("result"))

    wanted = "CASE k % {} {} END".format(len(pairs), " ".join(f"WHEN {i} THEN {x}" for i, (_, x) in enumerate(pairs)))
    sql_kind = {"string": "varchar", "long": "bigint"}.get(kind, kind)
    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"WITH flat AS ({casegen.FLAT_SQL}) SELECT case_id, cast({wanted} AS {sql_kind}) AS result FROM flat"


def two(function: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """A function of two values, given with '|' between them."""
    return lambda c: function(F.get(F.split(c, r"\|"), F.lit(0)), F.get(F.split(c, r"\|"), F.lit(1)))


def joined(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.array_join(function(c), ",")


def with_validity(normal: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.concat(normal(c), F.lit(":"), valid(c).cast("string"))


NN = "lpad(cast(k % 100 as string), 2, '0')"
INITIALS = "array_to_string(list_transform(string_split(full_name, ' '), lambda x: x[1]), ',')"
BR = casegen.br_amount("cents")
REAIS = "cents / 100.0"
#: A number of twelve digits from the case, and its two check digits.
BASE = "(lpad(cast(k * 7919 % 100000000 as string), 8, '0') || '0001')"
C1 = casegen.check_digit(BASE, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
C2 = casegen.check_digit(f"({BASE} || cast({C1} as string))", [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])

probe("s1_only_digits", T.only_digits, ("'CPF: ' || coalesce(p_cpf, '') || ' x'", "cpf"), ("'none in ' || full_name", "''"), (NOTHING, "''"))
probe("s2_normalize_doc_id", T.normalize_doc_id, ("p_cpf", "cpf"), ("'1' || cpf", "''"), ("'11.222.333/0001-81'", "'11222333000181'"))
probe("s3_strip_accents", T.strip_accents, ("'ÁÉÍÓÚ çãõ ' || full_name", "'AEIOU cao ' || full_name"), ("'e\u0301' || full_name", "'e' || full_name"), (NOTHING, NULL))
probe("s4_normalize_name", T.normalize_name, ("'  joão  ' || lower(full_name)", "'JOAO ' || full_name"), ("'   '", NULL), ("full_name", "full_name"))
probe("s5_sanitize_name", T.sanitize_name, ("'  ana  maria ' || lower(full_name) || ' '", "'ANA MARIA ' || full_name"), ("'joão ' || full_name", "'JOÃO ' || full_name"), (NOTHING, "''"))
probe("s6_clean_human_name", T.clean_human_name, ("'ana-maria 12 ' || full_name", "'ANA MARIA ' || full_name"), ("full_name || '.;'", "full_name"))
probe("s7_is_human_name", T.is_human_name, ("full_name", "true"), ("'PLACA ' || full_name", "false"), ("'ANA'", "false"), ("'MUNICÍPIO ' || full_name", "false"), ("'CPF ' || full_name", "true"), ("'A B ' || substr(full_name, 1, 3)", "false"))
probe("s8_normalize_person_name", T.normalize_person_name, ("'KE ' || full_name || ' 01/02/1990 | lixo'", "full_name"), ("'DE ' || full_name || ' DA'", "full_name"), ("'QR CODE'", NULL), ("'<MM> ' || full_name || ' XYZ'", "full_name"), ("'CPF ' || full_name", "full_name"))
probe("s9_clean_parent_line", T.clean_parent_line, ("'WERT PORTADOR ' || full_name", "full_name"), ("'FILIAÇÃO ' || full_name || ' LH IO'", "full_name"), ("'OO EM RE'", NULL), ("'DA ' || full_name || ' NACIONALIDADE BRASILEIRO'", "full_name"))
probe("s10_name_tokens", joined(T.name_tokens), ("'josé de ' || full_name || ' e silva'", "'JOSE,' || replace(full_name, ' ', ',') || ',SILVA'"), (NOTHING, "''"))
probe("s11_name_match_tolerant", two(T.name_match_tolerant), ("full_name || '|' || lower(full_name)", "'true'"), ("full_name || '|OTHER ' || full_name", "'false'"), ("full_name || '|'", NULL), ("full_name || '|' || split(full_name, ' ')[0] || ' DE ' || split(full_name, ' ')[2]", "'true'"))
probe("s12_name_match_two_tokens", two(T.name_match_two_tokens), ("full_name || '|X ' || full_name", "true"), ("full_name || '|NOBODY ELSE'", "false"), ("full_name || '|'", "false"))
probe("s13_name_jaccard", two(T.name_jaccard), ("full_name || '|' || full_name", "1"), ("full_name || '|' || full_name || ' AB CD EF'", "0.5"), ("'A|B'", "cast(null as double)"), kind="double")
probe("s14_name_initials", joined(T.name_initials), ("full_name", INITIALS), ("'ALFA SOCIEDADE ANONIMA LTDA'", "'A'"), ("'BETA S/A ' || full_name", f"'B,' || {INITIALS}"), ("'x DE ' || full_name", INITIALS))
probe("s15_initials_match", two(T.initials_match), ("substr(full_name, 1, 1) || '|' || full_name", "false"), ("array_join(transform(split(full_name, ' '), x -> substr(x, 1, 1)), '.') || '|' || full_name", "true"), ("'QZ|' || full_name", "false"))
probe("s16_masked_name_initials", joined(T.masked_name_initials), ("substr(full_name, 1, 1) || '*** S***.'", "substr(full_name, 1, 1) || ',S'"), ("'MARIA S****'", "'S'"), ("full_name", "''"))
probe("s17_is_masked_name", T.is_masked_name, ("substr(full_name, 1, 1) || '***'", "true"), ("full_name", "false"), (NOTHING, "false"))
probe("s18_normalize_plate", with_validity(T.compact_alnum, ids.is_valid_plate), (f"'abc-1d' || {NN}", f"'ABC1D' || {NN} || ':true'"), (f"'abcd1' || {NN}", f"'ABCD1' || {NN} || ':false'"))
probe("s19_fix_plate_ocr", ids.fix_plate_ocr, (f"'ABCIO' || {NN}", f"'ABC10' || {NN}"), (f"'A8C1D' || {NN}", f"'ABC1D' || {NN}"), ("'xx'", NULL))
probe("s20_normalize_vin", with_validity(ids.normalize_vin, ids.is_valid_vin), (f"' 9bwzzz377vt0042' || {NN}", f"'9BWZZZ377VT0042' || {NN} || ':true'"), (f"'9BWIZZ377VT0042' || {NN}", f"'9BWIZZ377VT0042' || {NN} || ':false'"))
probe("s21_normalize_renavam", ids.normalize_renavam, ("substr(renavam_ok, 3, 9)", "'00' || substr(renavam_ok, 3, 9)"), ("'RENAVAM ' || renavam_ok", "renavam_ok"), ("substr(renavam_ok, 1, 8)", NULL))
probe("s22_is_valid_renavam", ids.is_valid_renavam, ("renavam_ok", "true"), ("substr(renavam_ok, 1, 10) || cast((cast(substr(renavam_ok, 11, 1) as int) + 1) % 10 as string)", "false"), (NOTHING, "false"))
probe("s24_cpf_check_reason", ids.cpf_check_reason, ("p_cpf", "CASE WHEN cpf_valid THEN 'ok' ELSE 'dv_mismatch' END"), ("substr(cpf, 1, 10)", "'bad_length'"), ("repeat(cast(k % 10 as string), 11)", "'all_equal'"), ("'x'", "'empty'"))
probe("s25_is_valid_cnpj", ids.is_valid_cnpj, (f"{BASE} || cast({C1} as string) || cast({C2} as string)", "true"), (f"{BASE} || cast({C1} as string) || cast(({C2} + 1) % 10 as string)", "false"), ("repeat('1', 14)", "false"), ("'11.222.333/0001-81'", "true"))
probe("s26_mask_doc", T.mask_doc, ("p_cpf", "substr(cpf, 1, 3) || '.***.***-' || substr(cpf, 10, 2)"), ("cpf || '000'", "substr(cpf, 1, 2) || '.***.***/****-00'"), ("substr(cpf, 1, 5)", "'***' || substr(cpf, 2, 4)"), (NOTHING, "''"))
probe("s26_mask_renavam", T.mask_renavam, ("renavam_ok", "substr(renavam_ok, 1, 3) || '*****' || substr(renavam_ok, 9, 3)"), ("'x'", "''"))
probe("s27_mask_for_display", two(lambda kind, value: T.mask_for_display(kind, value)), ("'CPF|' || cpf", "'***.' || substr(cpf, 8, 4)"), ("'numero_registro|' || renavam_ok", "'***' || substr(renavam_ok, 8, 4)"), ("'nome|' || full_name", "full_name"), ("'cor|azul ' || cast(k as string)", "'azul ' || k"))
probe("s28_sanitize_path", T.sanitize_path, ("'/home/someone/store/' || case_id", "'store/' || case_id"), (r"'C:\\Users\\me\\' || case_id", "case_id"), ("'a/' || case_id", "'a/' || case_id"))
probe("s29_normalize_text", T.normalize_text, ("concat(full_name, chr(160), '  b  ')", "full_name || ' b'"), (r"concat('a\n\n ', full_name)", "'a' || chr(10) || chr(10) || ' ' || full_name"))
probe("s30_normalize_vehicle_text", T.normalize_vehicle_text, ("'placa: ç' || full_name || ' @#'", "'PLACA: C' || full_name"), ("'x_1/2-3.4 (' || cpf || ')'", "'X_1/2-3.4 ' || cpf"))
probe("s31_compact_alnum", T.compact_alnum, ("'a-b ç/' || cpf", "'ABC' || cpf"), (NOTHING, "''"))
probe("s32_split_city_uf", lambda c: F.concat_ws("|", *T.split_city_state(c)), ("'curitiba - pr'", "'CURITIBA|PR'"), ("full_name || '/SP'", "full_name || '|SP'"), ("full_name", "full_name"))
probe("s33_clean_address", T.clean_address, ("'Rua ' || full_name || ', ' || cast(k as string) || ' Cliente:6969640 x'", "'Rua ' || full_name || ', ' || k"), ("'Rua do Contrato Novo 7, ' || full_name || ' UC 77'", "'Rua do Contrato Novo 7, ' || full_name"), ("'RUA ' || full_name || ' Unidade Consumidora: 9 NOTA FISCAL 1'", "'RUA ' || full_name"), ("'rua  ' || full_name || ' http://x.com/y'", "'rua ' || full_name"), ("'Av. Conta Dinheiro ' || cast(k as string) || ' INSTALAÇÃO 12 Contrato: 3'", "'Av. Conta Dinheiro ' || k"), ("''", NULL))
probe("s34_first_non_empty", lambda c: T.first_non_empty(F.lit(""), c, F.lit("last")), ("full_name", "full_name"), ("''", "'last'"), (NOTHING, "'last'"))
probe("s35_looks_like_cover_only", T.looks_like_cover_only, ("'república federativa do Brasil ' || full_name", "true"), ("full_name", "false"), ("''", "true"), ("repeat('SENATRAN TRANSITO BRASIL ', 100) || full_name", "false"))
probe("s36_clean_value", T.clean_value, ("'x'", NULL), ("' ' || full_name || '  '", "full_name"))
probe("s37_detect_bank", T.detect_bank, ("'Extrato Banco do Brasil ' || full_name", "'Banco do Brasil'"), ("'itaú ' || full_name", "'Itau'"), ("'NUBANK ' || full_name", NULL), ("'bradesco caixa'", "'Caixa'"), ("'Santander ' || full_name", "'Santander'"))
probe("s38_machine_line_name", T.machine_line_name, ("replace(full_name, ' ', '<<') || '<<<<<<<<<<<<'", "full_name"), ("full_name", NULL), ("'I<BRA<<<<' || cpf", NULL))

probe("m1_parse_money_any", money.parse_money_any, (f"'R$ ' || {BR} || ' x'", REAIS), ("'3.700'", "3.7"), ("'abc'", "cast(null as double)"), kind="double")
probe("m2_parse_money_br", money.parse_money_br, (f"'R$ ' || {BR}", REAIS), (f"{BR} || ' x'", "cast(null as double)"), ("cast(k as string) || ',5'", "k + 0.5"), kind="double")
probe("m3_parse_money_reais", money.parse_money_reais, (BR, REAIS), ("cast(k as string) || '.25'", "k + 0.25"), ("''", "cast(null as double)"), kind="double")
probe("m4_money_to_cents", money.money_to_cents, (BR, "cents"), ("'R$ ' || cast(k as string)", "k * 100"), ("'x'", "cast(null as bigint)"), ("cast(k as string) || ',5'", "k * 100 + 50"), kind="long")
probe("m5_parse_signed_amount", money.parse_signed_amount, (f"'−' || {BR}", f"-{REAIS}"), (f"'- R$ ' || {BR}", f"-{REAIS}"), (f"'+' || {BR}", REAIS), kind="double")
probe("m6_first_amount", money.first_amount, (f"'1,00 total R$ ' || {BR} || ' ref'", REAIS), (f"'x ' || {BR} || ' 2,00'", REAIS), ("full_name", "cast(null as double)"), kind="double")
probe("m7_amount_tokens_relaxed", joined(money.amount_tokens_relaxed), (f"'a ' || {BR} || ' b 1. 234, 56'", f"{BR} || ',1.234,56'"), ("full_name", "''"))
probe("m8_sum_currency_cents", money.sum_currency_cents, (f"'R$ ' || {BR} || ' e R$' || {BR} || ' e 9,99'", "2 * cents"), ("full_name", "0"), kind="long")
probe("m9_money_on_label_line", lambda c: money.money_on_label_line(L.lines_of(c), "valor"), (rf"concat('Valor\nx 1,00\nVALOR: R$ ', {BR}, ' a 2,00')", f"'R$ ' || {BR}"), (rf"concat('total ', {BR})", NULL), (rf"concat('valor ', {BR}, '\nvalor 3,00')", BR))
probe("m10_int_or_text_to_cents", two(lambda value, kind: money.int_or_text_to_cents(value, kind)), ("cast(200000 + k as string) || '|BIGINT'", "200000 + k"), ("cast(k % 1000 as string) || '|BIGINT'", "k % 1000 * 100"), (f"{BR} || '|STRING'", "cents"), kind="long")
probe("m11_null_safe_add", two(lambda a, b: money.null_safe_add(a.try_cast("double"), b.try_cast("double"))), ("cast(k as string) || '|2'", "k + 2"), ("'|' || cast(k as string)", "k"), ("'|'", "cast(null as double)"), kind="double")

DMY = "strptime(p_nasc, '%d/%m/%Y')"
probe("d1_parse_date_br_iso", dates.parse_date, ("' ' || p_nasc || ' '", f"strftime({DMY}, '%Y-%m-%d')"), ("date_format(to_date(p_nasc, 'dd/MM/yyyy'), 'yyyy-MM-dd')", f"strftime({DMY}, '%Y-%m-%d')"), ("'31/02/2020'", NULL), ("'x' || p_nasc", NULL))
probe("d2_normalize_date_string", dates.normalize_date_string, ("replace(p_nasc, '/', '.')", "p_nasc"), ("date_format(to_date(p_nasc, 'dd/MM/yyyy'), 'yyyy-MM-dd') || 'T10:00:00'", "p_nasc"), ("replace(p_nasc, '/', '')", "p_nasc"), ("'31-02-2020'", "'31/02/2020'"), ("'soon'", NULL))
probe("d3_normalize_flexible_date", dates.normalize_flexible_date, ("'em ' || p_nasc || ' ou 01/01/2001'", f"strftime({DMY}, '%Y-%m-%d')"), (f"'5.7.' || {NN}", f"'20' || {NN} || '-07-05'"), ("'32/01/2001'", NULL))
probe("d4_long_date", dates.long_date, ("cast(1 + k % 28 as string) || ' de março de 2024'", "'2024-03-' || lpad(cast(1 + k % 28 as varchar), 2, '0')"), ("'5 DE JULHO DE 2023'", "'2023-07-05'"), ("'5 de foo de 2024'", NULL))
probe("d5_days_to_expire", lambda c: dates.days_to_expire(dates.parse_date(c), F.lit(TODAY).cast("date")), ("p_nasc", f"date_diff('day', DATE '{TODAY}', {DMY}::DATE)"), ("'x'", "cast(null as bigint)"), kind="long")
probe("d6_earliest_date", dates.earliest_date, ("'a 01/01/2031 b ' || p_nasc || ' c'", "p_nasc"), (NOTHING, NULL))
probe("d6_latest_date", dates.latest_date, ("'a 01/01/1931 b ' || p_nasc || ' c 12/12/1910'", "p_nasc"), ("full_name", NULL))
probe("d7_year_pair", lambda c: F.concat_ws(",", *(x.cast("string") for x in dates.year_pair(c))), ("'ano ' || cast(1960 + k % 40 as string) || '/2010'", "(1960 + k % 40) || ',2010'"), ("cast(1960 + k % 40 as string) || ' e ' || cast(1960 + k % 40 as string)", "(1960 + k % 40) || ',' || (1960 + k % 40)"), ("full_name", "''"))
Y = "cast(1960 + k % 40 as string)"
YS = "(1960 + k % 40)"
probe("d7_anchored_year_pair", lambda c: F.concat_ws(",", *(x.cast("string") for x in dates.anchored_year_pair(c))),
      (f"'1901 ANO FABRICACAO/MODELO: ' || {Y} || '/2010'", f"{YS} || ',2010'"), (f"'1901 ' || repeat('X', 50) || ' ANO DE FAB. E ANO DO MOD. ' || {Y} || ' E 2012 1902'", f"{YS} || ',2012'"),
      (f"'1901 ' || repeat('X', 50) || ' ANO DE FAB. E DO MODELO: ' || {Y}", f"{YS} || ',' || {YS}"), (f"'1901 ANO DA FABRICACAO E DO MODELO ' || repeat('X', 90) || {Y}", "'1901,1901'"), (f"'ANO FAB MOD ' || repeat('X', 90) || ' ' || {Y}", "''"),
      (f"'1901 FAB/MOD ' || {Y} || '/2013'", f"{YS} || ',2013'"), (f"'1901 E ' || {Y}", f"'1901,' || {YS}"), ("full_name", "''"))
probe("d8_expiry_sanity", joined(two(lambda expiry, birth: dates.expiry_sanity(dates.parse_date(expiry), dates.parse_date(birth), F.lit(TODAY).cast("date")))),
      ("'01/02/2026|' || p_nasc", "'expiry_soon'"), ("'01/01/2087|' || p_nasc", "'expiry_far'"), ("'01/01/2030|01/01/2027'", "'birth_in_future'"), ("'01/01/2030|' || p_nasc", "''"))
probe("d9_format_date_parts", lambda c: dates.format_date_parts(*(F.get(F.split(c, "-"), F.lit(i)) for i in range(3))), ("cast(1 + k % 28 as string) || '-7-2024'", "lpad(cast(1 + k % 28 as varchar), 2, '0') || '/07/2024'"))

probe("j4_ordered_distinct", lambda c: F.array_join(F.array_distinct(F.split(c, ",")), ","), ("'b,' || case_id || ',b,a,' || case_id", "'b,' || case_id || ',a'"))
probe("j6_required_fields_for", joined(required_fields_for), ("'cnh'", "'nome,cpf,data_nascimento,validade'"), ("'holerite'", "'nome,empregador,data_admissao,total_vencimentos'"), ("'extrato'", "'titular,agencia,conta,periodo_inicio,periodo_fim,lancamentos'"), ("case_id", "''"))
probe("u3_token_sets", two(lambda a, b: F.concat_ws("|", *(F.array_join(F.array_sort(f(F.split(a, " "), F.split(b, " "))), " ") for f in (F.array_intersect, F.array_except)))),
      ("full_name || ' AAA|' || full_name || ' ZZZ'", "array_to_string(list_sort(string_split(full_name, ' ')), ' ') || '|AAA'"))

probe("w4_best_name", lambda c: extract.best_name(L.lines_of(c)), (rf"concat('12 34\n', full_name, ' DE SOUZA\nA\nXYZ')", "full_name || ' DE SOUZA'"), (r"concat('01/01/2020\n', '123')", NULL))
probe("w5_parent_score", extract.parent_score, ("'ANA'", "0"), ("'AAAA EEEE'", "2.0 + 0.6 + 0.5"), ("'AAAA DE EEEE'", "2 * 9.0 / 10 + 0.15 * 10 / 3 + 0.6 + 0.75"), ("'WERT AAAA'", "2 * 5.0 / 8 + 0.6 + 0.5 - 2"), kind="decimal(12,4)")
probe("w6_top2_relative", joined(lambda c: extract.top2_relative(L.lines_of(c))), (r"concat('FILIAÇÃO\n', full_name, ' DA LUZ\nWERT LAT\n', full_name, ' SOUZA\nASSINATURA\nNAO CONTA')", "full_name || ' DA LUZ,' || full_name || ' SOUZA'"), ("full_name", "''"))
probe("w7_prefer_registry_zone", lambda c: extract.prefer_registry_zone(c, F.substring(c, 1, 11)), ("cpf || ' A 98765432100 AB'", "'AB'"), ("cpf || ' C'", "'C'"), ("cpf || 'x CAT: B'", "'B'"), ("cpf || 'x'", NULL))
probe("x16a_lien_status", extract.lien_status, ("'Nada consta de gravame. ' || full_name", "'desconhecida'"), ("'sem gravame ' || full_name", "'ausente'"), ("'baixa de alienação ' || full_name", "'inativa'"), ("full_name", NULL))
probe("x16b_admin_restriction", extract.admin_restriction, ("'IMPEDIMENTO ' || full_name", "'true'"), ("'NADA CONSTA RESTRIÇÃO'", "'true'"), ("'sem restrição ' || full_name", "'false'"), ("full_name", NULL))
probe("x16c_tax_overdue", extract.tax_overdue, (f"'DÍVIDA ATIVA R$ ' || {BR}", "'true'"), (f"'IPVA em aberto R$ ' || {BR}", "'true'"), ("'IPVA em atraso'", NULL), ("'IPVA: nenhum débito ' || full_name", "'false'"), ("full_name", NULL))
probe("x16d_open_debts", lambda c: extract.open_items(c, "DÉBITO"), ("'Nenhum débito ' || full_name", "'false'"), (f"'IPVA R$ ' || {BR}", "'true'"), ("full_name", NULL))
probe("x12_vehicle_fields", lambda c: F.concat_ws("|", *(extract.vehicle_fields(c)[k] for k in ("placa", "renavam", "ano_fabricacao", "proprietario"))), (f"'Placa ABC1D{{0}} Renavam {{1}} ano 2010/2011 nome {{2}} CPF'".replace("{0}", f"' || {NN} || '").replace("{1}", "' || renavam_ok || '").replace("{2}", "' || full_name || '"), f"'ABC1D' || {NN} || '|' || renavam_ok || '|2010|' || full_name"))
#: Each reading of the plate is the only one that sees it.
probe("x13_legacy_fields", lambda c: F.concat_ws("|", *(extract.legacy_fields(c)[k].cast("string") for k in ("placa", "renavam", "chassi", "ano_fabricacao", "ano_modelo"))),
      (f"'Placa AYH03' || {NN} || ' Renavam ' || renavam_ok || ' chassi 9BWZZZ377VT004251 2007'", f"'AYH03' || {NN} || '|' || renavam_ok || '|9BWZZZ377VT004251|2007|2007'"),
      (f"'a.Y.H.O.3.' || substr({NN}, 1, 1) || '.' || substr({NN}, 2, 1) || ' X ' || renavam_ok || ' 2007 2008 9BWZZZ377VT004251'", f"'AYH03' || {NN} || '|' || renavam_ok || '|9BWZZZ377VT004251|2007|2008'"),
      (f"'ABC-1D' || {NN} || ' fim'", f"'ABC1D' || {NN}"), (f"'Placa: ABC-1D' || {NN}", f"'ABC1D' || {NN}"), ("'nada aqui'", "''"))
