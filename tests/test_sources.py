"""Scans on small files, sinks, and a stream's merge."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantarium.sources import archives as A
from quantarium.sources import scans as S
from quantarium.streaming import forms


def put(tmp_path, name, text, encoding="utf-8"):
    (tmp_path / name).write_bytes(text.encode(encoding))
    return str(tmp_path / name)


def test_sgs(spark, tmp_path):
    p = put(tmp_path, "432.json", '[{"data":"02/01/2026","valor":"13,75"},{"data":"03/01/2026","valor":"14.25"},{"data":"05/01/2026","valor":"15"}]')
    got = {r.date: r.value for r in S.sgs_json(spark, p, end="2026-01-04").collect()}
    assert got == {dt.date(2026, 1, 2): 13.75, dt.date(2026, 1, 3): 14.25}
    bad = put(tmp_path, "1.json", '[{"data":"31/02/2026","valor":"1"},{"data":"01/01/2026","valor":"-"}]')
    assert [(r.date, r.value) for r in S.sgs_json(spark, bad, tolerant=True).collect()] == [(dt.date(2026, 1, 1), None)]
    with pytest.raises(Exception, match="bad date or value"):
        S.sgs_json(spark, bad).collect()


def test_simple_csv_and_json(spark, tmp_path):
    p = put(tmp_path, "f.csv", "DATE,X\n2026-01-01,1.5\n2026-01-02,.\nbad,3\n")
    assert sorted((str(r.date), r.value) for r in S.fred_csv(spark, p).collect()) == [("2026-01-01", 1.5), ("2026-01-02", None)]
    p = put(tmp_path, "wb.json", '[{"page":1},[{"date":"2020","value":1.5},{"date":"2021","value":null}]]')
    assert [(str(r.date), r.value) for r in S.worldbank_json(spark, p).collect()] == [("2020-07-01", 1.5)]
    p = put(tmp_path, "s.csv", 'CNPJ;NOME\n1;"Ação ""X"""\n', "latin-1")
    assert S.semicolon_csv(spark, p).head().NOME == 'Ação "X"'
    p = put(tmp_path, "env.json", '{"data":[{"a":1},{"a":2}]}')
    assert sorted(r.a for r in S.first_array(spark, p).select(F.variant_get("item", "$.a", "int").alias("a")).collect()) == [1, 2]


def test_treasury_and_manifest(spark, tmp_path):
    head = "Tipo;Vencimento;Data Base;Compra;Venda;PU1;PU2;PU3\n"
    p = put(tmp_path, "t.csv", head + "Tesouro IPCA+;15/05/2035;02/01/2026;7,10;7,22;1;1;1\nTesouro IPCA+ com Juros Semestrais;15/05/2035;02/01/2026;7,1;7,2;1;1;1\n", "latin-1")
    r = S.treasury_csv(spark, p).collect()
    assert len(r) == 1 and r[0].buy == 7.1 and r[0].offered and r[0].base_date == dt.date(2026, 1, 2)
    at = lambda: S.treasury_csv(spark, p).selectExpr("unix_timestamp(available_at) AS s").head().s
    want = int(dt.datetime(2026, 1, 2, 12, 30, tzinfo=dt.timezone.utc).timestamp())
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        assert at() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert at() == want and S.source_manifest(spark, p).head().bytes > 0


def test_reports(spark, tmp_path):
    p = put(tmp_path, "c.txt", "Curva\nVértices;ETTJ IPCA;x\n252;6,5;1\n504;7,0;1\nPREFIXADOS;;\n756;1,0;1\n")
    assert sorted((r.vertex, r.rate) for r in S.curve_report(spark, p).collect()) == [(1.0, 6.5), (2.0, 7.0)]
    assert [r.line for r in S.anchor_block(spark, p, "prefixados", 1).orderBy("pos").collect()] == ["PREFIXADOS;;", "756;1,0;1"]


def test_candles_curated_and_gate(spark, tmp_path):
    p = put(tmp_path, "q.json", '{"symbol":"abc","values":[{"datetime":"2026-01-02 00:00","open":"1","high":"2","low":"1","close":"1.5","volume":"10"},{"datetime":"2026-01-01","close":null}]}')
    assert [(r.ticker, r.close) for r in S.provider_candles(spark, p).collect()] == [("ABC", 1.5)]
    p = put(tmp_path, "k.csv", "data_ref,vertex,rate\n2026-01-01,1.0,6.5\n")
    assert S.curated_csv(spark, p, "data_ref date, vertex double, rate double").head().rate == 6.5
    with pytest.raises(Exception):
        S.curated_csv(spark, p, "data_ref date, other double, rate double").collect()
    df = spark.createDataFrame([(1, [])], "id int, errors array<string>")
    assert S.write_gated_json(df, "errors", str(tmp_path / "ok")) and not S.write_gated_json(df.withColumn("errors", F.array(F.lit("x"))), "errors", str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()
    S.write_csv(df.drop("errors"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    p = put(tmp_path, "pkg.json", '{"id":"a","version":3}')
    assert S.context_package(spark, p, "id string, version int").head().state == "available"
    assert S.manifest(spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-01-02")], "s string, d string"), "d", "s").count() == 2


def test_stream_merge_runs_twice(spark, tmp_path):
    store = {"rows": spark.createDataFrame([(1, 5.0)], "k int, v double")}

    def write(df, batch_id):
        store["rows"] = spark.createDataFrame(df.collect(), df.schema)

    merge = forms.pit_merge(lambda: store["rows"], write, ["k"], ["v"])
    batch = spark.createDataFrame([(1, 6.0), (2, 1.0), (2, 1.0)], "k int, v double")
    for _ in range(2):
        merge(batch, 0)
        assert sorted((r.k, r.v) for r in store["rows"].collect()) == [(1, 5.0), (2, 1.0)]


def test_flow_bulletin_and_archives(spark, tmp_path):
    p = put(tmp_path, "r.txt", "x\nFluxo Estrangeiro\nJan/Jan/2026;a;1.234,5\nFev/Fev/2026;a;-10,0\nresto\n")
    got = {str(r.data_ref): r.flow for r in S.foreign_flow_report(spark, p, "fluxo estrangeiro", "2026-02-13").collect()}
    assert got == {"2026-01-31": 1234500000.0, "2026-02-13": -10000000.0}
    p = put(tmp_path, "b.txt", "Pessoas Físicas 1.000 10,0 900 9,0\nInstitucionais 5 6\n")
    got = {r.category: (r.balance, r.error) for r in S.investor_bulletin(spark, p).collect()}
    assert got == {"pessoas fisicas": (100000.0, None), "institucionais": (None, "numbers: 2")}
    for year, stmt in ((2024, "index"), (2025, "index"), (2025, "DRE_con")):
        folder = tmp_path / "arc" / f"year={year}" / f"stmt={stmt}"
        folder.mkdir(parents=True)
        head = "company;received;subject;value" if stmt == "index" else "company;code;value"
        (folder / "a.csv").write_text(f"{head}\n{year};3.11;7\n")
    index = A.issuer_index(spark, str(tmp_path / "arc"), [2024, 2025])
    assert index.count() == 2 and index.columns[:4] == ["company", "received", "subject", "value"]
    member = A.filing_member(spark, str(tmp_path / "arc"), "DRE_con", [2025]).select("company", "code", "value", F.lit("2025-12-31").cast("date").alias("period_end"), F.lit("ÚLTIMO").alias("order"), F.lit(1).alias("version"))
    accounts = spark.createDataFrame([("DRE", "3.11", "net_income")], "statement string, code string, metric string")
    r = S.account_facts({("DRE", "consolidado"): member}, accounts, spark.createDataFrame([("2025", "ABCD3")], "company string, ticker string")).collect()
    assert [(x.ticker, x.metric, x.fiscal_year, x.value) for x in r] == [("ABCD3", "net_income", 2025, 7.0)]
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    body = spark.createDataFrame([('[{"k":2,"v":"c"},{"k":3,"v":"d"}]',)], "body string")
    assert {x.k: x.v for x in S.bulk_upsert(stored, body, "k int, v string", ["k"]).collect()} == {1: "a", 2: "c", 3: "d"}


def test_members_are_read_by_their_own_header(spark, tmp_path):
    """Years with different columns are joined by name; a missing year, member or folder gives no rows."""
    for year, head, cells in ((2019, "CNPJ;CONTA;VALOR", "1;3.11;7"), (2020, "CNPJ;VERSAO;CONTA;VALOR", "2;1;3.11;8"), (2021, "VALOR;CNPJ", '"9;5";3')):
        folder = tmp_path / "a" / f"year={year}" / "stmt=DRE_con"
        folder.mkdir(parents=True)
        (folder / "x.csv").write_text(f"{head}\n{cells}\n")
    root = str(tmp_path / "a")
    got = A.filing_member(spark, root, "DRE_con", [2019, 2020, 2021, 2022])
    assert set(got.columns) == {"CNPJ", "CONTA", "VALOR", "VERSAO", "year", "stmt", "file"}
    rows = {r.year: (r.CNPJ, r.CONTA, r.VALOR, r.VERSAO, r.stmt, r.file) for r in got.collect()}
    assert rows == {2019: ("1", "3.11", "7", None, "DRE_con", "x.csv"), 2020: ("2", "3.11", "8", "1", "DRE_con", "x.csv"), 2021: ("3", None, "9;5", None, "DRE_con", "x.csv")}
    assert A.filing_member(spark, root, "DRE_con", [1999]).count() == 0 and A.filing_member(spark, root, "capital", [2019]).count() == 0
    typed = A.filing_member(spark, root, "DRE_con", [2019, 2020], "CNPJ long, VERSAO int, CONTA string, VALOR double")
    assert {(r.CNPJ, r.VERSAO, r.VALOR) for r in typed.collect()} == {(1, None, 7.0), (2, 1, 8.0)} and A.filing_member(spark, root, "x", [2019], "CNPJ long").columns == ["CNPJ", "year", "stmt", "file"]
    with pytest.raises(ValueError, match="not in the schema"):
        A.filing_member(spark, root, "DRE_con", [2020], "CNPJ long")


def test_zip_members(spark, tmp_path):
    """Only wanted years and members are unpacked; columns by each header's names, a short row has nulls, BOM and accents."""
    import zipfile

    for year, head, lines in ((2019, "CNPJ;DS_CONTA;VL", ["1;Lucro líquido;7", '2;"a;""b""";8']), (2020, "\xef\xbb\xbfCNPJ;VERSAO;VL", ["3;1", "4;2;9;extra"])):
        with zipfile.ZipFile(tmp_path / f"dfp_{year}.zip", "w") as z:
            z.writestr(f"dfp_cia_aberta_DRE_con_{year}.csv", "\n".join([head, *lines, ""]).encode("latin-1"))
            z.writestr(f"dfp_cia_aberta_BPA_con_{year}.csv", "CNPJ;X\n9;9\n")
    (tmp_path / "dfp_2021.zip").write_bytes(b"no zip at all")
    archives = A.zip_archives(spark, str(tmp_path), "dfp", [2019, 2020, 2030])
    got = A.zip_member(archives, r"DRE_con")
    assert got.columns == ["year", "member", "line", "CNPJ", "DS_CONTA", "VL", "VERSAO"]
    rows = sorted((r.year, r.line, r.CNPJ, r.DS_CONTA, r.VERSAO, r.VL) for r in got.collect())
    assert rows == [(2019, 1, "1", "Lucro líquido", None, "7"), (2019, 2, "2", 'a;"b"', None, "8"), (2020, 1, "3", None, "1", None), (2020, 2, "4", None, "2", "9")]
    assert A.zip_member(archives, "composicao_capital").count() == 0 and A.zip_member(archives, "BPA", ["X", "Y"]).head()[3:] == ("9", None)
    assert A.zip_archives(spark, str(tmp_path), "itr", [2019]).count() == 0


def test_first_array_found_and_coded_candles(spark, tmp_path):
    items = lambda text: [(r.via, r.n) for r in S.first_array(spark, put(tmp_path, "e.json", text)).select("via", F.try_variant_get("item", "$", "long").alias("n")).collect()]
    assert items('{"meta":1,"rows":[1,2]}') == [("rows", 1), ("rows", 2)] and items('{"z":[1],"a":[2]}') == [("z", 1)]
    assert items('{"z":[1],"resultado":[3],"value":[2]}') == [("value", 2)] and items("[7]") == [("raiz", 7)]
    assert items('{"a":{"b":[1]}}') == items("no json") == items("") == items('{"a":[]}') == []
    for body in ('[{0}]', '{{"historico":[{0}]}}', '{{"data":null,"results":[{0}]}}'):
        rows = '{"DATPRG":"20260105","PREABE":"1,5","PREMAX":2,"PREMIN":"1","PREULT":"1.75","QUATOT":10},{"DATPRG":"06/01/2026","PREULT":2,"VOLTOT":"7","QUATOT":1},{"DATPRG":"2026-01-07","PREULT":null}'
        got = S.coded_candles(spark, put(tmp_path, "abcd3.json", body.format(rows))).orderBy("date").collect()
        assert [(r.ticker, str(r.date), r.close, r.volume) for r in got] == [("ABCD3", "2026-01-05", 1.75, 10.0), ("ABCD3", "2026-01-06", 2.0, 7.0)]


def test_rows_are_numbered_over_a_file_s_parts(spark, tmp_path):
    n = 3000
    text = "data_ref,rate\r\n" + "".join(f"2026-01-01,{k}.5\r\n" + ("\r\n" if k % 7 == 0 else "") for k in range(n)) + "x,1\n2026-01-02,\n"
    put(tmp_path, "a.csv", "\ufeff" + text)
    put(tmp_path, "b.csv", "other,rate\n2026-01-01,1\n")
    put(tmp_path, "empty.csv", "")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = S.curated_rows(spark, str(tmp_path), {"data_ref": "date", "rate": "double"})
        assert rows.rdd.getNumPartitions() >= 1 and S.numbered_lines(spark, str(tmp_path)).select("file").distinct().count() == 2
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r.row, r.rate, r.error) for r in got if r.file.endswith("a.csv"))
    assert a[:n] == [(k + 2, k + 0.5, None) for k in range(n)]
    assert [(r, e) for r, _, e in a[n:]] == [(n + 2, f"invalid_row_{n + 2}"), (n + 3, f"invalid_row_{n + 3}")]
    assert sorted((r.row, r.error) for r in got if r.file.endswith("b.csv")) == [(1, "invalid_header"), (2, None)]
    with pytest.raises(Exception, match="invalid_header"):
        S.strict(S.curated_rows(spark, str(tmp_path / "b.csv"), {"data_ref": "date", "rate": "double"})).collect()
    flows = S.curated_rows(spark, str(tmp_path / "a.csv"), {"data_ref": "date", "rate": "double"}, required=("rate",)).where("error IS NULL")
    assert flows.count() == n + 1


def test_package_states(spark, tmp_path):
    texts = {"a": '{"id":"a","contextSchemaVersion":"1.2"}', "b": '{"id":', "c": '{"id":"c","contextSchemaVersion":"2.0"}', "d": '{"contextSchemaVersion":"1.9"}', "e": '{"id":"e","contextSchemaVersion":"1.0","is_seed_mode":true}', "f": "[]", "g": ""}
    state = {k: S.context_package(spark, put(tmp_path, f"{k}.json", t), "id string", "1.2", {"id": F.col("id").isNull()}).head() for k, t in texts.items()}
    assert {k: r and r.state for k, r in state.items()} == {"a": "available", "b": "invalid_json", "c": "incompatible", "d": "invalid_contract", "e": "seed", "f": "invalid_json", "g": None}
    assert S.context_package(spark, str(tmp_path / "none.json"), "id string").head().asDict() == {"id": None, "state": "missing"}


def test_volumes_by_market(spark, tmp_path):
    p = put(tmp_path, "v.txt", "Institucionais 1.000,00 1,00\nINSTITUCIONAIS " + " ".join(f"{k}.000,50 {k},25" for k in range(1, 7)) + "\n")
    got = {r.market: (r.value, r.share) for r in S.market_volumes(spark, p).collect()}
    assert len(got) == 6 and got["a_vista"] == (1000.5, 1.25) and got["total_geral"] == (6000.5, 6.25)


def test_pending_documents(spark):
    from quantarium.operators import documents as D

    rows = [
        (1, b"<html><p>A&amp;B</p>\n\n\n<p>c  d</p></html>", None, None), (2, b"", "pending", None), (3, b"%PDF-1.4", "unsupported", 1), (4, b"%PDF-1.4", "unsupported", 2), (5, None, None, None),
        (6, b"<html><script>x</script></html>", "failed", None), (7, b"text \xff here", None, 1), (8, b"old", "ok", 1), (9, b"[1,  2]", "failed", 2),
    ]
    df = spark.createDataFrame(rows, "id int, content binary, state string, parser_version int")
    got = {r.id: (r.format, r.state, r.text, r.error, r.parser_version) for r in D.parse_pending(df, 2).collect()}
    assert got == {
        1: ("html", "ok", "A&B\nc d", None, 2), 2: ("empty", "failed", None, "content_required", 2), 3: ("pdf", "unsupported", None, "format_pdf", 2), 5: ("empty", "failed", None, "content_required", 2),
        6: ("html", "failed", None, "text_empty", 2), 7: ("text", "ok", "text \ufffd here", None, 2),
    }


def test_run_manifest(spark, tmp_path):
    rows = [("2026-01-01", "2030", True, None), ("2026-01-03", "2035", False, True), ("2026-01-02", None, None, False), ("2026-01-02", "2030", True, False)]
    df = spark.createDataFrame(rows, "d string, m string, added boolean, restated boolean")
    revisions, log = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (1, "a"), (2, None), (3, "x")], [(2, None), (9, "z")]))
    got = S.write_run(df, str(tmp_path / "t"), "d", "m", F.col("added"), F.col("restated"), revisions, log, ["k", "v"])
    assert got == {"rows": 4, "added": 2, "restated": 1, "first": "2026-01-01", "last": "2026-01-03", "restated_pct": 25.0, "revisions_new": 2, "revisions_known": 1, "maturities": 2}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    none = S.write_run(df.limit(0), str(tmp_path / "e"), "d", "m", F.col("added"), F.col("restated"), revisions, log.limit(0), ["k", "v"])
    assert (none["rows"], none["first"], none["restated_pct"], none["revisions_new"], none["revisions_known"], none["maturities"]) == (0, None, None, 3, 0, 0)
