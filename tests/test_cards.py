"""Report cards over whole inputs."""

import duckdb

import __spark_entry__ as E
from thermograph.plans.adapters import TABLES
from thermograph.sources.tables import word_report_card
from verify import rows_of

SF = "/root/testdata/sf0.001"


def test_meta_values_with_semicolons(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = rows_of(E.queries()["A4_meta_fold"](spark, SF).toArrow())
    assert got == rows_of(con.execute(E.oracle_sql()["A4_meta_fold"]).to_arrow_table())
    assert any(";x" in str(r) for r in got[1])


def test_word_card_reads_the_whole_report(spark):
    rows = spark.createDataFrame([(1, 7, 2, ["样品名称", "late table"]), (1, 0, 30, ["规格型号", "late row"])], "report_id long, table_index int, row_index long, cells array<string>")
    paragraphs = spark.createDataFrame([(1, 200, "检验结论 合格")], "report_id long, para_index long, text string")
    card = word_report_card(rows, paragraphs).first()
    assert (card.sample_name, card.spec_model, card.test_conclusion) == ("late table", "late row", "检验结论 合格")
    assert word_report_card(rows, paragraphs, 5, 25, 80).count() == 0
