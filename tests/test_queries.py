"""Every query on a reference operator against its SQL, at the smallest size."""

import duckdb
import pytest

from docweave.plans.all_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    frame = frame[columns].astype(object)
    frame = frame.where(frame.notna(), None)
    plain = lambda v: None if v is None else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(found)
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    assert rows(found, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert {r["format"] for r in __spark_entry__.entry(spark).collect()} == {"pdf", "jpg", "png", "xlsx", "xls", "doc", "docx", "text", "error"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

def test_text_layer_of_odd_texts(spark, tmp_path):
    """Blanks of other kinds at the ends stay, texts without a word have no row, rows that share an id are one layer."""
    texts = [(1, "\ta b\r"), (2, None), (3, ""), (4, "   "), (5, "\n"), (6, "　a "), (7, " \n a  b c d e f\n "), (None, "no id"), (8, "x y z"), (8, "x y z"), (9, "p q r s t u"), (9, "m n"), (None, "no id"), (9, None)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["text_layer"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["text_layer"]).df()
    assert len(want) == 7 and rows(found, ["doc_id", "layer"]) == rows(want, ["doc_id", "layer"])


def test_a_nation_of_more_rows_than_a_sheet(spark, tmp_path):
    """The rows beyond are in the region's next books; nothing is lost, and no sheet has more than its room."""
    from docweave.plans import scan_queries

    con = duckdb.connect()
    con.sql(f"COPY (SELECT c.* REPLACE (i AS c_custkey, i % 2 AS c_nationkey) FROM range(140000) t(i) JOIN (SELECT *, row_number() OVER () - 1 AS n FROM '{SF}/customer.parquet') c ON n = i % 100) TO '{tmp_path}/customer.parquet' (FORMAT PARQUET)")
    con.sql(f"COPY (FROM '{SF}/nation.parquet') TO '{tmp_path}/nation.parquet' (FORMAT PARQUET)")
    for t in ("customer", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    QUERIES["xls_scan"](spark, str(tmp_path)).write.parquet(str(tmp_path / "found"))
    con.sql(f"CREATE TABLE want AS {ORACLE_SQL['xls_scan']}")
    con.sql(f"CREATE TABLE found AS SELECT region, sheet, ref, value_type, value FROM '{tmp_path}/found/*.parquet'")
    assert con.sql("SELECT max(CAST(substr(ref, 2) AS INTEGER)) FROM found").fetchall() == [(70_000,)]
    assert con.sql("(FROM want EXCEPT ALL FROM found) UNION ALL (FROM found EXCEPT ALL FROM want)").fetchall() == []
    few = scan_queries._legacy_cells(spark, SF, 7).toPandas()
    assert rows(few, ["ref", "region", "sheet", "value"]) == rows(scan_queries.xls_scan(spark, SF).toPandas(), ["ref", "region", "sheet", "value"])
