"""Queries that once read a part of their input only."""

from sparkloom.plans import code, documents


def test_every_page_has_a_reading_order(spark):
    folder = "/root/testdata/sf0.001"
    found = {(r.page, r.id) for r in code.QUERIES["k27_reading_order"](spark, folder).collect()}
    assert found == {(r.page, r.id) for r in code.elements(spark, folder).collect()}
    whole = spark.read.parquet(f"{folder}/lineitem.parquet")
    assert len(found) == whole.selectExpr("l_orderkey", "l_partkey", "l_linenumber").distinct().count()


def test_edges_of_every_supplier_are_placed(spark):
    items = spark.createDataFrame([(1, 5), (99, 6), (100, 7), (100, 7), (999, 101), (250, 250)], "l_suppkey long, l_partkey long")
    found = sorted(tuple(r) for r in documents.edge_chunks(items).select("src", "dst", "chunk").collect())
    assert found == [(1, 5, 5), (99, 6, 6), (100, 7, 2), (250, 50, 5), (999, 1, 5)]
