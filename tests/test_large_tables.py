"""What keeps queries bounded on large tables: no sort, frame or broadcast that grows with them, and work dealt to all tasks."""

from sparkloom.operators import diagrams as D
from sparkloom.operators import knowledge as K
from sparkloom.operators import pdf as P
from sparkloom.plans import sources
from sparkloom.sources import sinks


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_tool_lines_are_not_sorted(spark):
    rows = spark.createDataFrame([(1, "fine\nerror a\n" * 30), (2, None), (3, "x\r\nWarning\r\n")], "doc long, text string")
    found = D.tool_lines(rows, keep=20)
    assert not any(word in plan(found) for word in ("Window", "Sort", "Exchange"))
    assert [tuple(r) for r in found.collect()] == [(1, 2 * k, "error a") for k in range(1, 21)] + [(3, 2, "Warning")]


def test_texts_of_one_small_file_are_dealt_to_all_tasks(spark):
    assert sources.texts(spark, "/root/testdata/sf0.001", "p_name").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_page_of_many_rows_is_read_downwards(spark):
    rows = spark.range(3000).selectExpr("1L AS page", "id", "0D AS left", "id * 20D AS bottom", "(id % 2) * 100D + 50 AS right", "id * 20D + 10 AS top")
    found = P.reading_order(rows, wide=2.0)
    assert "InPandas" not in plan(found)
    assert [r.id for r in found.orderBy("rank").collect()] == list(range(2999, -1, -1))


def test_loads_make_no_frame_for_each_chunk(spark):
    def send(chunk, items):
        if any(i["n"] == 7 for i in items):
            raise ValueError("7")
        return len(items), 0, 0

    rows = spark.createDataFrame([(1, 1), (1, 7), (2, 3), (2, 4), (3, 7)], "chunk long, n long")
    found = sinks.load_chunks(rows, send)
    assert "InPandas" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 1, 0, 0, 1), (2, 2, 2, 0, 0, 0), (3, 1, 0, 0, 0, 1)]


def test_symbols_are_not_sent_through_the_driver(spark):
    rows = [("p", 1, None, "a", "class"), ("p", 2, 1, "b", "function"), ("p", 3, 2, "c", "method"), ("p", 4, 3, "d", "class"), ("p", 5, 9, "e", "class"), ("p", 6, 7, "f", "class"), ("p", 7, None, "g", "function")]
    found = K.flatten(spark.createDataFrame(rows, "path string, id long, parent_id long, name string, kind string"))
    assert "Broadcast" not in plan(found)
    assert {r.id: r.parent for r in found.collect()} == {1: None, 2: "a", 3: "a", 4: "a", 5: None, 6: None, 7: None}
