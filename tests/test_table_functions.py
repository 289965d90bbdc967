from textloom.operators.table_functions import register_table_functions


def rows(spark, sql):
    return [tuple(r) for r in spark.sql(sql).collect()]


def test_edge_rows(spark):
    register_table_functions(spark)
    docs = "(VALUES (1, 'a\\n\\nb'), (2, ''), (3, NULL), (4, 'xyzuv')) AS d(id, t)"
    assert rows(spark, f"SELECT id, f.* FROM {docs}, LATERAL text_lines(t) f ORDER BY 1, 2") == [
        (1, 0, "a"), (1, 1, ""), (1, 2, "b"), (2, 0, ""), (4, 0, "xyzuv")]
    assert rows(spark, f"SELECT id, f.* FROM {docs}, LATERAL text_chunks(t, 2) f WHERE id > 1 ORDER BY 1, 2") == [
        (4, 0, "xy"), (4, 1, "zu"), (4, 2, "v")]
    n = "(VALUES (0L), (NULL), (5L)) AS d(n)"
    assert rows(spark, f"SELECT f.* FROM {n}, LATERAL score_windows(n, 4, 2) f ORDER BY 1, 2") == [(0, 2, 2), (0, 4, 2), (2, 5, 1)]


def test_calls_are_inlined(spark):
    register_table_functions(spark)
    spark.range(3).selectExpr("id", "cast(id AS STRING) AS t").createOrReplaceTempView("tl_inlined")
    plan = spark.sql("EXPLAIN SELECT id, f.* FROM tl_inlined, LATERAL text_chunks(t, 2) f").first()[0]
    assert "Generate" in plan and "Join" not in plan and "Exchange" not in plan
