"""The SQL functions against the columns that they are made of."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import sql
from millrace.functions import text as T

SOURCES = ["class A {\n  int f(int a) {\n    return a;\n  }\n  void g() { s = \"}\"; }\n}", "", None, "int h() {\n}"]


@pytest.fixture(scope="module")
def known(spark):
    sql.register(spark)
    sql.register(spark)  # again: replaced
    spark.createDataFrame(list(enumerate(SOURCES)), "i int, code string").createOrReplaceTempView("sources_of_test")
    yield spark
    spark.catalog.dropTempView("sources_of_test")


@pytest.mark.parametrize("name,build", [("methods_of", T.methods), ("scoped_methods_of", T.scoped_methods)])
def test_tables_equal_columns(known, name, build):
    got = known.sql(f"SELECT i, m.* FROM sources_of_test, LATERAL {name}(code) AS m").collect()
    want = known.table("sources_of_test").select("i", F.explode(build(F.col("code"))).alias("m")).select("i", "m.*").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_constants_and_scalars(known):
    assert [tuple(r) for r in known.sql(r"SELECT name, start_line, end_line FROM methods_of('int f() {\n  return 1;\n}')").collect()] == [("f", 1, 3)]
    assert [tuple(r) for r in known.sql("SELECT * FROM hunks_of('@@ -1,3 +2 @@ x')").collect()] == [(1, 3, 2, 1)]
    r = known.sql(r"SELECT issue_ids_of('Fixes #12, ABC-7') AS a, token_count_of('int a_b(1);') AS b, changed_methods_of('@@ -1 +1 @@ void f(\n+  public int g(int x) {') AS c").first()
    assert (r.a, r.b, r.c) == (["12", "ABC-7"], 6, ["f", "g"])
