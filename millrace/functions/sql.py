"""The text functions as SQL functions of a session, for those who write SQL: ``SELECT * FROM methods_of(source)``.

Each is a SQL function whose body is the column that the library builds, so that it runs inside the plan like the column itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text as T

_METHOD = "name STRING, class_name STRING, signature STRING, start_line INT, end_line INT, source STRING"
#: name: (parameters, columns of the result, or its type, and the column).
TABLES: dict[str, tuple[str, str, Callable[[], Column]]] = {
    "methods_of": ("source STRING", _METHOD, lambda: T.methods(F.col("source"))),
    "scoped_methods_of": ("source STRING", _METHOD, lambda: T.scoped_methods(F.col("source"))),
    "hunks_of": ("diff STRING", "old_start INT, old_count INT, new_start INT, new_count INT", lambda: T.hunks(F.col("diff"))),
}
SCALARS: dict[str, tuple[str, str, Callable[[], Column]]] = {
    "issue_ids_of": ("message STRING", "ARRAY<STRING>", lambda: T.issue_ids(F.col("message"))),
    "changed_methods_of": ("diff STRING", "ARRAY<STRING>", lambda: T.changed_methods(F.col("diff"))),
    "token_count_of": ("code STRING", "INT", lambda: T.token_count(F.col("code"))),
}
_PIECE = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`'])(and|or|not|[-+*/%=<>!&|^~]{1,3})\(", re.S)


def as_sql(column: Column) -> str:
    """The SQL text of a column; operators, which are written as functions, by their quoted names."""
    return _PIECE.sub(lambda m: m[1] or f"`{m[2]}`(", column._jc.node().sql())


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session."""
    for name, (given, result, build) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE({result}) RETURN SELECT m.* FROM (SELECT explode({as_sql(build())}) AS m)")
    for name, (given, result, build) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {as_sql(build())}")
