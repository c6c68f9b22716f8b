"""Functions usable from SQL — temporary SQL functions (no Python UDF), so
they stay JVM-side and inside codegen:

* ``lang_of(path)``  → canonical language of a file path (suffix → alias)
* ``inner_product(a, b)`` → Σ a_i·b_i of two float arrays, in double precision
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .languages import LANGUAGE_ROWS


def register_sql_functions(spark: SparkSession) -> None:
    cases = " ".join(f"WHEN '{alias}' THEN '{lang}'" for alias, lang, *_ in LANGUAGE_ROWS)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION lang_of(path STRING) RETURNS STRING RETURN
        CASE lower(regexp_extract(path, '[^/]\\\\.([^./]+)$', 1)) {cases} END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION inner_product(a ARRAY<FLOAT>, b ARRAY<FLOAT>)
        RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)),
        CAST(0 AS DOUBLE), (acc, v) -> acc + v)""")
