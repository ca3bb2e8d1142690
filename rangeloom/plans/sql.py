"""The SQL surface: temporary views and a table function over an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register(spark: SparkSession, vectors: DataFrame, index: DataFrame, prefix: str = "rk") -> None:
    """Views ``{prefix}_vectors`` and ``{prefix}_index``, and the SQL functions ``{prefix}_l2sqr`` and ``{prefix}_neighbours(l, r, k)``."""
    vectors.createOrReplaceTempView(f"{prefix}_vectors")
    index.createOrReplaceTempView(f"{prefix}_index")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_l2sqr(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE
        RETURN aggregate(zip_with(CAST(a AS ARRAY<DOUBLE>), CAST(b AS ARRAY<DOUBLE>), (x, y) -> (x - y) * (x - y)), 0D, (s, t) -> s + t)""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_neighbours(l BIGINT, r BIGINT, k INT)
        RETURNS TABLE (node BIGINT, nbr BIGINT, dist DOUBLE, rank INT)
        RETURN SELECT node, nbr, dist, rank FROM (
            SELECT node, nbr, dist, row_number() OVER (PARTITION BY node ORDER BY dist, nbr) AS rank FROM {prefix}_index
            WHERE node BETWEEN l AND r AND ((side = 'L' AND sub < l AND l <= nbr) OR (side = 'R' AND nbr <= r AND r < sub)))
        WHERE rank <= k""")
