"""The catalogue of queries: the operators of the inventory that are reproduced (the README names the others), with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.plans import analytics_queries as analytics_queries  # these four add their queries to those of frame_queries
from lattica.plans import frame_queries, sql_queries
from lattica.plans import state_queries as state_queries
from lattica.plans import stream_queries as stream_queries
from lattica.plans import surface_queries as surface_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(text)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _sql(text) for name, text in sql_queries.SAME.items()},
    **{name: _sql(spark_text) for name, (spark_text, _) in sql_queries.PAIRS.items()},
    **frame_queries.QUERIES,
}
ORACLE_SQL: dict[str, str] = {
    **sql_queries.SAME,
    **{name: duck_text for name, (_, duck_text) in sql_queries.PAIRS.items()},
    **frame_queries.ORACLE_SQL,
}
