"""Ledger rows as they arrive. Classification (K1 to K5) looks at one row at a time, so it runs on a stream as it stands;
nothing that needs a whole statement, account or case is offered here."""

from __future__ import annotations

from ledgerloom.operators.classify import classify
from pyspark.sql import DataFrame, SparkSession

LEDGER_SCHEMA = "case_id long, account_id string, id long, date date, tx_type string, amount decimal(18,2), description string"


def classified_stream(spark: SparkSession, path: str) -> DataFrame:
    """New parquet files of ledger rows below a path, classified: a streaming DataFrame for any sink in append mode."""
    return classify(spark.readStream.schema(LEDGER_SCHEMA).parquet(path))
