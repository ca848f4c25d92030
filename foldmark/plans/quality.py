"""Retrieval-quality report of a labelled fingerprint table."""

from pyspark.sql import DataFrame

from ..operators import evaluation as E


def evaluate(train: DataFrame, val: DataFrame, label: str = "label", key: str = "id") -> DataFrame:
    """All metrics over the union of both parts."""
    return E.quality_report(train.unionByName(val), label, key)
