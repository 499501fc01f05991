"""Quality rules on a stream: each rule looks at one row, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldsieve.operators.quality import Rule, flags


def stream_flags(stream: DataFrame, rules: list[Rule], rowid: str) -> DataFrame:
    """(test_name, test_id, row_num) as rows arrive. rowid must be a column of the stream: rows can't be numbered in it."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return flags(stream, rules, rowid)
