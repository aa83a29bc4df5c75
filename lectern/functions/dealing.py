"""How many parts rows are dealt into before they are taken apart."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a part: what a task sorts is some hundred times that, whatever the size of the table.
PART_BYTES = 2 << 20


def parts_of(rows: DataFrame, text_col: str, each: int = PART_BYTES) -> int:
    """The number of parts for the texts of ``rows``: it follows their bytes, and is not less than what the session has."""
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0  # one number
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each))
