"""Star queries over streams: a mapped streaming table answers patterns of one subject row by row.

An extension: graph patterns within one row need no state, so they hold on `readStream` tables as on others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..federation import Federation
from ..sources.table import from_context


def stream_query(stream: DataFrame, context: dict, sparql: str, name: str = "stream") -> DataFrame:
    """The streaming result of a query whose patterns share one subject, with filters and projections."""
    fed = Federation(stream.sparkSession)
    fed.add_source(from_context(stream, context, name))
    return fed.query(sparql)
