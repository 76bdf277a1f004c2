"""Query-log cost analytics on Spark.

A query history and a billing-usage table go in; literal-insensitive fingerprints, attributed cost,
gateway coverage, redundant patterns and realized savings per rule come out.  Every operator takes
DataFrames plus :class:`Params` and returns a lazy DataFrame.
"""

from tallyframe.params import Params

__all__ = ["Params"]
