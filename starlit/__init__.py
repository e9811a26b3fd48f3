"""starlit — Spark-native analytics for per-object astronomical light curves.

Every operator is a DataFrame -> DataFrame function built from Spark SQL
expressions, aggregates and windows; see README.md for the map.
"""

from starlit.schema import Params

__all__ = ["Params"]
