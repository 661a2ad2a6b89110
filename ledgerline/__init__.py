"""Revenue and pipeline analytics on PySpark.

Every operator takes and returns DataFrames, is lazy, and is built from Spark's own column expressions.
"""

from ledgerline.schemas import Tables

__all__ = ["Tables"]
