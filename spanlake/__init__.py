"""Spark-native analytics for long documents and the questions asked about them.

Every public operator takes DataFrames and returns a lazy DataFrame; nothing is collected on the
driver except tables whose size is fixed by the caller (a sample of ids, one summary row, a report).
"""

__version__ = "0.1.0"
