"""plumbline: a PySpark-native audit of a data estate.

Catalog frames, data frames, metric histories and statement logs go in as
DataFrames; findings, scores and ranked actions come out as DataFrames.
"""

from plumbline.audit import Audit

__all__ = ["Audit"]
