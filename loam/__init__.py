"""loam: a PySpark-native tabular regression and analytics engine.

Everything is written as DataFrame expressions, MLlib stages and, where
Spark has no learner, small NumPy helpers that run inside Spark tasks.
"""

__version__ = "0.1.0"
