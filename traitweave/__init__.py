"""Feature-matrix, rank-network, sampling and model-evaluation operators on Spark.

Every operator takes DataFrames and returns DataFrames. Large matrices stay in
long form ``(key, feature, value)``; wide form and vectors are built only where
MLlib needs them.
"""
