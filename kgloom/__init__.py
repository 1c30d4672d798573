"""kgloom: knowledge-graph analytics on Spark DataFrames.

Subpackages: ``functions`` (Column expressions), ``operators`` (DataFrame to DataFrame), ``sources`` (readers and writers),
``streaming`` (Structured Streaming jobs) and ``plans`` (the registered queries with their SQL twins).
"""
