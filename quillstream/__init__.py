"""quillstream: a Spark-native engine for bibliographic data.

Subpackages: ``sources`` (readers), ``functions`` (column expressions),
``operators`` (DataFrame to DataFrame), ``plans`` (named queries with their SQL
oracles), ``streaming`` (incremental ingest) and ``llm`` (training-data
operators, which nothing else here imports).
"""

__version__ = "0.1.0"
