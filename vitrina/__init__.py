"""vitrina: the data work of a small online shop as Spark DataFrame jobs.

Subpackages: ``sources`` (schemas, bindings, file sources and sinks),
``functions`` (Column helpers, ids, scans), ``operators`` (batch operators),
``streaming`` (event operators and their Structured Streaming jobs) and
``plans`` (the query registry and its DuckDB statements).
"""

__version__ = "0.1.0"
