"""lexicount: corpus preparation and evaluation analytics on Spark.

Modules: ``sources`` (readers), ``functions`` (column expressions),
``operators`` (audit, budget, mixture, prefix_sum, packing, leakage, scores,
tokenizer), ``sinks`` (writers), ``streaming`` (Structured Streaming jobs),
``plans`` (registered queries with SQL oracles), ``session`` (session and
lineage helpers), ``config`` (parameters and fixed values).
"""

__version__ = "0.1.0"
