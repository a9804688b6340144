"""suitelens: test-run analytics as Spark DataFrame operators.

Sub-packages:

* ``sources``   -- file readers (reports, logs, inventories) returning DataFrames
* ``sinks``     -- writers for the summary CSV, inventory TSV, counter JSON, node lists
* ``functions`` -- column expressions and the one per-document XML parser
* ``operators`` -- ``DataFrame -> DataFrame`` building blocks (suites, logs, inventory,
  shards, lifecycle, skew-safe ranking)
* ``streaming`` -- Structured Streaming forms of the lifecycle and log operators
* ``plans``     -- the registered queries over the driver tables, with DuckDB oracles
"""

__all__ = ["session"]
