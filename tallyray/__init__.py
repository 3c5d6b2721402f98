"""tallyray: a Spark-native change-log materializer for lending-market event ledgers.

Raw logs are scanned, decoded, de-duplicated and folded into current and as-of
state tables (reserve configuration, reserve rates, per-user scaled positions,
eMode categories) with DataFrame / SQL operators.  Sub-packages:

* ``sources``    -- table readers, fixture adapters, snapshot loaders
* ``functions``  -- column expressions (hex words, ray maths, addresses, text)
* ``operators``  -- decode, dedup, guard, folds, joins, reports
* ``plans``      -- named end-to-end queries and their DuckDB oracles
* ``streaming``  -- Structured Streaming apply / dedup jobs
"""

__version__ = "0.1.0"
