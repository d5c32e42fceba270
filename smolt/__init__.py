"""smolt: tag-telemetry and mark-recapture analytics as Spark DataFrame jobs.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver. Subpackages:

* ``functions`` – null-safe column expressions (R-compatible NULL rules,
  time parsing, recoding, link functions).
* ``sources``   – typed CSV scans, by-name directory scans, sinks, and the
  bindings of the driver tables to the telemetry data model.
* ``operators`` – relational building blocks (filters, joins, aggregates,
  skew-safe sequence windows, reshaping, group statistics, encounter
  histories and CJS survival models).
* ``plans``     – named end-to-end pipelines and the query catalogue.
* ``streaming`` – incremental detection cleaning over a file stream.
"""

from smolt.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
