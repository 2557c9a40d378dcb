"""tabsight: table profiling and model comparison expressed as Spark jobs.

Every operator takes and returns a ``pyspark.sql.DataFrame`` (or a small
driver-side value derived from a Spark aggregate).  Statistics are computed
with built-in Spark SQL aggregates so Catalyst can prune columns, push filters
into the parquet scan and plan partial (map-side) aggregation.
"""

from tabsight.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
