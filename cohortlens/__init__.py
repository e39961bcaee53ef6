"""cohortlens: per-user behaviour features and clustering as Spark DataFrame operators.

Every operator takes and returns DataFrames built from native Spark SQL
expressions (plus MLlib's k-means where a fitted model is the point), so the
same code runs on ``local[*]`` and on a cluster.  See README.md for the map
from operators to modules.
"""

__version__ = "0.1.0"
