"""sparkjourney: customer-journey analytics on event and order tables, built on Spark.

Every operator is a DataFrame -> DataFrame function expressed with Spark SQL
expressions, window functions, joins and aggregates (plus Spark ML for the
model fits), so Catalyst plans it and the same code runs on a laptop sample
or a cluster.
"""

from sparkjourney.session import get_spark, materialize  # noqa: F401
from sparkjourney.schema import EVENT_COLUMNS  # noqa: F401

__version__ = "0.1.0"
