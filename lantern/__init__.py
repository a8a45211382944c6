"""lantern: DataFrame operators for posting and document pipelines on Spark.

Every public operator is a plain function ``DataFrame(s) -> DataFrame`` built
from Spark SQL expressions, joins, aggregates and windows, so it runs on
executors and can be called from a streaming ``foreachBatch`` as well.
"""

__version__ = "0.1.0"
