"""recoflow: personalization and ranking analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames, stays lazy, and never collects
data to the driver.  Sub-packages:

- ``sources``    readers, writers and the stand-in views over the test tables
- ``functions``  Column -> Column helpers (LLR, vector maths, time parsing)
- ``operators``  DataFrame -> DataFrame operators (entities, correlators,
                 popularity, retrieval, factors, baskets, features, metrics...)
- ``plans``      registered end-to-end queries with their SQL oracles
- ``streaming``  Structured Streaming forms of popularity, baskets, bandits
"""

from recoflow.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
