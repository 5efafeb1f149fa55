"""Query keys wired to operators over the derived registry views.

Nested results are flattened in the query modules to plain columns, so that
they compare with their SQL twins; operators return Spark's nested types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestry.plans.views import Views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(key: str):
    def register(build: Callable[[Views], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        return build

    return register


from attestry.plans import scalar_queries  # noqa: E402,F401
from attestry.plans import registry_queries  # noqa: E402,F401
from attestry.plans import score_queries  # noqa: E402,F401
from attestry.plans import io_queries  # noqa: E402,F401
from attestry.plans import stream_queries  # noqa: E402,F401
