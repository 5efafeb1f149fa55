import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import cases  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return cases.documents(spark).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
