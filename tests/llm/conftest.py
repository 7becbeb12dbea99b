import pytest
from cases import CLASHING, ODD_ROWS, SCHEMA, SF
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
