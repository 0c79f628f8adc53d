import pytest


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Small tables spend their time in compiling plans; here they are interpreted."""
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield
    spark.conf.unset("spark.sql.codegen.factoryMode")
