import pytest

from stopwise.llm.common import prepare


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)
