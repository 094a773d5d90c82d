import pytest
from linkforge.llm.storage import on_workers


@pytest.fixture(autouse=True)
def _workers(spark):
    on_workers(spark)
