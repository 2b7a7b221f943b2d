import pytest

from tests import oracle
from veritally.plans import hosted, literals, logs, records, rules, texts, trees, verdicts  # noqa: F401


@pytest.fixture(scope="module")
def duck():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(hosted.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = hosted.QUERIES[name](spark, oracle.SF)
    if name in hosted.ORACLE_SQL:
        oracle.compare(df, hosted.ORACLE_SQL[name], duck)
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
