"""Every query against its SQL, and the driver's contract."""

import pytest

import __spark_entry__
from decidra.plans import catalogue

SQL = catalogue.oracle_sql()


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf, agree):
    agree(catalogue.queries()[name](spark, sf), SQL[name])


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "score", "rank"] and df.count() > 0


def test_partitioning_does_not_matter(spark, sf):
    from decidra.operators import recommend

    products = catalogue.facts(spark, sf)
    rows = lambda n: recommend.market_top(products.repartition(n)).select("id", "market_score", "rank").collect()
    assert rows(1) == rows(7)


def test_plans_push_down(spark, sf):
    from decidra.sources.readers import table

    plan = table(spark, sf, "documents").filter("lang = 'en'").select("doc_id")._jdf.queryExecution().toString()
    assert "EqualTo(lang,en)" in plan and "struct<doc_id:bigint,lang:string>" in plan
