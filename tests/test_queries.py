"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from quillmark.plans.all import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, oracle, name):
    df, rel = registry.QUERIES[name](spark, SF), oracle.sql(registry.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_queries_without_sql_run(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE):
        assert registry.QUERIES[name](spark, SF).count() > 0, name


def test_every_category_occurs(spark):
    """Each name that policies map can come out of its metric, and no other does."""
    from quillmark.functions import metrics
    from quillmark.plans import measures

    made = metrics.derive(measures.issuers(spark, SF.replace("0.001", "0.01")), list(metrics.DOMAINS)).cache()
    for name, domain in metrics.DOMAINS.items():
        told = {r[0] for r in made.select(name).distinct().collect()} - {None}
        # Some trends of margins are too rare here; other tests have them.
        assert told == set(domain) or (name.startswith("margin_trend") and told < set(domain)), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
