"""Every query runs on the smallest tables, and agrees with its SQL where it has one."""

import duckdb
import pytest

from wayrisk.plans.oracles import ORACLES
from wayrisk.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each family; the driver compares all of them.
CHECKED = ["zone_event_risk", "route_risk_aggregate", "route_points", "multi_mode_risk", "source_credibility", "relevance_filter", "keyword_classify", "token_cosine", "rolling_quota", "union_dedup", "json_response", "entity_normalize", "cycle_stats", "api_latency", "mode_events", "route_locations", "even_samples", "sea_lanes", "rotated_queries"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_sql(spark, tables, name):
    mine = QUERIES[name](spark, DATA).toPandas()
    columns = sorted(mine.columns)
    sql = tables.sql(ORACLES[name]).df()
    assert sorted(sql.columns) == columns
    key = lambda df: df[columns].sort_values(columns, key=lambda c: c.astype(str)).reset_index(drop=True)
    a, b = key(mine), key(sql)
    assert len(a) == len(b) and all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in columns)


@pytest.mark.parametrize("name", ["regex_ner", "unique_locations", "headline_similarities", "incident_clusters", "ingest_cycle", "can_fetch_state", "intensity_model", "json_response"])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(QUERIES)
