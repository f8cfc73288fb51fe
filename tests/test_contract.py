import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from fitloom.catalog.base import TABLES

DATA = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
SAMPLE = ["item_weights", "clean_profiles", "extract_all", "sub_profiles", "knn_topk", "analyze_batch",
          "method_report", "tfidf_cosine", "bm25_pairs", "json_normalize", "stratified_split"]


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 95


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and df.columns == ["occ_key", "item", "weight", "tier"]


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = contract.queries()[name](spark, DATA)
    cur = db.execute(contract.oracle_sql()[name])
    assert _rows(df.columns, df.collect()) == _rows([c[0] for c in cur.description], cur.fetchall())
