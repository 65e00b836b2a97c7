import re

import duckdb
import pytest

import __spark_entry__ as entry
from corpusq.plans.tables import SCHEMAS

SF = "/root/testdata/sf0.001"
CHECKED = (
    "retrieve_answers chunk_rows expand category_pages_batched corpus_build stop_word_filter vector_top2_by_cells "
    "token_histogram answer_extract"
).split()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    core = {q for q in entry.queries() if q != "pipeline" and not re.match(r"op\d+_", q)}
    assert core - set(entry.oracle_sql()) == set()


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in SCHEMAS:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    found = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert found == sorted(repr([plain(v) for v in r]) for r in cursor.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{SF}/benchmark.parquet").count()
