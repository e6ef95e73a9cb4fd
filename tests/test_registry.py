import math

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = [
    "sentence_spans", "line_classify", "section_carry_forward", "bm25_topk", "tfidf_cosine_topk", "hierarchical_bm25", "eligibility_rows",
    "token_f1", "per_category_summary", "stratified_split", "last_write_wins", "left_dim_join", "flatten_questions", "document_positions",
]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([canonical(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    answer = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, answer.fetchall())


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 60
