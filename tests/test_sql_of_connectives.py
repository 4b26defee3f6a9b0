"""Connectives one after the other, each with a comma: the same parts as in the SQL."""

import duckdb
import pytest

from argolith.queries import QUERIES, SQL

TURNS = [
    (1, 0, "Cats are small, or, and dogs are large here, that, that and birds are loud, but fish are not. More of it, and, so then"),
    (1, 1, "Cats are large, or, and dogs are small here, or, and, but they are not loud, so, when it rains, cats are not large."),
    (2, 0, "It was so, however, because cats are large, or , and dogs are small. And so, and,and birds are loud, oré they were"),
    (2, 1, "Or, and dogs are large here, or\n, and cats, and"),
]


@pytest.mark.parametrize("name", ["fallback_edus", "central_prop_overlap", "context_window", "confidence_gate", "bas_edges", "ancestor_depths"])
def test_query_equals_its_sql_there(spark, tmp_path, name):
    spark.createDataFrame([(t, n, "user", x) for t, n, x in TURNS], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr([dict(zip(names, r))[c] for c in cols]) for r in cur.fetchall())
    assert want and sorted(repr([r[c] for c in cols]) for r in df.collect()) == want
