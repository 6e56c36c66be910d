"""The operators' SQL against their queries, on the given tables and on one with many links."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from tests.test_oracles import rows
from textlake.llm import queries

SF = "/root/testdata/sf0.01"


def same(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet{'' if sf == SF else '/*.parquet'}')")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    return got


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, name, SF)


def test_op8_equals_its_sql_where_vectors_link(spark, tmp_path):
    rng = np.random.default_rng(17)
    vectors = []
    for g in range(50):
        centre = rng.normal(size=32)
        vectors += [(centre + rng.normal(size=32) * 0.09).astype(np.float32).tolist() for _ in range(g % 9 + 1)]
    table = [(i, v, f"label{i % 3}") for i, v in enumerate(vectors)]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label string").repartition(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    for t in ("documents", "pages"):
        spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / f"{t}.parquet"))
    got = same(spark, "op8_pivot_permutation", str(tmp_path))
    assert got.n_links.sum() > 200
