"""Every query with SQL gives DuckDB's rows."""

import duckdb
import numpy as np
import pytest

from seqloom.plans import queries
from seqloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "events documents embeddings benchmark labels conversations pages".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(records, columns):
    return sorted(repr([None if v != v else v for v in r]) for r in records)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    want = [[r[i] for i in order] for r in rel.fetchall()]
    got = [list(r) for r in df.select(*columns).collect()]
    assert rows(got, columns) == rows(want, columns)


def test_search_reads_all_documents(spark, tmp_path, monkeypatch):
    texts = ["ACGTACGTTTGACA", "xx TATAAT", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made, init = [], queries.sampler.Search.__init__
    monkeypatch.setattr(queries.sampler.Search, "__init__", lambda self, *a, **b: made.append((a, b)) or init(self, *a, **b))
    monkeypatch.setattr(queries.sampler.Search, "run", lambda self: self.step() or self)
    assert QUERIES["nested_sampling_run"](spark, str(tmp_path)).count() == 4  # one of each thread
    (args, options), = made
    assert sorted(r["seq"] for r in args[0].collect()) == ["", "ACGTACGTTTGACA", "TATAAT"] and options == {"seed": 1}


def test_motif_longer_than_all_sequences():
    assert queries.likelihood.block_scores(np.zeros((3, 4), int), np.zeros((7, 4))).shape == (3, 0)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
