"""Registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tesselon import queries, queries_operators, queries_solvers

SF = "/root/testdata/sf0.001"
#: Iterations of many small jobs, which the driver's own comparison runs.
SLOW = {"amg_fdm", "preconditioned_cg", "cg_fdm", "hpcg_cg_k", "newton_vector", "gs_fdm", "jacobi_k", "power_iter_k"}
OWN = [n for n, f in queries.QUERIES.items() if f.__module__ in (queries_operators.__name__, queries_solvers.__name__) and n not in SLOW and not n.startswith("dist_")]
CHANGED = ["exchange", "mat_consistent", "length_to_ptrs", "rewind_ptrs", "assembly_local_indices", "backward_euler_scalar", "dist_cosine", "find_owner"]


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return found


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return round(float(value), 6) + 0.0 if type(value).__name__ == "Decimal" else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", OWN + [n for n in CHANGED if n in queries.QUERIES])
def test_query_is_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    said = con.execute(queries.SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(df.columns) == sorted(names)
    assert ordered(df.select(names).collect()) == ordered(said.fetchall())


def test_every_query_has_its_sql():
    assert set(queries.QUERIES) == set(queries.SQL)
