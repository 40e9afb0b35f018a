"""Values that lie a little beside a half are rounded as the twins round them."""

import duckdb
import pytest

from lattiq.plans import registry


@pytest.mark.parametrize("name", ["w12_next_dominators", "a24_archive_evolution"])
def test_candidates_near_a_half(spark, tmp_path, name):
    path, con = f"{tmp_path}/supplier.parquet", duckdb.connect()
    con.execute(f"COPY (SELECT i + 1 AS s_suppkey, (i % 2)::INTEGER AS s_nationkey, (-99965 + (i // 2) * 5 + 100000 * (i % 3 // 2)) / 100 AS s_acctbal FROM range(400) t(i)) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{path}'")
    df = registry.queries()[name](spark, str(tmp_path))
    got = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(got.fetchall())
