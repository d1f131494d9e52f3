"""Native operators run no Python on executors; the others see only the columns that they need."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_mix_sources", "op4_quality_rules", "op8_line_dedup"])
def test_native_operators(spark, name):
    from saithong.llm.queries import QUERIES

    p = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in p for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_sql_matches(spark):
    import duckdb

    from saithong.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, SF)
        cur = con.execute(sql)
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        show = lambda rows: sorted(tuple(f"{r[c]:.6f}" if isinstance(r[c], float) else str(r[c]) for c in sorted(cols)) for r in rows)  # noqa: B023, E731
        assert show([r.asDict() for r in df.collect()]) == show([dict(zip(cols, r, strict=True)) for r in cur.fetchall()]), name
