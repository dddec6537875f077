import duckdb

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_belongs_to_a_query_and_runs(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    for name, sql in oracles.items():
        con.execute(f"EXPLAIN {sql}")


def test_flagship_matches_its_sql(spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()["project_cost_summary"](spark, sf)
    want = con.sql(entry.oracle_sql()["project_cost_summary"]).df().sort_values("project_id")[df.columns]
    got = df.toPandas().sort_values("project_id")
    for c in ("total_cost_kpy", "gross_profit", "effective_cost_rate", "risk_level"):
        assert got[c].tolist() == want[c].tolist()


def test_python_workers_need_no_copy_of_the_package(tmp_path):
    """Python functions run where the package is not importable."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from girder.models import forest
from girder.session import build_session
spark = build_session(master="local[2]", shuffle_partitions=2, **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path / 'c')!r}}})
df = spark.range(40).selectExpr("id", "cast(id % 7 as double) a", "if(id = 3, 99D, 1D) b")
print("rows", forest.detect(df, ["id"], ["a", "b"], trees=5).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "rows 40" in done.stdout, done.stderr[-2000:]
