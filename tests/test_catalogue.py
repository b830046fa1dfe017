"""Every query of the catalogue against its DuckDB SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from docketspark.plans import additional, catalogue  # noqa: F401  registers its queries

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, tmp_path, name):
    catalogue.QUERIES[name](spark, str(SF)).coalesce(1).write.parquet(str(tmp_path / "out"))
    if name not in catalogue.ORACLES:
        assert spark.read.parquet(str(tmp_path / "out")).count() > 0
        return
    want, got = f"({catalogue.ORACLES[name]})", f"'{tmp_path}/out/*.parquet'"
    columns = sorted(duck.sql(f"SELECT * FROM {want}").columns)
    assert columns == sorted(duck.sql(f"SELECT * FROM {got}").columns)
    names = ", ".join(f'"{c}"' for c in columns)
    duck.sql(f"CREATE OR REPLACE TABLE want AS SELECT {names} FROM {want}")
    duck.sql(f"CREATE OR REPLACE TABLE got AS SELECT {names} FROM {got}")
    assert duck.sql("FROM want").types == duck.sql("FROM got").types
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.sql(f"SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}").fetchall() == []
