"""Every registered query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from nearfield.plans.catalog import FLAGSHIP, QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, tables, name, tmp_path):
    out = QUERIES[name](spark, SF)
    out.write.parquet(str(tmp_path / "out"))
    names = ", ".join(f'"{c}"' for c in out.columns)
    mine, other = f"SELECT {names} FROM '{tmp_path}/out/*.parquet'", f"SELECT {names} FROM ({SQL[name]})"
    assert tables.sql(f"SELECT * FROM ({mine} EXCEPT ALL {other}) UNION ALL SELECT * FROM ({other} EXCEPT ALL {mine})").fetchall() == []


def test_flagship_has_rows(spark):
    assert QUERIES[FLAGSHIP](spark, SF).count() > 0


def test_drawn_edges_are_mesh_edges(spark):
    rows = QUERIES["mesh_edges"](spark, SF)
    assert rows.count() == rows.distinct().count() > 0


@pytest.mark.parametrize("name", ["mesh_neighbors", "tile_blob"])
def test_same_rows_with_many_copies_of_places(spark, name, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k + 6000 * i AS doc_id, 'en' AS lang, 100 AS n_chars FROM range(100) a(k), range(100) b(i)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    mine = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, mine.collect())) == sorted(con.sql(f"SELECT {', '.join(mine.columns)} FROM ({SQL[name]})").fetchall())
