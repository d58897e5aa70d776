"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from readloom import queries as own

SQL = own.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    path = f"{sf_dir}/documents.parquet"
    con.execute(f"create view documents as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, sf_dir, name):
    df = own.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_all_have_sql():
    assert set(SQL) == set(own.queries())


def test_reads_of_files_are_derived_once(spark, sf_dir, monkeypatch, tmp_path):
    reads = own._reads(spark, sf_dir)
    folder = str(tmp_path)

    def seen(batches):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        yield from batches

    counted = reads.mapInArrow(seen, reads.schema)
    monkeypatch.setattr(own, "_reads", lambda spark, sf_dir: counted)
    monkeypatch.setattr(own, "_folders", {})
    own._fastq(spark, sf_dir)
    assert len(os.listdir(folder)) == reads.rdd.getNumPartitions()
