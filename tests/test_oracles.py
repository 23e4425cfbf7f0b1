"""Every query with SQL against DuckDB over the same tables; the others must run and give rows."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from strandline import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, data, same, name):
    same(queries.QUERIES[name](spark, data).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df())


@pytest.fixture
def many_partitions(spark):
    """Partitions of a few kB, as many for each exchange as its own columns take: as on tables that are much larger."""
    sizes = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["split_paired", "merge_interleave", "split_pairs", "merge_sample"])
def test_same_as_sql_in_many_partitions(spark, duck, data, same, many_partitions, name):
    same(queries.QUERIES[name](spark, data).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df())


@pytest.fixture
def repeated(data, tmp_path):
    """Tables of two files: each id once more under another text, and rows without one of their numbers. (folder, DuckDB)
    DuckDB has one thread: with more, rows of one id come in another order than that of the files."""
    con = duckdb.connect(config={"threads": 1})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    missing = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}
    for t, keys in missing.items():
        (tmp_path / f"{t}.parquet").mkdir()
        more = "".join(f" UNION ALL SELECT * REPLACE (NULL::BIGINT AS {k}) FROM {t} WHERE {keys[0]} % 5 = 0" for k in keys)
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet/0.parquet'")
        con.execute(f"COPY (SELECT * REPLACE ('GATTACA' || text AS text) FROM {t}{more}) TO '{tmp_path}/{t}.parquet/1.parquet'")
    for t in missing:
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return str(tmp_path), con


@pytest.mark.parametrize("name", ["merge_interleave", "merge_sample", "split_pairs"])
def test_same_as_sql_with_repeated_and_missing_ids(spark, repeated, same, many_partitions, name):
    folder, con = repeated
    found, wanted = queries.QUERIES[name](spark, folder), con.sql(queries.ORACLE_SQL[name])
    frame = lambda rows, x: pd.DataFrame(rows, columns=x.columns, dtype=object)  # noqa: E731 (keeps whole numbers beside nulls)
    same(frame(found.collect(), found), frame(wanted.fetchall(), wanted))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_rows(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_edit_correction_gains(spark, data):
    from strandline.operators.distance import edit_distance
    from strandline.sources import tables

    truth = {r.read_id: (r.seq, r.truth) for r in tables.tiled(spark, data).collect()}
    fixed = {r.read_id: r.seq for r in queries.correct_edit(spark, data).collect()}
    before = sum(edit_distance(s, t) for s, t in truth.values())
    after = sum(edit_distance(fixed[k], t) for k, (_, t) in truth.items())
    assert set(fixed) == set(truth) and after < 0.2 * before


def test_edit_placement_finds_the_true_place(spark, data):
    from strandline.sources import tables

    start = {r.read_id: r.start0 for r in tables.tiled(spark, data).collect()}
    for query in (queries.align_edit, queries.align_edit_indels):
        rows = query(spark, data).collect()
        assert len(rows) == len(start)
        for r in rows:
            places = [x.split(":") for x in r.maps.split(" ")]
            assert any(strand == "+" and abs(int(at) - start[r.read_id]) <= r.edit for strand, at, _ in places)


def test_infix_takes_the_whole_read(spark, data):
    from strandline.sources import tables

    truth = {r.read_id: (r.start0, sum(x != y for x, y in zip(r.seq, r.truth, strict=True))) for r in tables.tiled(spark, data).collect()}
    rows = queries.edit_infix(spark, data).collect()
    assert len(rows) == len(truth)
    assert all(r.edit == truth[r.read_id][1] and str(min(truth[r.read_id][0], 20) + 80) in r.ends.split(" ") for r in rows)
