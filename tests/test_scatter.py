"""Code-blocks laid out sample by sample: how the work is dealt out, and odd tables."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry
from tessera.plans import catalog


def _parts(folder, keys, sizes):
    pq.write_table(pa.table({"p_partkey": pa.array(keys, pa.int64()), "p_size": pa.array(sizes, pa.int32())}), folder / "part.parquet")
    return str(folder)


@pytest.mark.parametrize("keys", [list(range(600)), [127] * 600])
def test_scatter_is_dealt_out(spark, tmp_path, monkeypatch, keys):
    """One file of one row group, of different keys or of copies of one: tasks by the samples, none with much more than its share."""
    folder = _parts(tmp_path, keys, [31] * 600)
    for most, least in ((1 << 22, spark.sparkContext.defaultParallelism), (1 << 16, 9)):
        monkeypatch.setattr(geometry, "SAMPLES_A_TASK", most, raising=False)
        rows = [r.n for r in catalog.queries()["codeblock_scatter"](spark, folder).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(rows) == sum((1 + k % 64) * 32 for k in keys)
        assert len(rows) >= least and max(rows) < 1.5 * sum(rows) / len(rows)


@pytest.mark.parametrize(
    "keys, sizes",
    [
        ([], []),
        ([None, 5, None], [3, None, None]),
        ([1, 2, 3, 64], [-1, -33, 31, 0]),  # no width
        ([-64, -63, -62, -1, -17, -40], [5, 5, 5, 5, 5, 5]),
        ([-80, -81, 7], [-7, -3, -7]),  # both sides below zero
        ([7, 7, 7, (1 << 60) + 5, (1 << 58) - 1], [4, 4, 9, 2, 3]),
    ],
)
def test_scatter_of_odd_tables(spark, tmp_path, keys, sizes):
    folder = _parts(tmp_path, keys, sizes)
    got = catalog.queries()["codeblock_scatter"](spark, folder)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
        want = con.execute(catalog.oracle_sql()["codeblock_scatter"])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
