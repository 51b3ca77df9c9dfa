import numpy as np

from tessera.sources import synthetic
from tessera.streaming import decode


def test_new_files_are_decoded_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, value):
        (folder / name).write_bytes(synthetic.encode(np.full((1, 6, 5), value), levels=1))

    def run():
        query = decode.lines(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(120)
        assert query.exception() is None

    put("a.j2k", 9)
    (folder / "bad.j2k").write_bytes(b"nothing")
    run()
    put("b.j2k", 200)
    run()
    rows = spark.read.parquet(str(tmp_path / "out/lines")).collect()
    assert sorted((r.image_id[-5:], r.y, tuple(r.samples)) for r in rows) == [(n, y, (v,) * 5) for n, v in (("a.j2k", 9), ("b.j2k", 200)) for y in range(6)]
    assert [r.image_id[-7:] for r in spark.read.parquet(str(tmp_path / "out/errors")).collect()] == ["bad.j2k"]
