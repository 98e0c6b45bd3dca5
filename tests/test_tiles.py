import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from inkfold.plans import catalog


def test_grey_levels_are_those_of_the_sql(spark, tmp_path):
    # places next to a step, where single and double precision fall on either side of it
    steps = ((np.arange(64) - 20) / np.float32(400)).astype(np.float32)
    rows = [np.nextafter(steps, np.float32(way)).tolist() for way in (-9, 9)] + [steps.tolist(), None, [0.1] * 8, [None, float("nan"), float("inf"), -float("inf")] * 16]
    path = str(tmp_path / "embeddings.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())}), path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{path}')")
    for name in ("blend_fill", "read_tiles", "mask_union", "labelled_marks"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        columns = ", ".join(f'"{c}"' for c in got.columns)
        want = con.execute(f"select {columns} from ({catalog.ORACLES[name]}) q").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
