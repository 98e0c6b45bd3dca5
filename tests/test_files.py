import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from inkfold.plans import catalog


def test_folder_sizes_of_ten_megabytes_and_more_are_those_of_the_sql(spark, tmp_path):
    sizes = [5, 1023, 1024, 10_239, 10_240, 1_048_575, 1_048_576, 10_433_331, 10_485_759, 10_485_760, 13_000_000, 40_000_000]
    rows = {"page_id": range(len(sizes)), "url": [f"http://h{i}/{i}" for i in range(len(sizes))], "html": ["x" * n for n in sizes]}
    pq.write_table(pa.table({k: list(v) for k, v in rows.items()}), tmp_path / "pages.parquet", row_group_size=1)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet')")
    got = catalog.QUERIES["folder_summary"](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"select {columns} from ({catalog.ORACLES['folder_summary']}) q").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "10.0 MB" in {row.shown for row in got.collect()}
