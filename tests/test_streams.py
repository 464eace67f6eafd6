"""Streams over the given tables, however a table is stored."""

import pytest

from glossaline.workloads import base, stream_queries


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_streams_from_one_file_and_from_a_folder(spark, tmp_path, files):
    given = base.table(spark, "/root/testdata/sf0.001", "documents").limit(50)
    if files == 1:
        given.toPandas().to_parquet(f"{tmp_path}/documents.parquet", coerce_timestamps="us")
    else:
        given.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    given.limit(1).write.parquet(f"{tmp_path}/labels.parquet")  # another table beside it is not read
    out = f"{tmp_path}/out"
    stream = stream_queries.stream_of(spark, str(tmp_path), "documents")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 50


def test_event_time_health_of_events_in_several_files_equals_the_sql(spark, tmp_path):
    import duckdb
    from compare import rows_of

    from glossaline.workloads import ORACLES, QUERIES

    base.table(spark, "/root/testdata/sf0.001", "events").repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    cur = con.execute(ORACLES["stream_health_event_time"])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got = QUERIES["stream_health_event_time"](spark, str(tmp_path))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want
