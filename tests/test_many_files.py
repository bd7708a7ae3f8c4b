"""Queries over tables of several files against their SQL twins; Spark deals these files over several tasks."""

import duckdb
import pytest
from compare import difference

import __spark_entry__ as entry

FOLDER = entry.SMALL


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """The events in six files, ids dealt over all of them."""
    folder = tmp_path_factory.mktemp("dealt")
    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(6, "event_id").write.parquet(f"{folder}/events.parquet")
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    connection.execute("CREATE VIEW tracks AS SELECT event_id // 10 AS frame_id, user_id AS track_id FROM events")
    return str(folder), connection


@pytest.mark.parametrize("name", ["j3_frame_numbers", "j4_over_limit", "j5_duplicate_tracks"])
def test_parts_of_many_files_are_one_batch(spark, dealt, name):
    folder, connection = dealt
    assert difference(entry.queries()[name](spark, folder), connection, entry.oracle_sql()[name]) is None
