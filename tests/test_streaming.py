import datetime as dt

from deponent.streaming import transcripts as S


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"select * from {name}").collect()


def rows(spark, tmp_path):
    t = dt.datetime(2025, 1, 1, 10)
    data = [(1, "c", "k", "chat", "f", 1, "01/01/2025 10:00", "Unknown", t), (2, "c", "k", "chat", "f", 2, "later", "Ann", t + dt.timedelta(minutes=5)), (3, "c", "k", "chat", "f", 1, "01/01/2025 10:00", "Ann", t + dt.timedelta(minutes=9)), (4, "c", "k", "chat", "f", 3, "02/01/2025 10:00", "Ann", t + dt.timedelta(hours=3))]
    df = spark.createDataFrame(data, "row_id long, case_id string, conv_key string, source_kind string, source_csv string, source_row int, msg_timestamp string, sender string, loaded_at timestamp_ntz")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return S.stream_table(spark, str(tmp_path / "in"), df)


def test_repeats_and_windows(spark, tmp_path):
    stream = rows(spark, tmp_path)
    assert sorted(r.row_id for r in run(S.unique_rows(stream), "u")) == [1, 2, 4]
    assert [(r.rows, r.unresolved) for r in run(S.arrivals(stream), "a", "complete")] == [(4, 1)]
    assert sorted(r.rows for r in run(S.arrival_sessions(stream), "s", "complete")) == [1, 3]


def test_days_are_carried_by_state(spark, tmp_path):
    got = {r.row_id: r.day for r in run(S.carried_days(rows(spark, tmp_path)), "d")}
    assert got == {1: "01/01/2025", 3: "01/01/2025", 2: "01/01/2025", 4: "02/01/2025"}
