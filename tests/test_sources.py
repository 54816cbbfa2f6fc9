import os
import tempfile

from pyspark.sql import functions as F

from sparkjourney.sources import (
    read_clickstream_csv, clickstream_to_events, write_stage, write_by_cluster, export_cluster, profile,
    save_model,
)

CSV = """UserID,SessionID,Timestamp,EventType,ProductID,Amount,Outcome,Year,Month,Day
1,9,05:07.5,login,,,,2024,1,2
1,9,35:08.0,purchase,prod_1,12.5,,2024,1,2
2,9,66:00.0,click,prod_2,,,2024,1,2
3,9,00:01.0,click,prod_2,,,2024,13,2
4,9,00:01.0,page_view,prod_3,,,,1,2
"""

CSV_FULL = """Day,Month,Year,Amount,ProductID,EventType,Timestamp,UserID
1,1,2024,,,login,2024-01-01 21:26:04.358965,9
1,1,2024,,,login,not a time,9
"""

CSV_EXTRA_COLUMN = """UserID,SessionID,Timestamp,EventType,ProductID,Amount,Outcome,Year,Month,Day
9,1,2024-01-01 21:26:04.358965,login,,,,2024,1,1
9,1,not a time,login,,,,2024,1,1
"""


def _write(text):
    d = tempfile.mkdtemp(prefix="sj-csv-", dir="/tmp")
    p = os.path.join(d, "clicks.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_clickstream_csv_parts_drop_bad_times(spark):
    ev = clickstream_to_events(read_clickstream_csv(spark, _write(CSV)), ts_format="parts")
    got = sorted((r.user_id, str(r.ts), r.event_type) for r in ev.collect())
    assert got == [(1, "2024-01-02 00:05:07.500000", "login"), (1, "2024-01-02 00:35:08", "purchase")]
    assert set(ev.columns) >= {"event_id", "user_id", "ts", "event_type", "product_id", "amount"}


def test_clickstream_csv_missing_column_fails(spark):
    import pytest
    with pytest.raises(ValueError):
        read_clickstream_csv(spark, _write("UserID,EventType\n1,login\n"))


def test_clickstream_csv_full_timestamps(spark):
    # columns in another order, and an extra column: matched by header name
    for text in (CSV_FULL, CSV_EXTRA_COLUMN):
        ev = clickstream_to_events(read_clickstream_csv(spark, _write(text)), ts_format="full")
        assert [(r.user_id, str(r.ts)) for r in ev.collect()] == [(9, "2024-01-01 21:26:04.358965")]


def test_write_by_cluster_and_pruned_read(spark):
    seg = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (3, 1, "c")], "user_id long, cluster int, action string")
    out = tempfile.mkdtemp(prefix="sj-out-", dir="/tmp") + "/actions"
    write_by_cluster(seg, out, fmt="parquet")
    assert sorted(x for x in os.listdir(out) if x.startswith("cluster=")) == ["cluster=0", "cluster=1"]
    back = spark.read.parquet(out).where(F.col("cluster") == 1)
    assert "PartitionFilters: [isnotnull(cluster" in back._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.user_id for r in back.collect()) == [2, 3]
    one = export_cluster(seg, 1, columns=["user_id", "action"])
    assert one.columns == ["user_id", "action"] and one.count() == 2
    write_stage(one, out + "_csv", fmt="csv")
    assert spark.read.option("header", True).csv(out + "_csv").count() == 2


def test_profile_and_model_roundtrip(spark):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    p = profile(df)
    assert p["rows"] == 2 and p["columns"] == ["a", "b"] and len(p["sample"]) == 2
    m = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(df)
    path = tempfile.mkdtemp(prefix="sj-model-", dir="/tmp") + "/m"
    save_model(m, path)
    assert PipelineModel.load(path).transform(df).count() == 2


def test_csv_integers_written_as_floats(spark, tmp_path):
    from sparkjourney.sources.readers import clickstream_to_events, read_clickstream_csv
    from sparkjourney import schema as S
    names = [f.name for f in S.CLICKSTREAM_CSV_SCHEMA.fields]
    row = {"UserID": "7.0", "Year": "2024.0", "Month": "1.0", "Day": "2.0", "Timestamp": "10:20.5", "EventType": "click", "ProductID": "p", "Amount": "1"}
    half = row | {"Year": "2024.5"}
    lines = [",".join(names)] + [",".join(r.get(n, "") for n in names) for r in (row, half)]
    (tmp_path / "c.csv").write_text("\n".join(lines))
    got = clickstream_to_events(read_clickstream_csv(spark, str(tmp_path / "c.csv"))).collect()
    assert len(got) == 1 and got[0][S.USER] == 7


def _odd_csv(folder, files):
    """200 rows over some files, of which every tenth is bad in one of five ways; some rows twice."""
    head = "UserID,SessionID,Timestamp,EventType,ProductID,Amount,Outcome,Year,Month,Day"
    good = [f"{i % 9},1,0{i % 6}:07.5,click,p{i % 4},{i}.5,,2024,1,{1 + i % 28}" for i in range(180)] + ["5,1,01:07.5,login,,,,2024,1,2"] * 3
    bad = ["1,1,01:00.0", "1,2,3,4,5,6,7,8,9,10,11,12", "x,1,01:00.0,click,p,1,,2024,1,2", ",1,01:00.0,click,p,1,,2024,1,2", "1,1,77:00.0,click,p,1,,2024,1,2",
           "1,1,01:00.0,click,p,abc,,2024,1,2", "1,1,01:00.0,click,p,1,,2024,13,2"]
    lines = good + bad
    for k in range(files):
        (folder / f"part{k}.csv").write_text("\n".join([head, *lines[k::files]]) + "\n")
    return len(good), len(bad)


def test_every_row_is_an_event_or_in_quarantine(spark, tmp_path):
    from sparkjourney.sources import quarantine_counts, read_clickstream_checked
    n_good, n_bad = _odd_csv(tmp_path, 3)
    events, aside = read_clickstream_checked(spark, str(tmp_path))
    assert events.count() == n_good and aside.count() == n_bad
    assert {r.reason: r.rows for r in quarantine_counts(aside).collect()} == {"malformed row": 2, "unparseable value": 2, "no user": 1, "no time": 2}
    assert {r.line for r in aside.where("reason = 'malformed row'").collect()} == {"1,1,01:00.0", "1,2,3,4,5,6,7,8,9,10,11,12"}
    assert [r.Amount for r in aside.where("Amount = 'abc'").collect()] == ["abc"]


def test_event_ids_do_not_depend_on_the_files(spark, tmp_path):
    from sparkjourney.sources import read_clickstream_checked
    ids = []
    for files in (1, 4):
        folder = tmp_path / str(files)
        folder.mkdir()
        _odd_csv(folder, files)
        rows = read_clickstream_checked(spark, str(folder))[0].repartition(files).collect()
        assert len({r.event_id for r in rows}) == len(rows)
        ids.append(sorted(map(str, rows)))
    assert ids[0] == ids[1]
