import json
import random
from datetime import datetime, timedelta

import pytest

from gleanwell.sources import records
from gleanwell.streaming import rate_limit


def model(events, limit, seconds):
    out, recent = {}, {}
    for client, t, key in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        r = [x for x in recent.get(client, []) if (t - x).total_seconds() <= seconds]
        out[key] = len(r) < limit
        recent[client] = [*r, t] if out[key] else r
    return out


@pytest.fixture(scope="module")
def events():
    rng = random.Random(4)
    t, out = datetime(2024, 1, 1), []
    for i in range(400):
        t += timedelta(seconds=rng.choice([0, 1, 5, 20, 200]))
        out.append((1 if rng.random() < 0.5 else rng.randint(2, 5), t, i))
    return out


def test_limits_a_table_like_a_loop(spark, events):
    df = spark.createDataFrame([*events, (None, events[0][1], 900), (1, None, 901)], "client bigint, ts timestamp, id bigint")
    got = {r["id"]: r["allowed"] for r in rate_limit.limited(df, "client", "ts", "id", 3, 30).collect()}
    assert got == model(events, 3, 30) and not all(got.values())


def test_a_stretch_is_never_gathered(spark, events):
    df = spark.createDataFrame(events, "client bigint, ts timestamp, id bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = rate_limit.limited(df, "client", "ts", "id", 3, 30)
        got = {r["id"]: r["allowed"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == model(events, 3, 30) and out.columns == ["client", "ts", "id", "allowed"]
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_limits_a_stream_like_a_loop(spark, events, tmp_path):
    schema = "client bigint, ts timestamp, id bigint"
    for i, part in enumerate((events[:200], events[200:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = rate_limit.limited_stream(stream, "client", "ts", "id", 3, 30).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = {r["key"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == model(events, 3, 30)


def test_silent_clients_keep_no_state(spark, tmp_path):
    schema, day = "client bigint, ts timestamp, id bigint", datetime(2024, 1, 1)
    parts = [[(1, day, 0), (2, day, 1)], [(1, day + timedelta(hours=5), 2)], [(1, day + timedelta(hours=9), 3)], [(2, day + timedelta(hours=9, seconds=1), 4)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = rate_limit.limited_stream(stream, "client", "ts", "id", 3, 30).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) == 2 and 1 in kept[1:]  # client 2 was forgotten, and let through anew
    assert {r["key"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == dict.fromkeys(range(5), True)


def test_json_records(spark, tmp_path):
    ev = {"title": "t", "author": None, "url": "u", "source": "s", "category": "c", "published_at": "2024", "fact": "f"}
    good = {"query": "q", "answer": "a", "question_type": "null_query", "evidence_list": []}
    (tmp_path / "qa.json").write_text(json.dumps([good, good | {"question_type": "odd"}, good | {"query": ""}, good | {"evidence_list": [ev | {"fact": None}]}]))
    df = records.read_questions(spark, str(tmp_path / "qa.json"))
    assert df.count() == 4 and sorted(r["reason"] for r in records.invalid_questions(df).collect()) == ["evidence", "query", "question_type"]
    assert records.missing_columns(df.drop("answer"), records.QA_DDL) == ["answer"]
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):  # noqa: B017
        records.read_questions(spark, str(tmp_path / "bad.json")).collect()
    assert records.file_hashes(spark, str(tmp_path / "qa.json")).first()["length"] > 10
    (tmp_path / "c.json").write_text(json.dumps([{"title": "t", "body": "b", "url": "u"}]))
    assert records.read_corpus(spark, str(tmp_path / "c.json")).first()["author"] is None


def test_appending_takes_up_again(spark, tmp_path):
    todo, path = spark.range(10).withColumnRenamed("id", "k"), str(tmp_path / "done")
    assert records.append_remaining(todo.filter("k < 4"), path, "k") == 4
    assert records.append_remaining(todo, path, "k") == 6 and records.append_remaining(todo, path, "k") == 0
