from datetime import datetime

import pytest

from vecshelf.operators import ratings as state
from vecshelf.streaming.ratings import rejected, snapshot, stream_ratings

CHANGES = "event_id long, ts timestamp, user long, work_key long, rating int"


def at(second):
    return datetime(2024, 1, 1, 0, 0, second)


LOG = [
    (1, at(1), 1, 10, 2),
    (2, at(5), 1, 10, -1),      # re-rated
    (3, at(2), 1, 11, 1),
    (4, at(3), 1, 11, None),    # deleted
    (5, at(4), 1, 11, 2),       # rated again
    (6, at(6), 2, 10, 1),
    (7, at(6), 2, 10, -2),      # same time, later id
    (8, at(7), 3, 10, 1),
    (9, at(8), 3, 10, None),    # only a tombstone is left
    (10, at(2), 1, 10, 1),      # late row
]

FOLDED = {(1, 10): -1, (1, 11): 2, (2, 10): -2}


def folded(df):
    return {(r.user, r.work_key): r.rating for r in df.collect()}


def test_fold_is_independent_of_order_and_replay(spark):
    assert folded(state.fold_ratings(spark.createDataFrame(LOG, CHANGES))) == FOLDED
    replayed = spark.createDataFrame(LOG[::-1] + LOG[:6], CHANGES).repartition(3)
    assert folded(state.fold_ratings(replayed)) == FOLDED


def test_fold_with_one_hot_pair(spark):
    rows = [(i, at(0), 1, 10, 1 if i < 4999 else -2) for i in range(5000)] + LOG[5:7]
    got = folded(state.fold_ratings(spark.createDataFrame(rows, CHANGES).repartition(4)))
    assert got == {(1, 10): -2, (2, 10): -2}


def test_validation(spark):
    catalog = spark.createDataFrame([(10, "t10"), (11, "t11")], "work_key long, input_text string")
    rows = LOG[:2] + [(20, at(1), 1, 10, 0), (21, at(1), 1, 10, 3), (22, at(1), 1, 99, 1), (23, at(1), 1, 10, None)]
    accepted, rejected = state.validate_ratings(spark.createDataFrame(rows, CHANGES), catalog)
    assert sorted(r.event_id for r in accepted.collect()) == [1, 2, 23]
    assert {r.event_id: r.reason for r in rejected.collect()} == {
        20: "bad_rating", 21: "bad_rating", 22: "unknown_work",
    }
    kept = state.fold_ratings(accepted.where("event_id < 20")).first()
    assert (kept.input_text, kept.updated_at) == ("t10", at(5))


def test_deletes_and_works_without_a_title(spark):
    # 99 is no longer listed, 12 is listed without a text
    catalog = spark.createDataFrame([(10, "t10"), (12, None)], "work_key long, input_text string")
    rows = [(1, at(1), 1, 99, None), (2, at(1), 1, 12, 2), (3, at(1), 1, 99, 2), (4, at(1), 1, 98, 9)]
    accepted, refused = state.validate_ratings(spark.createDataFrame(rows, CHANGES), catalog)
    assert sorted(r.event_id for r in accepted.collect()) == [1, 2]
    assert {r.event_id: r.reason for r in refused.collect()} == {3: "unknown_work", 4: "bad_rating"}
    before = spark.createDataFrame([(0, at(0), 1, 99, 2, "gone")], CHANGES + ", input_text string")
    assert folded(state.fold_ratings(before.unionByName(accepted))) == {(1, 12): 2}


def test_users_and_listing(spark):
    changes = spark.createDataFrame(LOG, CHANGES)
    assert {r.user: r.created_at for r in state.derive_users(changes).collect()} == {1: at(1), 2: at(6), 3: at(7)}
    catalog = spark.createDataFrame(
        [(10, "a", "t", 1990)], "work_key long, author string, title string, year long"
    )
    listed = state.list_ratings(state.fold_ratings(changes), catalog).collect()
    assert [(r.user, r.work_key, r.title) for r in listed] == [(1, 10, "t"), (1, 11, None), (2, 10, "t")]
    results = spark.createDataFrame([(1, 11), (2, 99)], "user long, work_key long")
    overlay = state.overlay_ratings(results, state.fold_ratings(changes))
    assert {r.work_key: r.rating for r in overlay.collect()} == {11: 2, 99: None}


@pytest.mark.parametrize("restart", [False, True])
def test_stream_equals_fold(spark, tmp_path, restart):
    source, log, checkpoint = (str(tmp_path / d) for d in ("source", "log", "checkpoint"))
    halves = [LOG[::2] + [(30, at(9), 1, 10, 7), (31, at(9), 1, 77, 2)], LOG[1::2]]
    catalog = spark.createDataFrame([(10, "t10"), (11, "t11")], "work_key long, input_text string")

    def run():
        stream = spark.readStream.schema(CHANGES).parquet(source)
        stream_ratings(stream, catalog, log, checkpoint).awaitTermination()

    for half in halves:
        spark.createDataFrame(half, CHANGES).coalesce(1).write.mode("append").parquet(source)
        if restart:
            run()
    run()
    assert folded(snapshot(spark, log)) == FOLDED
    assert {r.event_id: r.reason for r in rejected(spark, log).collect()} == {30: "bad_rating", 31: "unknown_work"}
