import json
import random

import pytest
from opinara.operators import collection, extract, merge
from opinara.sources import manifest, readers, writers
from opinara.streaming import attempts, history, ingest
from pyspark.sql import functions as F


def place(identifier, *texts):
    return {"title": identifier, "place_id": identifier, "user_reviews": [{"text": t} for t in texts]}


def land(folder, name, *places):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(p) for p in places))


def run_merge(spark, tmp_path, checkpoint):
    stream = ingest.extract_stream(ingest.place_stream(spark, str(tmp_path / "landing"), files_per_batch=1))
    query = ingest.start_merge(stream, str(tmp_path / "history"), str(tmp_path / checkpoint), ["pos"])
    query.awaitTermination()
    return {(r.place_id, r.review_text) for r in history.read_history(spark, str(tmp_path / "history")).collect()}


def test_micro_batches_equal_one_batch_and_replay_adds_nothing(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "1.json", place("a", "one", "two", "one"), place("b", "one"))
    land(landing, "2.json", place("a", "two", "three"), place("c", "x", "  "))
    land(landing, "3.json", place("b", "one", "four"), place("a", "one"))
    streamed = run_merge(spark, tmp_path, "checkpoint")
    whole = readers.read_places(spark, str(landing))
    batch = merge.merge_reviews(extract.explode_reviews(whole, ["place_seq"]), ["place_seq", "pos"])
    assert streamed == {(r.place_id, r.review_text) for r in batch.collect()}
    count = history.read_history(spark, str(tmp_path / "history")).count()
    assert count == len(streamed)
    # A lost checkpoint replays everything; new files are still picked up by the old one.
    assert run_merge(spark, tmp_path, "other") == streamed
    assert history.read_history(spark, str(tmp_path / "history")).count() == count
    land(landing, "4.json", place("a", "five", "one"))
    assert run_merge(spark, tmp_path, "checkpoint") == streamed | {("a", "five")}


def test_extract_and_status_streams(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "1.json", place("a", "one", "two"))
    land(landing, "2.json", place("b", "one"))
    places = ingest.place_stream(spark, str(landing), files_per_batch=1)
    ingest.start_extract(places, str(tmp_path / "reviews"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "reviews")).count() == 3
    stream = ingest.extract_stream(places).withColumn("batch", F.lit(1))
    ingest.start_status(stream, str(tmp_path / "status"), str(tmp_path / "c2")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "status")).collect()
    assert sorted((r.epoch, r.places, r.reviews) for r in rows) == [(0, 1, 2), (1, 1, 1)]


def test_running_totals_in_update_mode(spark, tmp_path):
    land(tmp_path / "landing", "1.json", place("a", "one", "two"))
    stream = ingest.extract_stream(ingest.place_stream(spark, str(tmp_path / "landing"))).withColumn("batch", F.lit(1))
    query = (
        ingest.running_batch_totals(stream).writeStream.format("memory").queryName("totals").outputMode("update")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("totals").first().reviews == 2


def test_latest_run_and_first_existing(spark, tmp_path):
    df = spark.range(3)
    writers.write_run(df, str(tmp_path / "runs"), "zz-old")
    writers.write_run(df.limit(1), str(tmp_path / "runs"), "aa-new")
    assert [r.run_id for r in readers.read_latest(spark, str(tmp_path / "runs")).collect()] == ["aa-new"]
    # Only the newest run's files are known to the scan, and its rows were counted as they were written.
    latest = readers.read_latest(spark, str(tmp_path / "runs"))
    assert all("run_id=aa-new" in f for f in latest.inputFiles())
    listed = {r.name: r for r in manifest.entries(spark, str(tmp_path / "runs")).collect()}
    assert {n: r.rows for n, r in listed.items()} == {"zz-old": 3, "aa-new": 1}
    # An entry that was never published, and files of a write that failed, do not count.
    spark.range(9).write.parquet(str(tmp_path / "runs" / "run_id=aa-new" / "more"))
    spark.range(9).write.mode("append").parquet(str(tmp_path / "runs" / "run_id=zz-old"))
    assert readers.read_latest(spark, str(tmp_path / "runs")).count() == 1
    writers.write_run(df, str(tmp_path / "runs"), "zz-old")
    assert readers.read_latest(spark, str(tmp_path / "runs")).count() == 6
    df.withColumn("run_id", F.lit("x")).write.partitionBy("run_id").parquet(str(tmp_path / "plain"))
    assert readers.read_latest(spark, str(tmp_path / "plain")).count() == 3
    assert readers.first_existing(spark, str(tmp_path / "none"), str(tmp_path / "runs")) == str(tmp_path / "runs")
    assert readers.first_existing(spark, str(tmp_path / "none")) is None


def test_batches_by_their_manifest(spark, tmp_path):
    folder = str(tmp_path / "batches")
    writers.write_batch(spark.createDataFrame([(1, "a")], "id long, t string"), folder, 1)
    writers.write_batch(spark.createDataFrame([(2, 0.5)], "id long, score double"), folder, 2)
    rows = sorted((r.batch, r.id, r.t, r.score) for r in readers.read_listed_batches(spark, folder).collect())
    assert rows == [(1, 1, "a", None), (2, 2, None, 0.5)]
    writers.write_batch(spark.createDataFrame([], "id long, t string"), folder, 3)
    assert readers.read_listed_batches(spark, folder).count() == 2
    writers.write_batch(spark.createDataFrame([("x",)], "id string"), folder, 4)
    with pytest.raises(ValueError, match="id is bigint and string"):
        readers.read_listed_batches(spark, folder)
    with pytest.raises(FileNotFoundError):
        readers.read_listed_batches(spark, str(tmp_path / "none"))


def test_pending_and_new_queries(spark):
    listed = spark.createDataFrame([(q,) for q in "abcdefg"], "query string")
    status = spark.createDataFrame(
        [("a", "completed", 0), ("b", "failed", 1), ("c", "failed", 3), ("d", "failed", 1), ("d", "completed", 0),
         ("e", "pending", 0), ("z", "failed", 2), ("f", "failed", None)],
        "query string, status string, attempts int",
    )
    rows = {r.query: r.reason for r in collection.pending_queries(listed, status).collect()}
    assert rows == {"b": "retry", "e": "new", "z": "retry", "f": "retry", "g": "new"}
    assert [r.query for r in collection.new_queries(listed, status).collect()] == ["g"]


def test_query_generation(spark):
    areas = spark.createDataFrame([("X",), ("Y",), ("X",)], "area string")
    assert {r.query for r in collection.area_queries(areas, ["k", "m"]).collect()} == {"k in X", "m in X", "k in Y", "m in Y"}
    niches = {"one": ["k"], "two": ["k", "m"]}
    assert collection.expansion_queries(areas, niches).count() == 4
    centres = spark.createDataFrame([("1.5,2.5",)], "centre string")
    assert collection.max_coverage_queries(areas, ["k"], centres, "clinic").count() == 3
    box = spark.createDataFrame([("c", 1.0, 2.0, 1.04, 2.01), ("c", 5.0, 5.0, 4.0, 5.0)],
                                "keyword string, min_lat double, min_lon double, max_lat double, max_lon double")
    points = collection.grid_points(box).collect()
    assert sorted(r.query for r in points) == ["c @1.00000,2.00000,14z", "c @1.02000,2.00000,14z", "c @1.04000,2.00000,14z"]


REVIEW = "review_id long, place_id string, review_text string"


def reviews_of(spark, places, texts, first=0):
    return spark.createDataFrame([(first + i, p, t) for i, (p, t) in enumerate((p, t) for p in places for t in texts)], REVIEW)


def test_a_batch_reads_as_much_of_a_large_history_as_of_a_small_one(spark, tmp_path):
    sink = str(tmp_path / "history")
    batch = reviews_of(spark, ["p1", "p2"], ["new", "old 0"])
    read, held = [], []
    for step in range(4):
        # The history grows fourfold at a time.
        more = reviews_of(spark, [f"p{i}" for i in range(4**step * 5)], [f"old {step}", f"older {step}"])
        history.merge_batch(more, sink, ["review_id"])
        history.compact(spark, sink, target_rows=10, force=True)
        generation = history.current(spark, sink)
        touched = [r.bucket for r in history.with_identity(batch, generation.depth).select("bucket").distinct().collect()]
        digests = history.held_digests(spark, generation, touched)
        read.append((len(digests.inputFiles()), digests.count()))
        held.append(history.read_history(spark, sink).count())
    assert held == [10, 50, 210, 850] and generation.depth == 7
    # Two places lie in two buckets at most, of one file and some ten reviews each, however long the history.
    assert all(files <= 2 and rows <= 60 for files, rows in read) and read[-1][1] < held[-1] / 10
    # The digests of a file ascend, so their least and greatest values prune.
    part = next((tmp_path / "history" / generation.path.rpartition("/")[2]).rglob("*.parquet"))
    values = [r.identity for r in spark.read.parquet(str(part)).collect()]
    assert values == sorted(values)


def test_merging_and_compacting_keeps_the_first_copy_and_replays_add_nothing(spark, tmp_path):
    sink = str(tmp_path / "history")
    rng = random.Random(3)
    expected, batches = {}, []
    for b in range(6):
        rows = [(b * 100 + i, rng.choice("abc"), rng.choice(["x", "y", "z", "u", f"t{b}", " ", None])) for i in range(30)]
        rng.shuffle(rows)
        batches.append(spark.createDataFrame(rows, REVIEW))
        for i, p, t in sorted(rows, key=lambda r: r[0]):
            if t != " ":
                expected.setdefault((p, t), i)
    for b, batch in enumerate([*batches, *batches[::-1]]):
        history.merge_batch(batch, sink, ["review_id"])
        if b % 2:
            history.compact(spark, sink, target_rows=4)
        if b == 3:
            # A rewrite that never came to its rename does not count.
            history.read_history(spark, sink).limit(2).write.parquet(f"{sink}/building-lost")
    got = history.read_history(spark, sink).collect()
    assert {(r.place_id, r.review_text): r.review_id for r in got} == expected and len(got) == len(expected)
    assert history.current(spark, sink).depth >= 2
    assert len([p for p in (tmp_path / "history").glob("generation=*")]) <= 2


def test_no_history(spark, tmp_path):
    sink = str(tmp_path / "none")
    assert history.current(spark, sink) is None and not history.compact(spark, sink)
    with pytest.raises(FileNotFoundError):
        history.read_history(spark, sink)
    history.merge_batch(reviews_of(spark, [], ["x"]), sink, ["review_id"])
    assert history.current(spark, sink) is None and not history.compact(spark, sink)


def plain_state(events, every_failure=False):
    """The collector's state after a list of events, one at a time."""
    completed, failed = {}, {}
    for seq, query, outcome, batch, places, reviews, error in events:
        if outcome == "reset":
            completed, failed = {}, {}
        elif outcome == "completed":
            completed[query] = (batch, places, reviews)
            failed.pop(query, None)
        else:
            before = failed.get(query, {"attempts": 0, "error": None})
            if outcome == "error":
                failed[query] = {"attempts": before["attempts"] + 1 if every_failure else 1, "error": error}
            else:
                failed[query] = before | {"attempts": before["attempts"] + 1}
    state = {q: ("failed", f["attempts"], f["error"], None, None, None) for q, f in failed.items()}
    return state | {q: ("completed", None, None, *c) for q, c in completed.items()}


def test_folded_attempts_equal_a_plain_state(spark):
    rng = random.Random(5)
    for trial in range(4):
        events = [(i, f"q{rng.randrange(12)}", rng.choices(["error", "empty", "completed", "reset"], [4, 4, 2, 0.1])[0],
                   i % 9, i % 5, i % 7, f"error {i}") for i in range(150 if trial else 0)]
        events = [(*e[:6], e[6] if e[2] == "error" else None) for e in events]
        df = spark.createDataFrame(events, "seq long, query string, outcome string, batch int, places long, reviews long, error string")
        for every in (False, True):
            got = {r.query: tuple(r)[1:] for r in attempts.fold_attempts(df.repartition(3), every).collect()}
            assert got == plain_state(events, every)


def test_attempt_log_survives_replay_and_reset(spark, tmp_path):
    log = str(tmp_path / "log")

    def state():
        return {r.query: (r.status, r.attempts, r.error) for r in attempts.fold_attempts(attempts.read_attempts(spark, log)).collect()}

    attempts.record_attempt(spark, log, "a", 0, ["x", "y"], "error", error="No results returned")
    attempts.record_attempt(spark, log, "b", 1, ["x"], "empty", places=2)
    for _ in range(2):  # replayed
        attempts.record_attempt(spark, log, "c", 2, ["y"], "completed", batch=2, places=3, reviews=40)
    assert state() == {"x": ("failed", 2, "No results returned"), "y": ("completed", None, None)}
    listed = spark.createDataFrame([("x",), ("y",), ("z",)], "query string")
    folded = attempts.fold_attempts(attempts.read_attempts(spark, log))
    assert {r.query: r.reason for r in collection.pending_queries(listed, folded).collect()} == {"x": "retry", "z": "new"}
    attempts.record_attempt(spark, log, "d", 3, ["x"], "empty")
    folded = attempts.fold_attempts(attempts.read_attempts(spark, log))
    assert {r.query for r in collection.pending_queries(listed, folded).collect()} == {"z"}
    attempts.record_reset(spark, log, "e", 4)
    assert state() == {}
    assert attempts.totals(attempts.read_attempts(spark, log)).first() == (3, 40)
    with pytest.raises(ValueError):
        attempts.record_attempt(spark, log, "f", 5, ["x"], "lost")


def test_one_ingest_from_places_to_history_and_state(spark, tmp_path, monkeypatch):
    landing, sink, log = tmp_path / "landing", str(tmp_path / "history"), str(tmp_path / "log")

    def ingest_all(run="r1"):
        places = ingest.place_stream(spark, str(landing), files_per_batch=1)
        query = ingest.start_ingest(places, sink, log, str(tmp_path / run), run, ["cafes"], target_rows=2, compact_every=2)
        query.awaitTermination()

    land(landing, "1.json", place("a", "one", "two", "ONE "), place("b", "one"))
    ingest_all()
    # A merge that succeeds, a record that does not: the replay adds no review and one record.
    land(landing, "2.json", place("a", "two", "three"))
    with monkeypatch.context() as broken, pytest.raises(Exception, match="disk is full"):
        broken.setattr(attempts, "record_attempt", lambda *a, **k: (_ for _ in ()).throw(OSError("disk is full")))
        ingest_all()
    held = history.read_history(spark, sink).count()
    assert held == 4
    ingest_all()
    assert history.read_history(spark, sink).count() == held
    # Late and repeated deliveries, a delivery without reviews.
    land(landing, "3.json", place("b", "one"), place("a", "one", "two"))
    land(landing, "4.json", place("c"))
    ingest_all()
    got = {(r.place_id, r.review_text) for r in history.read_history(spark, sink).collect()}
    assert got == {("a", "one"), ("a", "two"), ("a", "three"), ("b", "one")} and len(got) == history.read_history(spark, sink).count()
    records = sorted((r.seq, r.outcome, r.places, r.reviews) for r in attempts.read_attempts(spark, log).collect())
    assert [r[1:] for r in records] == [("completed", 2, 3), ("completed", 1, 2), ("completed", 2, 3), ("empty", 1, 0)]
    # A success stands, whatever comes after it.
    state = attempts.fold_attempts(attempts.read_attempts(spark, log)).first()
    assert (state.status, state.batch, state.reviews) == ("completed", records[2][0], 3)
    # A lost checkpoint under another run replays everything and adds nothing.
    ingest_all("r2")
    assert history.read_history(spark, sink).count() == held


def test_queries_are_distinct_without_comparing_them_all(spark):
    areas = spark.createDataFrame([("X",), ("X",), ("Y",), (None,), (None,)], "area string")
    centres = spark.createDataFrame([("1,2",), ("1,2",), (None,)], "centre string")
    made = collection.max_coverage_queries(areas, ["k", "m", "k"], centres, "clinic")
    assert sorted(str(r.query) for r in made.collect()) == [
        "None", "clinic @1,2,14z", "k", "k in X", "k in Y", "m", "m in X", "m in Y"]
    # Areas are compared, not queries: what is grouped lies below what multiplies.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate [area")
    # Keywords that begin like another's query, or like a geo-targeted one, still give each query once.
    clashing = spark.createDataFrame([("X",), ("b in X",)], "area string")
    assert sorted(r.query for r in collection.area_queries(clashing, ["a", "a in b"]).collect()) == [
        "a in X", "a in b in X", "a in b in b in X"]
    geo = spark.createDataFrame([("1 in Z",)], "centre string")
    same = spark.createDataFrame([("Z,14z",)], "area string")
    assert [r.query for r in collection.max_coverage_queries(same, ["clinic @1"], geo, "clinic").collect()] == ["clinic @1 in Z,14z"]
