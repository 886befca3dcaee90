import json

import pytest

from opinara.functions.numbers import half_even
from opinara.operators import extract, merge
from opinara.schemas import RAW_PLACES, REVIEW_COLUMNS
from opinara.sources import readers, writers
from pyspark.sql import functions as F

PLACES = [
    {"title": "A", "place_id": "p1", "review_rating": 4.5, "category": "cafe", "address": "x",
     "user_reviews": [
         {"Description": "Nice", "Rating": 0, "stars": 4, "Name": "Ann", "When": "today"},
         {"Description": "  \t", "text": "hidden"},
         {"Description": "", "text": "Second", "rating_float": 2.5, "name": "bob", "published_at": "then"}],
     "user_reviews_extended": [{"text": " nice "}, {"text_translated": "Third", "likes_count": 3, "photos_count": None}]},
    {"title": "B", "data_id": "d2", "user_reviews": None, "user_reviews_extended": [{"text": "Nice"}]},
    {"title": "C", "place_id": "p3", "user_reviews": [], "user_reviews_extended": None},
]


def test_dialects_fallbacks_and_dedupe(spark, tmp_path):
    path = tmp_path / "places.json"
    path.write_text("\n".join(json.dumps(p) for p in PLACES))
    places = readers.read_places(spark, str(path))
    rows = extract.extract_reviews(places, ["place_seq"]).collect()
    found = {(r.place_id, r.review_text): r for r in rows}
    assert set(found) == {("p1", "Nice"), ("p1", "Second"), ("p1", "Third"), ("d2", "Nice")}
    assert found["p1", "Nice"].review_rating == 4.0 and found["p1", "Nice"].reviewer_name == "Ann"
    assert found["p1", "Nice"].review_date == "today"
    second = found["p1", "Second"]
    assert (second.review_rating, second.reviewer_name, second.review_date) == (2.5, "bob", "then")
    third = found["p1", "Third"]
    assert (third.review_rating, third.review_likes, third.reviewer_photos, third.reviewer_name) == (0.0, 3, 0, "")
    assert rows[0].__fields__ == REVIEW_COLUMNS


def test_lines_arrays_and_pretty_arrays_in_one_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(PLACES))
    (tmp_path / "b.json").write_text("\n \n" + json.dumps(PLACES, indent=2))
    (tmp_path / "c.json").write_text("\n".join(json.dumps(p) for p in PLACES) + "\n\n")
    places = readers.read_places(spark, str(tmp_path))
    assert places.groupBy("title").count().collect() and {r["count"] for r in places.groupBy("title").count().collect()} == {3}
    assert places.drop("place_seq").schema == RAW_PLACES
    assert extract.explode_reviews(places, ["place_seq"]).count() == 3 * 5


def test_malformed_line_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(PLACES[0]) + "\n{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_places(spark, str(tmp_path)).collect()


def test_review_arrays_as_text_and_with_stray_elements(spark, tmp_path):
    odd = [{"title": "A", "place_id": "p1", "review_rating": "4.5", "user_reviews": json.dumps([1, {"text": "one"}, None, "x", [2]]),
            "user_reviews_extended": [3, {"text": "two", "likes_count": 2}, None]},
           {"title": "B", "place_id": "p2", "user_reviews": "{broken", "user_reviews_extended": [{"text": "three"}]}]
    path = tmp_path / "odd.json"
    path.write_text("\n".join(json.dumps(p) for p in odd))
    rows = extract.extract_reviews(readers.read_places(spark, str(path)), ["place_seq"]).collect()
    assert {(r.place_id, r.review_text) for r in rows} == {("p1", "one"), ("p1", "two"), ("p2", "three")}
    assert {r.place_rating for r in rows if r.place_id == "p1"} == {4.5}


def test_corrupt_batches_fail_or_are_named(spark, tmp_path):
    for n in (1, 2):
        spark.range(3).selectExpr("id", "'t' AS place_name").coalesce(1).write.parquet(str(tmp_path / f"batch_{n}_reviews.parquet"))
    broken = tmp_path / "batch_3_reviews.parquet"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("no parquet")
    glob = str(tmp_path / "batch_*_reviews.parquet")
    with pytest.raises(Exception):
        readers.read_batches(spark, glob).collect()
    assert readers.read_batches(spark, glob, skip_corrupt=True).count() == 6
    skipped = [r.path for r in readers.skipped_files(spark, glob).collect() if r.path.endswith("part-0.parquet")]
    assert len(skipped) == 1 and "batch_3" in skipped[0]


def test_query_list_strips_all_white_space(spark, tmp_path):
    (tmp_path / "q.txt").write_text("\tclinic a \n\t\n#x\n  b\u00a0\n")
    rows = readers.read_queries(spark, str(tmp_path / "q.txt")).orderBy("position").collect()
    assert [r["query"] for r in rows] == ["clinic a", "b"]


def test_arrays_as_json_text(spark):
    df = spark.createDataFrame(
        [(1, "A", json.dumps([{"text": "one"}, {"text": "two"}])), (2, "B", "{broken"), (3, "C", None)],
        "place_seq long, title string, user_reviews string",
    )
    rows = extract.extract_reviews(df, ["place_seq"]).collect()
    assert sorted(r.review_text for r in rows) == ["one", "two"]
    assert {r.place_id for r in rows} == {""}


def test_flatten_one_level(spark):
    df = spark.createDataFrame([(1, ((5, "x"),))], "a int, s struct<t:struct<u:int,v:string>>")
    assert extract.flatten_struct(df).columns == ["a", "s.t"]


def test_two_dedupe_keys(spark):
    long = "x" * 100
    rows = [(1, "p", long + "a"), (2, "p", long + "b"), (3, "p", " Hello"), (4, "p", "hello "), (5, "p", "hello "), (6, "q", "hello "), (7, "p", None), (8, "p", " \n")]
    df = spark.createDataFrame(rows, "review_id long, place_id string, review_text string")
    by_prefix = extract.dedupe_by_prefix(df.filter("review_id <= 6"), ["review_id"])
    assert sorted(r.review_id for r in by_prefix.collect()) == [1, 3, 6]
    merged = merge.merge_reviews(df, ["review_id"])
    assert sorted(r.review_id for r in merged.collect()) == [1, 2, 3, 4, 6, 7]
    again = merge.merge_reviews(merged, ["review_id"])
    assert again.count() == merged.count()


def test_batches_with_different_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, x string").write.parquet(str(tmp_path / "batch_0002_reviews.parquet"))
    spark.createDataFrame([(2,)], "id long").write.parquet(str(tmp_path / "batch_0001_reviews.parquet"))
    rows = readers.read_batches(spark, str(tmp_path / "batch_*_reviews.parquet")).collect()
    assert {(r.id, r.x, r.batch) for r in rows} == {(1, "a", 2), (2, None, 1)}


def test_query_lines(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# head\n\n one \n   \ntwo # kept\n #kept too\n")
    assert [r.query for r in readers.read_queries(spark, str(tmp_path / "q.txt")).orderBy("position").collect()] == [
        "one", "two # kept", "#kept too"]


def test_csv_has_a_header_and_no_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 'say "hi"')], "id long, w array<string>, t string")
    writers.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()
    assert back.asDict() == {"id": "1", "w": '["a","b"]', "t": 'say "hi"'}


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,), (-0.04,), (66.665,)], "x double")
    got = [str(r.v) for r in df.select(half_even(F.col("x"), 1).alias("v")).collect()]
    assert got == ["0.2", "0.4", "2.5", "0.0", "66.7"]


def test_places_of_a_named_form(spark, tmp_path):
    from opinara.sources import readers

    (tmp_path / "lines").mkdir()
    (tmp_path / "arrays").mkdir()
    (tmp_path / "lines" / "a.json").write_text('{"title": "x", "review_count": 3}\n{"title": "y", "user_reviews": [{"text": "t"}]}\n')
    (tmp_path / "arrays" / "b.json").write_text('[\n {"title": "x",\n  "review_count": 3},\n {"title": "y", "user_reviews": [{"text": "t"}]}]\n')
    columns = ("title", "review_count", "user_reviews")
    for form in ("lines", "arrays"):
        named = readers.read_places(spark, str(tmp_path / form), form).select(*columns)
        found = readers.read_places(spark, str(tmp_path / form)).select(*columns)
        rows = sorted(map(tuple, named.collect()))
        assert rows == sorted(map(tuple, found.collect()))
        assert [row[:2] for row in rows] == [("x", 3), ("y", None)] and "t" in rows[1][2]
    with pytest.raises(ValueError, match="unknown form"):
        readers.read_places(spark, str(tmp_path), "csv")
