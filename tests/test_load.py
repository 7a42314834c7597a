"""Upserts, child lists and versions."""

from pyspark.sql import functions as F

from curio import schemas
from curio.operators import collections, derive, load, serve


def record(url, title="t", artists=("A",), image="i", key="k"):
    return (key, 0, "aic", "1", url, image, title, None, None, None, None, None, None, None, None, None, None, None, None, [(n, None, None, None, None, None, None, None) for n in artists], 0)


def records(spark, *rows):
    schema = f"key string, item int, {schemas.RECORD.simpleString()[7:-1]}, source_order int"
    return spark.createDataFrame(list(rows), schema)


def test_replay_changes_nothing(spark):
    images, artists = schemas.empty(spark, "images"), schemas.empty(spark, "image_artists")
    first = records(spark, record("b", key="1"), record("a", artists=("A", "B", "C"), key="2"), record("b", title="last", key="3"))
    one = load.upsert_images(images, first, F.lit("t1")).cache()
    got = {r["source_url"]: r for r in one.collect()}
    assert (got["b"]["id"], got["b"]["title"], got["a"]["id"], got["a"]["result"]) == (1, "last", 2, "inserted")
    images = one.drop("result")
    touched, rows = load.child_rows(first, images)
    kids = load.sync_artists(artists, touched, rows).cache()
    assert kids.count() == 4 and {r["result"] for r in kids.collect()} == {"inserted"}
    artists = kids.drop("result").withColumn("role_bucket", F.lit("x"))
    again = load.upsert_images(images, first, F.lit("t2"))
    assert [(r["result"], r["updated_at"]) for r in again.collect()] == [("unchanged", "t1")] * 2
    touched, rows = load.child_rows(first, images)
    same = load.sync_artists(artists, touched, rows)
    assert {r["result"] for r in same.collect()} == {"unchanged"} and sorted(r["id"] for r in same.collect()) == [1, 2, 3, 4]
    # a null, a shorter list, a renamed first, a new item; the other image is not in the run
    second = records(spark, record("a", title=None, artists=("Z",)), record("c", artists=()))
    next_ = {r["source_url"]: r for r in load.upsert_images(images, second, F.lit("t3")).collect()}
    assert (next_["a"]["result"], next_["a"]["id"], next_["a"]["first_seen_at"], next_["a"]["updated_at"], next_["a"]["title"]) == ("updated", 2, "t1", "t3", None)
    assert (next_["c"]["id"], next_["b"]["result"], next_["b"]["updated_at"]) == (3, None, "t1")
    now = load.upsert_images(images, second, F.lit("t3")).drop("result")
    touched, rows = load.child_rows(second, now)
    kids = {(r["image_id"], r["position"]): r for r in load.sync_artists(artists, touched, rows).collect()}
    assert set(kids) == {(1, 0), (2, 0)} and (kids[2, 0]["name_raw"], kids[2, 0]["role_bucket"], kids[2, 0]["result"], kids[1, 0]["result"]) == ("Z", "x", "updated", None)
    assert schemas.faults({"images": now, "image_artists": artists}).count() == 0


def test_versions(spark, tmp_path):
    store = load.Store(spark, str(tmp_path))
    assert store.read("collections").count() == 0
    df = spark.createDataFrame([(1, "t", None, None, "1", None)], schemas.COLLECTIONS)
    assert store.write("collections", df) == 1 and store.write("collections", store.read("collections").unionByName(df)) == 2
    assert store.read("collections").count() == 2


def test_ids_of_wide_rows(spark):
    """Rows with a wide payload are dealt and merged otherwise than their keys alone: none may be lost."""
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2MB", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        wide = spark.range(300_000).select((F.col("id") * 7919 % 300_000).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("_part"), F.lit(1).alias("_seq"))
        got = load.allocate_ids(wide, ["k"])
        assert got.columns == ["k", "_part", "_seq", "id"]
        assert tuple(got.agg(F.count("*"), F.min("id"), F.max("id"), F.count_distinct("id"), F.sum((F.col("id") != F.col("k") + 1).cast("int"))).first()) == (300_000, 1, 300_000, 300_000, 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert load.allocate_ids(wide.limit(0), ["k"]).count() == 0


def test_second_writer_of_a_version_fails(spark, tmp_path):
    import pytest

    store = load.Store(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "t", None, None, "1", None)], schemas.COLLECTIONS)
    before = store.snapshot()
    store.write("collections", df, after=before)
    with pytest.raises(Exception, match="EXISTS"):
        store.write("collections", df.limit(0), after=before)
    assert store.version() == 1 and store.read("collections").count() == 1


def test_last_translation_wins(spark):
    images = spark.createDataFrame([(1, "u", "t")], "id long, source_url string, title string")
    csv = spark.createDataFrame([("u", "b", None, "m", 1), ("u", "a", None, "m", 2)], "source_url string, text string, confidence string, method string, order long")
    done = derive.apply_titles(schemas.empty(spark, "image_translations"), images, csv, "ja", F.lit("t"))
    assert [r["text"] for r in done.collect()] == ["a"]
    again = derive.apply_titles(done, images, csv.drop("order"), "ja", F.lit("t"))
    assert [r["text"] for r in again.collect()] == ["b"]


def test_faults(spark):
    images = spark.createDataFrame([(1, "s", "u"), (1, None, "u")], "id long, source string, source_url string").withColumns({"first_seen_at": F.lit("t"), "updated_at": F.lit("t")})
    dates = spark.createDataFrame([(1, "exact"), (9, "about")], "image_id long, date_precision string")
    got = {(r["table"], r["rule"]): r["n"] for r in schemas.faults({"images": images, "image_dates": dates}).collect()}
    assert got == {("images", "unique id"): 1, ("images", "unique source_url"): 1, ("images", "not null source"): 1, ("image_dates", "date_precision"): 1, ("image_dates", "orphans image_id"): 1}


def test_pick_is_repeatable_and_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(serve, "RANGE_ROWS", 4)
    df = spark.range(10).select(((F.col("id") * 7) % 10 + 100).alias("id"), F.col("id").alias("n")).repartition(3)
    serve.write_ranks(df, f"{tmp_path}/r")
    picks = [serve.pick(spark, f"{tmp_path}/r", b).first() for b in range(24)]
    assert picks == [serve.pick(spark, f"{tmp_path}/r", b).first() for b in range(24)] and len({p["id"] for p in picks}) > 6
    assert [p["id"] for p in picks] == [100 + serve.place_of(b, 10) for b in range(24)] and {p["n"] for p in picks} <= set(range(10))
    plan = serve.pick(spark, f"{tmp_path}/r", 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan and "Exchange" not in plan
    serve.write_ranks(df.limit(0), f"{tmp_path}/none")
    assert serve.pick(spark, f"{tmp_path}/none", 1).count() == 0


def test_many_patterns_equal_one_by_one(spark, monkeypatch):
    import random

    rng = random.Random(4)
    names = ["".join(rng.choice("abCé%_\\1 ") for _ in range(rng.randrange(0, 14))) for _ in range(200)] + [None, "", "ab"]
    images = spark.createDataFrame(list(enumerate(names)), "id long, artist string")
    patterns = {k: ["".join(rng.choice("abcé%_\\1 ") for _ in range(rng.randrange(1, 7))) for _ in range(20)] for k in range(3)}
    many = sorted(map(tuple, collections.members(images, patterns).collect()))
    monkeypatch.setattr(collections, "MANY", 1000)
    assert many == sorted(map(tuple, collections.members(images, patterns).collect())) and len(many) == len(set(many)) > 100


def test_collections_need_their_image(spark):
    import pytest

    images = spark.createDataFrame([(1, "Numazu", "Kano X"), (2, "n", "other")], "id long, title string, artist string")
    table, members = collections.build(images, [{"id": 5, "title": "c", "index_art": "NUMAZU", "artists": ["kano ", "KANO"]}])
    assert table.first()["index_image_id"] == "1" and [tuple(r) for r in members.collect()] == [(5, 1)]
    with pytest.raises(ValueError, match="no image"):
        collections.build(images, [{"id": 5, "title": "c", "index_art": "zzz", "artists": []}])


def test_protected_names(spark):
    artists = spark.createDataFrame([(1, "A", "甲"), (2, "A", None), (3, "B", None)], "id long, name_raw string, name_original_language string")
    names = derive.put_seed(schemas.empty(spark, "image_artist_names"), artists, "ja", F.lit("t"))
    csv = spark.createDataFrame([("A", "エー", None, "llm")], "name_raw string, name string, confidence string, method string")
    names = derive.apply_names(names, artists, csv, "ja", F.lit("t"))
    assert {r["id"]: r["display_name"] for r in derive.display_names(artists, names, "ja").collect()} == {1: "甲", 2: "エー", 3: "B"}
