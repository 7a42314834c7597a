"""Bucketed tables and versions of several tables: plans without a shuffle of the table, readers that see whole states."""

import re

import pytest
from pyspark.sql import functions as F

from curio import schemas
from curio.operators import load, store



def records(spark, *rows):
    """Common records (source_url, title, artists)."""
    blank = {f.name: None for f in schemas.RECORD} | {"source": "aic", "image_url": "i"}
    made = [blank | {"source_url": u, "title": t, "artists": [{f.name: n if f.name == "name_raw" else None for f in schemas.ARTIST} for n in names]} for u, t, names in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.RECORD) for r in made], schemas.RECORD)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def shuffled_scans(df, marker="Bucketed: true"):
    """How many scans of bucketed tables stand below an exchange of the plan, and how many there are."""
    depth = lambda line: len(re.match(r"[ :+|*()\-\d]*", line)[0])
    above, below, scans = [], 0, 0
    for line in plan(df):
        while above and above[-1][0] >= depth(line):
            above.pop()
        if marker in line:
            scans += 1
            below += any("Exchange" in text for _, text in above)
        above.append((depth(line), line))
    return below, scans


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def titles(snapshot):
    return {r["source_url"]: (r["id"], r["title"]) for r in snapshot.read("images").collect()}


def artists(snapshot):
    return sorted((r["image_id"], r["position"], r["name_raw"], r["id"]) for r in snapshot.read("image_artists").collect())


@pytest.mark.parametrize("buckets", [0, 4])
def test_images_and_artists_become_current_together(spark, tmp_path, monkeypatch, buckets):
    s = store.Store(spark, f"{tmp_path}/s", buckets)
    first, stats = load.load_records(s, records(spark, ("u1", "a", ["x", "y"]), ("u2", "b", ["z"]), ("u3", "c", [])), F.lit("now"))
    assert stats.first().asDict() == {"inserted": 3, "updated": 0, "unchanged": 0, "total": 3}
    assert titles(first) == {"u1": (1, "a"), "u2": (2, "b"), "u3": (3, "c")} and artists(first) == [(1, 0, "x", 1), (1, 1, "y", 2), (2, 0, "z", 3)]
    batch = records(spark, ("u1", "A", ["x2"]), ("u3", "c", ["w", "v"]), ("u4", "d", ["q"]))

    whole = s.commit
    monkeypatch.setattr(s, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("died before the pointer")))
    with pytest.raises(RuntimeError):
        load.load_records(s, batch, F.lit("now"))
    assert titles(s.snapshot()) == titles(first) and artists(s.snapshot()) == artists(first)  # nothing of it is seen
    monkeypatch.setattr(s, "commit", whole)

    second, stats = load.load_records(s, batch, F.lit("now"))
    assert stats.first().asDict() == {"inserted": 1, "updated": 1, "unchanged": 1, "total": 3} and second.version == 2
    assert titles(s.snapshot()) == {"u1": (1, "A"), "u2": (2, "b"), "u3": (3, "c"), "u4": (4, "d")}
    assert artists(s.snapshot()) == [(1, 0, "x2", 1), (2, 0, "z", 3), (3, 0, "w", 4), (3, 1, "v", 5), (4, 0, "q", 6)]
    assert titles(first)["u1"] == (1, "a") and len(artists(first)) == 3  # who began with the first version goes on with it
    again = store.Store(spark, f"{tmp_path}/s", buckets)
    assert again.version() == 2 and artists(again.snapshot()) == artists(second)
    assert s.commit({"collections": schemas.empty(spark, "collections")}).tables["images"] == second.tables["images"]


def test_a_version_that_breaks_constraints_is_refused(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/s", 4)
    load.load_records(s, records(spark, ("u1", "a", ["x"])), F.lit("now"), checked=True)
    images = s.read("images")
    with pytest.raises(store.ConstraintError, match=r"images: unique id \(1\); images: unique source_url \(1\)"):
        s.commit({"images": images.unionByName(images)}, checked=True)
    with pytest.raises(store.ConstraintError, match="image_artists: orphans image_id"):
        s.commit({"images": images.limit(0)}, checked=True)
    assert s.version() == 1 and s.commit({"images": images}, checked=True).version == 2


def test_upserts_do_not_shuffle_the_table(spark, tmp_path, no_broadcast):
    s = store.Store(spark, f"{tmp_path}/s", 4)
    load.load_records(s, records(spark, *((f"u{i}", "a", ["x", "y"]) for i in range(40))), F.lit("now"))
    now = s.snapshot()
    batch = records(spark, ("u1", "B", ["n"]), ("new", "c", ["m"]))
    images = load.upsert_images(now.read("images"), batch, F.lit("now"))
    assert shuffled_scans(images) == (0, 1)
    touched, rows = load.child_rows(batch, now.read("images"))
    assert shuffled_scans(load.sync_artists(now.read("image_artists"), touched, rows, 4)) == (0, 1)
    placed = s.stage("images", images, now, placed=True).rows
    assert shuffled_scans(placed.groupBy("source_url").count()) == (0, 1)
    assert placed.count() == 41 and placed.where("source_url = 'u1'").first()["title"] == "B"
    # the same upsert of plain files shuffles them
    plain = store.Store(spark, f"{tmp_path}/p", 0)
    load.load_records(plain, records(spark, ("u1", "a", [])), F.lit("now"))
    assert any("Exchange hashpartitioning" in line for line in plan(load.upsert_images(plain.read("images"), batch, F.lit("now"))))


def test_raw_store_reads_one_bucket(spark, tmp_path, no_broadcast):
    s = store.RawStore(spark, f"{tmp_path}/raw", 8)
    row = "source string, key string, value string, n int"
    assert s.scan().count() == 0
    assert s.put(spark.createDataFrame([(x, str(k), f"v{k}", 1) for x in ("aic", "met") for k in range(50)], row), ["n"]) == 1
    assert s.put(spark.createDataFrame([("aic", "7", "old", 1), ("aic", "7", "new", 2), ("aic", "99", "v", 1)], row), ["n"]) == 2
    got = s.get("aic", "7")
    assert [tuple(r) for r in got.collect()] == [("aic", "7", "new")] and s.get("aic", "none").count() == 0 and s.get("met", "7").first()["value"] == "v7"
    scan = next(line for line in plan(got) if "FileScan" in line)
    assert "SelectedBucketsCount: 1 out of 8" in scan and "(source#" in scan
    assert s.scan("aic").count() == 51 and s.scan().count() == 101 and shuffled_scans(s.scan()) == (0, 1)
    wanted = spark.createDataFrame([("aic", "99"), ("met", "99"), ("aic", "x"), ("met", "1")], "source string, key string")
    todo = s.missing(wanted)
    assert shuffled_scans(todo) == (0, 1) and sorted(map(tuple, todo.collect())) == [("aic", "x"), ("met", "99")]
    assert store.RawStore(spark.newSession(), f"{tmp_path}/raw", 8).scan().count() == 101


def test_keys_are_checked_in_partitions_that_follow_the_rows(spark, monkeypatch):
    rows = spark.range(200).select("id", (F.col("id") % 199).alias("image_id"), F.lit(0).alias("position"), F.lit("n").alias("name_raw"))
    want = [("image_artists", "unique image_id, position", 1)]
    assert [tuple(r) for r in schemas.faults({"image_artists": rows}).collect()] == want
    monkeypatch.setattr(schemas, "GROUPED_ROWS", 10)
    for times in (1, 2):
        more = rows.unionByName(rows.withColumn("id", F.col("id") + 200).withColumn("image_id", F.col("image_id") + 200)) if times == 2 else rows
        got = schemas.faults({"image_artists": more})
        dealt = [line for line in plan(got) if re.search(rf"hashpartitioning\((id|image_id)#.*, {20 * times}\)", line)]
        assert len(dealt) >= 2 and [tuple(r) for r in got.collect()] == [("image_artists", "unique image_id, position", times)]
