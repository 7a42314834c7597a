"""Landed pages as a data source: chains, partitions, streams that fail and go on."""

import json

import pytest
from pyspark.sql import functions as F

from curio.sources import pages, raw

PAGE = "source string, epoch int, cursor string, value string"


def skip_page(first, n, total, source="cleveland", epoch=0, cursor=None):
    body = {"info": {"total": total}, "data": [{"id": first + i, "title": f"t{first + i}"} for i in range(n)]}
    return source, epoch, str(first if cursor is None else cursor), json.dumps(body)


def token_page(cursor, after, ids, epoch=0, bad=False):
    records = "".join(f"<record><header><identifier>a/{i}</identifier><datestamp>d</datestamp></header><metadata><rdf:RDF>{i}</rdf:RDF></metadata></record>" for i in ids)
    tail = '<error code="badResumptionToken">gone</error>' if bad else f"<resumptionToken>{after}</resumptionToken>" if after else "<resumptionToken/>"
    return "rijksmuseum", epoch, cursor, f"<OAI>{records}{tail}</OAI>"


@pytest.fixture
def land(spark, tmp_path):
    path = f"file://{tmp_path}/landed"
    pages.register(spark)

    def add(mode, *rows):
        pages.land(spark.createDataFrame(rows, PAGE), path, mode)
        return path

    return add


def cursors(df):
    return sorted((r["source"], r["epoch"], r["cursor"]) for r in df.select("source", "epoch", "cursor").collect())


def reader(spark, path, **options):
    return spark.read.format("pages").options(path=path, **options).load()


def test_skips_are_followed_as_far_as_pages_are_landed(spark, land):
    path = land("skip", *(skip_page(k, 100, 450) for k in (300, 0, 100)))
    assert cursors(reader(spark, path)) == [("cleveland", 0, "0"), ("cleveland", 0, "100")]  # 200 is missing
    assert pages.resume_at(path, "cleveland") == (0, "200")
    land("skip", skip_page(200, 100, 450), skip_page(400, 50, 450))
    got = reader(spark, path, pagesPerPartition="2")
    assert len(cursors(got)) == 5 and got.rdd.getNumPartitions() == 3
    assert pages.resume_at(path, "cleveland") == (1, None)  # done: another crawl would begin
    rows = raw.from_pages(got, "cleveland", "$.data", F.get_json_object("value", "$.id"))
    assert rows.select(F.count("*"), F.count_distinct("key")).first() == (450, 450)


def test_offsets_urls_and_sources_apart(spark, land):
    entities = lambda n: json.dumps({"data": {"nodeQuery": {"count": 9, "entities": [{"entityId": i} for i in range(n)] or None}}})
    path = land("offset", ("parismusees", 0, "0", entities(100)), ("parismusees", 0, "100", entities(3)), ("parismusees", 0, "200", entities(0)), ("parismusees", 0, "300", entities(5)))
    url = lambda after: json.dumps({"pagination": {"next_url": after}, "data": []})
    land("url", ("aic", 0, "", url("http://x/2")), ("aic", 0, "http://x/2", url(None)), ("aic", 0, "http://x/9", url(None)))
    assert cursors(reader(spark, path)) == [("aic", 0, ""), ("aic", 0, "http://x/2"), *(("parismusees", 0, c) for c in ("0", "100", "200"))]
    assert cursors(reader(spark, path, source="aic")) == [("aic", 0, ""), ("aic", 0, "http://x/2")]


def test_a_bad_token_restarts_and_a_loop_is_an_error(spark, land):
    path = land("token", token_page("", "a/b=", [1, 2]), token_page("a/b=", "", [], bad=True))
    assert cursors(reader(spark, path)) == [("rijksmuseum", 0, "")] and pages.resume_at(path, "rijksmuseum") == (1, None)
    land("token", token_page("", "n2", [1, 2], epoch=1), token_page("n2", "", [3], epoch=1))
    assert cursors(reader(spark, path)) == [("rijksmuseum", 0, ""), ("rijksmuseum", 1, ""), ("rijksmuseum", 1, "n2")]
    land("token", token_page("", "x", [1], epoch=2), token_page("x", "x", [2], epoch=2))
    with pytest.raises(Exception, match="lead back"):
        reader(spark, path).count()


def test_a_page_landed_twice_counts_once(spark, land):
    path = land("skip", skip_page(0, 100, 150))
    land("skip", skip_page(0, 100, 150), skip_page(100, 50, 150), skip_page(100, 50, 150))
    assert cursors(reader(spark, path)) == [("cleveland", 0, "0"), ("cleveland", 0, "100")]


def test_nothing_landed_and_unknown_modes(spark, land, tmp_path):
    assert reader(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="unknown mode"):
        pages.following("other")
    with pytest.raises(Exception, match="path"):
        spark.read.format("pages").load().count()


def test_stream_goes_on_after_a_failed_batch(spark, land, tmp_path):
    path = land("skip", skip_page(0, 100, 350), skip_page(100, 100, 350))
    store, checkpoint = f"{tmp_path}/store", f"{tmp_path}/checkpoint"
    rows = lambda df: raw.from_pages(df, "cleveland", "$.data", F.get_json_object("value", "$.id"))
    run = lambda how: pages.crawled(spark, path, "cleveland", how, checkpoint, store)
    counted = lambda: spark.read.parquet(store).select(F.count("*"), F.count_distinct("key")).first()

    assert run(rows) == 1 and counted() == (200, 200)
    land("skip", skip_page(200, 100, 350))

    def dies(df):
        rows(df).write.mode("overwrite").parquet(f"{store}/batch=1")  # a part is written before the end
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(dies)
    land("skip", skip_page(300, 50, 350))  # what lands meanwhile is no part of the failed batch
    assert run(rows) == 2 and counted() == (350, 350)
    assert run(rows) == 0 and counted() == (350, 350)
    land("skip", skip_page(0, 100, 100, epoch=1))  # a crawl from the start
    assert run(rows) == 1 and counted() == (450, 350)


def test_stream_restarts_at_a_bad_token(spark, land, tmp_path):
    path = land("token", token_page("", "t", [1, 2]), token_page("t", "", [], bad=True))
    seen = []
    run = lambda: pages.crawled(spark, path, "rijksmuseum", lambda df: seen.append(cursors(df)) or raw.from_oai(raw.harvested(df)), f"{tmp_path}/c", f"{tmp_path}/s")
    assert run() == 1
    land("token", token_page("", "u", [1, 2], epoch=1), token_page("u", "", [3], epoch=1))
    assert run() == 1 and seen == [[("rijksmuseum", 0, "")], [("rijksmuseum", 1, ""), ("rijksmuseum", 1, "u")]]
    assert {r["key"] for r in spark.read.parquet(f"{tmp_path}/s").collect()} == {"1", "2", "3"}
