"""Small raw records of each source, and what becomes of them."""

import json

import pytest

from pyspark.sql import functions as F

from curio import schemas
from curio.functions import text
from curio.sources import extract, raw
from curio.streaming import ingest


def store(spark, source, *records):
    return spark.createDataFrame([(source, f"k{i:02}", r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], schemas.RAW)


def rows(spark, source, *records):
    return [r.asDict(recursive=True) for r in extract.EXTRACTORS[source](store(spark, source, *records)).orderBy("key", "item").collect()]


def test_aic(spark):
    base = {"id": 7, "is_public_domain": True, "image_id": "im", "artist_titles": ["A", "", "B", None], "artist_ids": [1, 2, 3], "date_start": 1863, "date_end": "1865-01", "title": ""}
    got = rows(spark, "aic", base, base | {"is_public_domain": False}, base | {"image_id": None}, base | {"artist_ids": None}, base | {"is_public_domain": None})
    assert [r["key"] for r in got] == ["k00", "k03"]
    assert [(a["name_raw"], a["source_artist_id"]) for a in got[0]["artists"]] == [("A", "1"), ("B", "3")]
    assert [a["source_artist_id"] for a in got[1]["artists"]] == [None, None]
    assert (got[0]["source_url"], got[0]["date_raw_start"], got[0]["date_raw_end"], got[0]["title"]) == ("https://www.artic.edu/artworks/7", 1863, 1865, "")


def test_met(spark):
    base = {"objectID": 1, "isPublicDomain": True, "primaryImage": "", "objectURL": "u", "artistBeginDate": "1850", "artistEndDate": "", "artistDisplayName": "B. Altman &amp; Co."}
    two = [{"constituentID": 5, "name": "X &#233;", "role": "", "constituentULAN_URL": "u", "constituentWikidata_URL": ""}, {"name": ""}]
    got = rows(spark, "met", base, base | {"constituents": two}, base | {"constituents": two[:1]}, base | {"primaryImage": None}, base | {"artistDisplayName": ""})
    assert [r["key"] for r in got] == ["k00", "k01", "k02", "k04"]
    assert got[0]["artists"][0]["name_raw"] == "B. Altman & Co." == got[0]["artist"] and got[0]["artists"][0]["birth_year"] == 1850 and got[0]["artists"][0]["source_artist_id"] is None
    assert [(a["name_raw"], a["birth_year"], a["authority_urls"]) for a in got[1]["artists"]] == [("X é", None, '["u"]')]
    assert got[2]["artists"][0]["birth_year"] == 1850 and got[3]["artists"] == [] and got[3]["artist"] is None


def test_smithsonian(spark):
    media = [{"type": "Images", "usage": {"access": "no"}, "content": "bad"}, {"type": "Images", "usage": {"access": "CC0"}, "content": "c", "resources": [{"label": "High-resolution JPEG", "url": "hi"}]}]
    dnr = {"record_ID": "r", "record_link": "l", "metadata_usage": {"access": "CC0"}, "online_media": {"media": media}}
    base = {"content": {"descriptiveNonRepeating": dnr, "freetext": {"name": [{"label": "Artist", "content": "N"}, {"label": "x"}], "physicalDescription": [{"label": "Medium", "content": "oil"}]}}}
    closed = {"content": {"descriptiveNonRepeating": dnr | {"metadata_usage": {}}}}
    bare = {"content": {"descriptiveNonRepeating": dnr | {"online_media": {"media": [media[1] | {"resources": None}]}}}}
    got = rows(spark, "smithsonian", base, closed, bare)
    assert [(r["key"], r["image_url"], r["artist"], len(r["artists"]), r["medium"]) for r in got] == [("k00", "hi", "N", 1, "oil"), ("k02", "c", "", 0, None)]


@pytest.mark.parametrize(("production", "century", "date"), [({"startYear": 1890}, None, "1890"), ({"startYear": 1890, "endYear": 1900}, None, "1890-1900"), ({"endYear": 1900}, None, "-1900"), ({}, "X", "X"), (None, "X", "X"), (None, None, None), ({"century": "c"}, "X", "c")])
def test_parismusees(spark, production, century, date):
    visual = lambda free, url="v": {"entity": {"publicUrl": url, "fieldImageLibre": free}}
    author = {"entity": {"fieldAuteurAuteur": {"entity": {"name": "N", "fieldPipDateNaissance": {"startYear": 1800}}}, "fieldAuteurFonction": {"entity": {"name": ""}}}}
    base = {"entityId": "e", "absolutePath": "p", "fieldVisuels": [visual(True), visual(False), visual(True), visual(True, None)], "fieldOeuvreAuteurs": [author], "fieldDateProduction": production, "fieldOeuvreSiecle": [{"entity": {"name": century}}]}
    got = rows(spark, "parismusees", base, base | {"fieldVisuels": None})
    assert [(r["source_url"], r["date"], r["style"], r["artist"]) for r in got] == [("p?0", date, "", "N"), ("p?1", date, "", "N")]
    assert got[0]["artists"][0]["role_raw"] == "" and got[0]["artists"][0]["birth_year"] == 1800


def test_rijksmuseum(spark):
    def doc(rights="http://x/publicdomain/", shown='<edm:isShownAt rdf:resource="at"/>', agent="ag"):
        xml = f"""<rdf:RDF xmlns:rdf="r" xmlns:ore="o" xmlns:edm="e" xmlns:dc="d" xmlns:dcterms="t" xmlns:skos="s" xmlns:owl="w" xmlns:rdaGr2="g"><ore:Aggregation><edm:rights rdf:resource="{rights}"/><edm:isShownBy rdf:resource="img"/>{shown}</ore:Aggregation>
        <edm:ProvidedCHO rdf:about="c"><dc:creator rdf:resource="ag"/><dc:title xml:lang="nl">nl</dc:title><dc:title xml:lang="en"> plain </dc:title><dcterms:created>1700</dcterms:created></edm:ProvidedCHO>
        <edm:Agent rdf:about="{agent}"><skos:prefLabel xml:lang="nl">Nl</skos:prefLabel><rdaGr2:dateOfBirth>1606</rdaGr2:dateOfBirth></edm:Agent></rdf:RDF>"""
        return {"identifier": "i", "datestamp": "d", "rdf_xml": xml}

    raws = store(spark, "rijksmuseum", doc(), doc(rights="closed"), doc(shown=""), doc(agent="other"), {"rdf_xml": "<broken"})
    got = [r.asDict(recursive=True) for r in extract.extract(raws, "rijksmuseum").orderBy("key").collect()]
    assert [r["key"] for r in got] == ["k00", "k03"]
    assert (got[0]["artist"], got[0]["title"], got[0]["date"], got[0]["artists"][0]["birth_year"]) == ("Nl", " plain ", "1700", 1606)
    assert got[1]["artists"] == [] and got[1]["artist"] == ""


def test_cleveland(spark):
    base = {"id": 1, "share_license_status": "CC0", "images": {"web": {"url": "w"}}, "creators": [{"description": ""}, {"description": "D", "name_in_original_language": "羅"}], "culture": None, "url": "u"}
    got = rows(spark, "cleveland", base, base | {"images": {}}, base | {"share_license_status": None}, base | {"images": {"print": {"url": "p"}, "web": {"url": "w"}}})
    assert [(r["key"], r["image_url"], r["artist"], len(r["artists"]), r["origin"]) for r in got] == [("k00", "w", ", D", 1, ""), ("k03", "p", ", D", 1, "")]


def test_targets():
    assert extract.targets(["aic", "met=/x=y"]) == [("aic", None), ("met", "/x=y")] and len(extract.targets([])) == 6
    with pytest.raises(ValueError, match="unknown source"):
        extract.targets(["louvre"])


def test_scalars(spark):
    from pyspark.sql import functions as F

    years = [(None, None), ("1863", 1863), (" 1863-05-01", 1863), ("-500", -500), ("abc", None), ("", None), ("12345678", 123456)]
    df = spark.createDataFrame(years, "v string, y int")
    assert [tuple(r) for r in df.select(text.year(F.col("v")), "y").collect()] == [(y, y) for _, y in years]
    html = [("&amp;lt;", "&lt;"), ("&#8364;&#x20AC;&apos;&eacute;& &#0;", "€€'&eacute;& &#0;"), ("", ""), (None, None), ("a&b;c&quot", "a&b;c&quot")]
    df = spark.createDataFrame(html, "v string, w string")
    assert [r[0] for r in df.select(text.unescape_html(F.col("v"))).collect()] == [w for _, w in html]
    like = [("Katsukawa Shunsho", ["katsukawa shun"], True), ("Paul Cézanne", ["PAUL C_zanne"], True), ("ÉCOLE", ["école"], False), ("Kano", ["Kano "], False), ("a100b", ["100%"], True), ("a\\b", ["\\"], True), ("ab", ["\\"], False), (None, ["a"], False)]
    for value, patterns, hit in like:
        assert spark.createDataFrame([(value,)], "v string").select(text.contains_like(F.col("v"), *patterns)).first()[0] is hit


def test_ingest_takes_each_file_once(spark, tmp_path):
    landed, out, log = tmp_path / "landed", f"{tmp_path}/store", f"{tmp_path}/log"
    landed.mkdir()
    (landed / "a.txt").write_text('{"id": "1", "v": 1}\n\n{"x": 0}\n{"id": "2"}\n')
    assert ingest.ingest(spark, str(landed), out, log) == 1
    (landed / "b.txt").write_text('{"id": "1", "v": 2}\n')
    assert ingest.ingest(spark, str(landed), out, log) == 1 and ingest.ingest(spark, str(landed), out, log) == 0
    got = {r["key"]: r["value"] for r in ingest.stored(spark, out).collect()}
    assert got == {"1": '{"id": "1", "v": 2}', "2": '{"id": "2"}'}


def test_a_corrupt_shard_fails_for_itself_and_is_tried_again(spark, tmp_path):
    import gzip

    landed, out, log = tmp_path / "landed", f"{tmp_path}/store", f"{tmp_path}/log"
    landed.mkdir()
    whole = {k: gzip.compress(f'{{"id": "{k}", "v": 1}}\n'.encode() * 3) for k in "abcde"}
    for k, data in whole.items():
        (landed / f"{k}.gz").write_bytes(data[:-12] if k == "c" else data)
    (landed / "f.txt").write_text('{"id": "f"}\n{"id": broken')
    assert ingest.ingest(spark, str(landed), out, log, files_per_batch=3) == 2
    told = {r["shard"].rpartition("/")[2]: r for r in ingest.outcomes(spark, out).collect()}
    assert {k for k, r in told.items() if not r["stored"]} == {"c.gz", "f.txt"} and told["a.gz"]["lines"] == 3 and told["c.gz"]["error"] and told["c.gz"]["retry"] == 0
    assert {r["key"] for r in ingest.stored(spark, out).collect()} == set("abde")
    (landed / "c.gz").write_bytes(whole["c"])
    assert ingest.ingest(spark, str(landed), out, log) == 0  # no new file: the failed ones are tried all the same
    told = {r["shard"].rpartition("/")[2]: (r["stored"], r["retry"]) for r in ingest.outcomes(spark, out).collect()}
    assert told["c.gz"] == (True, 1) and told["f.txt"] == (False, 1) and told["a.gz"] == (True, 0)
    assert {r["key"] for r in ingest.stored(spark, out).collect()} == set("abcde")
    assert ingest.retry_failed(spark, out) == 1


def test_records_of_odd_pages():
    from curio.sources import xmlpull

    whole = '<r xmlns:o="x"><o:record><o:header status="deleted"><o:identifier>a/1</o:identifier></o:header></o:record><record><header><identifier> b&amp;/2 </identifier><datestamp>d</datestamp></header><metadata><rdf:RDF é="1"><record/></rdf:RDF></metadata></record>'
    first = ("deleted", "a/1", None, None)
    second = (None, "b&/2", "d", '<rdf:RDF é="1"><record/></rdf:RDF>')
    assert xmlpull.records(whole + "</r>") == [first, second] and xmlpull.records(whole + "<record><header>") == [first, second]
    assert xmlpull.records(None) == xmlpull.records("") == xmlpull.records("no xml") == []
    assert xmlpull.records("<r><record><metadata><rdf:RDF/></metadata></record></r>") == [(None, None, None, "<rdf:RDF/>")]
    assert xmlpull.described("<rdf:RDF><broken") == xmlpull.described(None) == (None, None, [])
    agg, cho, resources = xmlpull.described('<rdf:RDF><x rdf:about="a"><skos:prefLabel/></x><y rdf:about="a"><skos:prefLabel xml:lang="en">Y</skos:prefLabel><z rdf:about="deep"/></y></rdf:RDF>')
    assert agg is None and cho is None and resources == [("a", {"labels": [{"lang": "en", "text": "Y"}], "born": None, "died": None, "same": []})]


def test_a_page_is_pulled_in_pieces(spark, monkeypatch):
    from curio.sources import xmlpull

    one = "<o:record><header><identifier>é/{k}</identifier></header><metadata><rdf:RDF a='>'>“<b/>” {k}</rdf:RDF></metadata></o:record>"
    page = f"<r xmlns:o='x'>{''.join(one.format(k=k) for k in range(30))}"
    want = [(None, f"é/{k}", None, f"<rdf:RDF a='>'>“<b/>” {k}</rdf:RDF>") for k in range(30)]
    for piece in (1, 2, 3, 7, 64, 1 << 20):
        monkeypatch.setattr(xmlpull, "_PIECE", piece)
        assert xmlpull.records(page + "</r>") == xmlpull.records(page) == want and xmlpull.records(page + "<o:record>") == want
    monkeypatch.setattr(xmlpull, "_PIECE", 100)
    pulled = xmlpull._pulled((page + "</r>").encode())
    assert next(pulled) == want[0] and len(pulled.gi_frame.f_locals["out"]) < 3  # not the whole page's records
    pages = [xmlpull.pa.RecordBatch.from_pydict({"value": [page, None, "", "no xml", page + "</r>"]})]
    got = list(xmlpull._harvested(iter(pages)))
    assert max(b.num_rows for b in got) < 5 and [tuple(r.values()) for b in got for r in b.to_pylist()] == want * 2
    assert sorted(map(tuple, xmlpull.harvested(spark.createDataFrame([(page,), (None,)], "value string")).collect())) == sorted(want)


def test_no_name_is_defined_twice():
    import ast
    import pathlib

    for path in pathlib.Path(extract.__file__).parents[1].rglob("*.py"):
        body = ast.parse(path.read_text()).body
        names = [n.name for n in body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
        names += [t.id for n in body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
        assert len(names) == len(set(names)), path


def test_targets_by_path(spark, tmp_path):
    aic = store(spark, "aic", {"id": 1, "is_public_domain": True, "image_id": "i", "title": "of the store"})
    raw.write(aic, f"{tmp_path}/all")
    raw.write(aic.withColumn("value", F.replace("value", F.lit("of the store"), F.lit("of a path"))), f"{tmp_path}/one")
    got = lambda *a: [r["title"] for r in extract.extract_targets(spark, list(a), f"{tmp_path}/all").collect()]
    assert got("aic") == ["of the store"] and got(f"aic={tmp_path}/one") == ["of a path"] and got("aic", f"aic={tmp_path}/one") == ["of the store", "of a path"]


def test_no_store_yet(spark, tmp_path):
    assert ingest.stored(spark, f"{tmp_path}/none").count() == 0 and ingest.outcomes(spark, f"{tmp_path}/none").count() == 0


def test_raw_store(spark, tmp_path):
    a = spark.createDataFrame([("s", "1", "a"), ("s", "2", "b")], schemas.RAW)
    b = spark.createDataFrame([("s", "2", "c", 1), ("s", "2", "d", 2), ("t", "1", "e", 1)], "source string, key string, value string, n int")
    both = raw.put(a, b, ["n"])
    assert sorted(map(tuple, both.collect())) == [("s", "1", "a"), ("s", "2", "d"), ("t", "1", "e")]
    raw.write(both, f"{tmp_path}/raw")
    assert raw.scan(spark, f"{tmp_path}/raw", "s").count() == 2 and raw.get(both, "t", "1").count() == 1
    page = spark.createDataFrame([("<r><resumptionToken>a b</resumptionToken></r>",), ("<r/>",)], "value string")
    assert [r[0] for r in raw.resume_token(page).collect()] == ["a+b", None]
