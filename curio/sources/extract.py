"""Raw records of six sources to the common record, as DataFrame projections.

Every extractor takes (source, key, value) rows and returns the columns of ``schemas.RECORD`` after
``key`` and ``item`` (0, but for sources with several items a record), which keep the order of the store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curio import schemas
from curio.functions.text import authority_urls, joined, present, unescape_html, year
from curio.sources import raw as layer
from curio.sources import xmlpull

_ARTIST = schemas.ARTIST.simpleString()


def _parsed(raw: DataFrame, source: str, schema: str) -> DataFrame:
    return raw.where(F.col("source") == source).select("key", F.from_json("value", schema).alias("j")).select("key", "j.*")


def _artist(**fields: Column) -> Column:
    parts = [fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ARTIST]
    return F.struct(*parts)


def _named(artists: Column) -> Column:
    """Artists that have a name."""
    return F.filter(artists, lambda a: a["name_raw"].isNotNull() & (a["name_raw"] != ""))


def _array(c: Column, element: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{element}>"))


def _first(array: Column, test) -> Column:
    return F.get(F.filter(array, test), F.lit(0))


def _record(df: DataFrame, source: str, **fields: Column) -> DataFrame:
    columns = {"source": F.lit(source), **fields}
    out = [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.RECORD]
    return df.select("key", columns.get("item", F.lit(0)).cast("int").alias("item"), *out)


def aic(raw: DataFrame) -> DataFrame:
    d = _parsed(
        raw, "aic",
        "id bigint, is_public_domain boolean, image_id string, artist_ids array<bigint>, artist_titles array<string>, artist_display string, classification_title string, style_title string, title string, "
        "date_display string, date_start string, date_end string, date_qualifier_title string, medium_display string, place_of_origin string, dimensions string, credit_line string, description string",
    ).where(F.col("is_public_domain") & F.col("image_id").isNotNull())
    ids = _array(F.col("artist_ids"), "bigint")
    artists = F.transform(_array(F.col("artist_titles"), "string"), lambda n, i: _artist(name_raw=n, source_artist_id=present(F.get(ids, i))))
    return _record(
        d, "aic", source_id=present(F.col("id")), category=F.col("classification_title"), style=F.col("style_title"), title=F.col("title"), artist=F.col("artist_display"), date=F.col("date_display"),
        date_raw_start=year(F.col("date_start")), date_raw_end=year(F.col("date_end")), date_raw_precision=present(F.col("date_qualifier_title")), medium=F.col("medium_display"), origin=F.col("place_of_origin"),
        dimensions=F.col("dimensions"), credit=F.col("credit_line"), description=F.col("description"), source_url=F.concat(F.lit("https://www.artic.edu/artworks/"), F.col("id")),
        image_url=F.concat(F.lit("https://www.artic.edu/iiif/2/"), F.col("image_id"), F.lit("/full/full/0/default.jpg")), artists=_named(artists),
    )


def met(raw: DataFrame) -> DataFrame:
    d = _parsed(
        raw, "met",
        "objectID bigint, isPublicDomain boolean, primaryImage string, objectURL string, title string, objectDate string, objectBeginDate string, objectEndDate string, classification string, department string, "
        "medium string, dimensions string, creditLine string, artistDisplayName string, artistRole string, artistBeginDate string, artistEndDate string, artistULAN_URL string, artistWikidata_URL string, "
        "constituents array<struct<constituentID:bigint,name:string,role:string,constituentULAN_URL:string,constituentWikidata_URL:string>>",
    ).where(F.col("isPublicDomain") & F.col("primaryImage").isNotNull())
    solo = F.coalesce(F.size(_array(F.col("constituents"), "struct<constituentID:bigint,name:string,role:string,constituentULAN_URL:string,constituentWikidata_URL:string>")), F.lit(0)) <= 1
    born, died = year(F.col("artistBeginDate")), year(F.col("artistEndDate"))
    each = F.transform(
        "constituents",
        lambda c: _artist(
            name_raw=unescape_html(c["name"]), role_raw=present(c["role"]), birth_year=F.when(solo, born), death_year=F.when(solo, died), source_artist_id=present(c["constituentID"]),
            authority_urls=authority_urls(F.array(c["constituentULAN_URL"], c["constituentWikidata_URL"])),
        ),
    )
    d = d.withColumn("named", F.coalesce(_named(each), F.array().cast(f"array<{_ARTIST}>"))).withColumn("shown", present(unescape_html(F.col("artistDisplayName"))))
    alone = F.array(_artist(name_raw=F.col("shown"), role_raw=present(F.col("artistRole")), birth_year=born, death_year=died, authority_urls=authority_urls(F.array("artistULAN_URL", "artistWikidata_URL"))))
    return _record(
        d, "met", source_id=present(F.col("objectID")), category=F.col("classification"), style=F.col("department"), title=F.col("title"), artist=F.col("shown"), date=F.col("objectDate"),
        date_raw_start=year(F.col("objectBeginDate")), date_raw_end=year(F.col("objectEndDate")), medium=F.col("medium"), dimensions=F.col("dimensions"), credit=F.col("creditLine"), source_url=F.col("objectURL"),
        image_url=F.col("primaryImage"), artists=F.when((F.size("named") == 0) & F.col("shown").isNotNull(), alone).otherwise(F.col("named")),
    )


def smithsonian(raw: DataFrame) -> DataFrame:
    text = "array<struct<label:string,content:string>>"
    d = _parsed(
        raw, "smithsonian",
        "id string, content struct<descriptiveNonRepeating:struct<record_ID:string,record_link:string,title:struct<content:string>,metadata_usage:struct<access:string>,"
        "online_media:struct<media:array<struct<type:string,content:string,usage:struct<access:string>,resources:array<struct<label:string,url:string>>>>>>,"
        f"freetext:struct<name:{text},setName:{text},physicalDescription:{text},objectType:{text},date:{text},creditLine:{text}>>",
    ).select("key", F.col("content.descriptiveNonRepeating").alias("d"), F.col("content.freetext").alias("f"))
    d = d.where((F.col("d.metadata_usage.access") == "CC0") & F.col("d.record_link").isNotNull())
    d = d.withColumn("m", _first(F.col("d.online_media.media"), lambda m: (m["type"] == "Images") & (m["usage"]["access"] == "CC0"))).where(F.col("m").isNotNull())
    d = d.withColumn("url", F.coalesce(_first(F.col("m.resources"), lambda r: r["label"] == "High-resolution JPEG")["url"], F.col("m.content"))).where(F.col("url").isNotNull())
    labelled = lambda c, name: _first(F.col(c), lambda e: e["label"] == name)["content"]
    names = _array(F.col("f.name"), "struct<label:string,content:string>")
    return _record(
        d, "smithsonian", source_id=present(F.col("d.record_ID")), category=F.get("f.objectType", F.lit(0))["content"], style=labelled("f.setName", "Department"), title=F.col("d.title.content"),
        artist=joined(F.transform(names, lambda n: n["content"]), ", "), date=F.get("f.date", F.lit(0))["content"], medium=labelled("f.physicalDescription", "Medium"), dimensions=labelled("f.physicalDescription", "Dimensions"),
        credit=F.get("f.creditLine", F.lit(0))["content"], source_url=F.col("d.record_link"), image_url=F.col("url"),
        artists=_named(F.transform(names, lambda n: _artist(name_raw=n["content"], role_raw=present(n["label"])))),
    )


def parismusees(raw: DataFrame) -> DataFrame:
    """One record for each free visual; ``item`` counts them."""
    name = "array<struct<entity:struct<name:string>>>"
    d = _parsed(
        raw, "parismusees",
        "entityId string, title string, absolutePath string, fieldVisuels array<struct<entity:struct<publicUrl:string,fieldImageLibre:boolean>>>, "
        "fieldDateProduction struct<startPrecision:string,startYear:string,endYear:string,century:string>, "
        f"fieldOeuvreSiecle {name}, fieldOeuvreTypesObjet {name}, fieldOeuvreThemeRepresente {name}, fieldMateriauxTechnique {name}, "
        "fieldOeuvreAuteurs array<struct<entity:struct<fieldAuteurAuteur:struct<entity:struct<name:string,fieldPipDateNaissance:struct<startYear:string>,fieldPipDateDeces:struct<startYear:string>>>,"
        "fieldAuteurFonction:struct<entity:struct<name:string>>>>>",
    )
    free = F.filter("fieldVisuels", lambda v: v["entity"]["publicUrl"].isNotNull() & v["entity"]["fieldImageLibre"])
    d = d.withColumn("free", free).where(F.size("free") > 0)
    author = lambda a: a["entity"]["fieldAuteurAuteur"]["entity"]
    artists = F.transform(
        "fieldOeuvreAuteurs",
        lambda a: _artist(name_raw=author(a)["name"], role_raw=a["entity"]["fieldAuteurFonction"]["entity"]["name"], birth_year=year(author(a)["fieldPipDateNaissance"]["startYear"]), death_year=year(author(a)["fieldPipDateDeces"]["startYear"])),
    )
    d = d.withColumn("artists", F.coalesce(_named(artists), F.array().cast(f"array<{_ARTIST}>")))
    p = F.col("fieldDateProduction")
    years = F.regexp_replace(F.concat(F.coalesce(p["startYear"], F.lit("")), F.lit("-"), F.coalesce(p["endYear"], F.lit(""))), "-$", "")
    date = F.when(years != "", years).otherwise(F.coalesce(present(p["century"]), present(F.get("fieldOeuvreSiecle", F.lit(0))["entity"]["name"])))
    names = lambda c: joined(F.transform(c, lambda e: e["entity"]["name"]), ",")
    d = d.withColumn("date", date).select("*", F.posexplode("free").alias("item", "visual"))
    return _record(
        d, "parismusees", item=F.col("item"), source_id=present(F.col("entityId")), category=names("fieldOeuvreTypesObjet"), style=names("fieldOeuvreThemeRepresente"), title=F.col("title"),
        artist=joined(F.transform("artists", lambda a: a["name_raw"]), ","), date=F.col("date"), date_raw_start=year(p["startYear"]), date_raw_end=year(p["endYear"]), date_raw_precision=present(p["startPrecision"]),
        medium=names("fieldMateriauxTechnique"), source_url=F.concat(F.col("absolutePath"), F.lit("?"), F.col("item")), image_url=F.col("visual.entity.publicUrl"), artists=F.col("artists"),
    )


def rijksmuseum(raw: DataFrame) -> DataFrame:
    """One record for each description: what it refers to is looked up among all its resources, whatever their elements."""
    d = xmlpull.descriptions(raw.where(F.col("source") == "rijksmuseum").select("key", F.get_json_object("value", "$.rdf_xml").alias("xml")))
    d = d.where(F.col("agg.rights").contains("publicdomain") & F.col("agg.shown_by").isNotNull() & F.col("cho").isNotNull())
    spoken = lambda words: F.coalesce(_first(words, lambda w: w["lang"] == "en"), F.get(words, F.lit(0)))["text"]
    found = lambda uri: F.try_element_at("resources", uri)
    label = lambda uri: spoken(found(uri)["labels"])
    # each creator's resource is looked up once
    known = F.transform(F.filter("cho.creators", lambda c: c.isNotNull()), lambda c: F.struct(c.alias("uri"), found(c).alias("r")))
    artists = F.transform(
        known,
        lambda k: _artist(
            name_raw=spoken(k["r"]["labels"]), birth_year=year(k["r"]["born"]), death_year=year(k["r"]["died"]), source_artist_id=k["uri"],
            authority_urls=authority_urls(k["r"]["same"]),
        ),
    )
    d = d.withColumn("artists", F.coalesce(_named(artists), F.array().cast(f"array<{_ARTIST}>")))
    cho, agg = F.col("cho"), F.col("agg")
    return _record(
        d, "rijksmuseum", source_id=present(cho["about"]), category=label(cho["type"]), title=spoken(cho["title"]), artist=joined(F.transform("artists", lambda a: a["name_raw"]), ", "),
        date=spoken(cho["created"]), medium=label(cho["medium"]), origin=label(cho["spatial"]), dimensions=spoken(cho["extent"]), description=spoken(cho["description"]),
        source_url=agg["shown_at"], image_url=agg["shown_by"], artists=F.col("artists"),
    )


def cleveland(raw: DataFrame) -> DataFrame:
    creator = "struct<id:bigint,description:string,role:string,qualifier:string,birth_year:string,death_year:string,name_in_original_language:string>"
    d = _parsed(
        raw, "cleveland",
        f"id bigint, share_license_status string, images struct<print:struct<url:string>,web:struct<url:string>>, creators array<{creator}>, culture array<string>, type string, department string, title string, "
        "creation_date string, creation_date_earliest string, creation_date_latest string, technique string, measurements string, creditline string, description string, url string",
    )
    d = d.withColumn("picture", F.coalesce("images.print.url", "images.web.url")).where((F.col("share_license_status") == "CC0") & F.col("picture").isNotNull())
    creators = _array(F.col("creators"), creator)
    artists = F.transform(
        creators,
        lambda c: _artist(
            name_raw=c["description"], role_raw=present(c["role"]), qualifier_raw=present(c["qualifier"]), birth_year=year(c["birth_year"]), death_year=year(c["death_year"]), source_artist_id=present(c["id"]),
            name_original_language=present(c["name_in_original_language"]),
        ),
    )
    return _record(
        d, "cleveland", source_id=present(F.col("id")), category=F.col("type"), style=F.col("department"), title=F.col("title"), artist=joined(F.transform(creators, lambda c: c["description"]), ", "), date=F.col("creation_date"),
        date_raw_start=year(F.col("creation_date_earliest")), date_raw_end=year(F.col("creation_date_latest")), medium=F.col("technique"), origin=joined(F.col("culture"), ", "), dimensions=F.col("measurements"),
        credit=F.col("creditline"), description=F.col("description"), source_url=F.col("url"), image_url=F.col("picture"), artists=_named(artists),
    )


EXTRACTORS = {"aic": aic, "met": met, "parismusees": parismusees, "rijksmuseum": rijksmuseum, "smithsonian": smithsonian, "cleveland": cleveland}


def targets(arguments: list[str]) -> list[tuple[str, str | None]]:
    """(source, path) of ``name`` or ``name=path`` arguments; all sources for none; an unknown name is an error."""
    out = [(name, path or None) for name, _, path in (a.partition("=") for a in arguments)] or [(s, None) for s in schemas.SOURCES]
    for name, _ in out:
        if name not in EXTRACTORS:
            raise ValueError(f"unknown source {name!r}; there are {', '.join(EXTRACTORS)}")
    return out


def extract(raw: DataFrame, *sources: str) -> DataFrame:
    """Common records of the named sources (all for none) that have both URLs, with ``source_order``."""
    wanted = [name for name, _ in targets(list(sources))]
    parts = [EXTRACTORS[s](raw).withColumn("source_order", F.lit(schemas.SOURCES.index(s))) for s in wanted]
    return reduce(DataFrame.unionByName, parts).where(F.col("source_url").isNotNull() & F.col("image_url").isNotNull())


def extract_targets(spark: SparkSession, arguments: list[str], store: str) -> DataFrame:
    """Common records of ``name`` or ``name=path`` arguments: a source is read from its own path, or from its part of the store."""
    parts = [extract(layer.scan(spark, path or store, name), name) for name, path in targets(arguments)]
    return reduce(DataFrame.unionByName, parts)
