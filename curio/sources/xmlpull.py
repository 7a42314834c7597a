"""XML pulled apart in Arrow batches: harvested pages into records, descriptions into maps of their resources.

Spark's own reader wants the names of all elements beforehand and gives no text as it was sent.  Here names count
as they are written, prefix and all; comments and character data are what the parser says they are.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TAG = re.compile(rb"<(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>")
_ROWS = 500
#: Bytes of a page that are parsed at a time; records and, in characters, descriptions that are handed on together.
_PIECE = 1 << 20
_RECORDS = 10_000


class Node:
    """An element: its name, attributes, child elements and the text before the first of them."""

    __slots__ = ("attributes", "children", "name", "text")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children, self.text = name, attributes, [], ""

    def all(self, name: str) -> list[Node]:
        return [c for c in self.children if c.name == name]

    def one(self, name: str) -> Node | None:
        return next((c for c in self.children if c.name == name), None)

    def walk(self) -> Iterator[Node]:
        """The element and all below it, in the order of the text."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))


def _parser() -> expat.XMLParserType:
    parser = expat.ParserCreate(encoding="utf-8")
    parser.buffer_text = True
    return parser


def tree(xml: str | None) -> Node | None:
    """The root element; None for a text that is no whole XML."""
    if not xml:
        return None
    top = Node("", {})
    stack = [top]
    parser = _parser()

    def start(name: str, attributes: dict[str, str]) -> None:
        node = Node(name, attributes)
        stack[-1].children.append(node)
        stack.append(node)

    def text(data: str) -> None:
        if not stack[-1].children:
            stack[-1].text += data

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), text
    try:
        parser.Parse(xml.encode(), True)
    except expat.ExpatError:
        return None
    return top.children[0] if top.children else None


# ---- descriptions

_WORDS = "array<struct<lang:string,text:string>>"
RESOURCE = f"struct<labels:{_WORDS},born:string,died:string,same:array<string>>"
DESCRIPTION = (
    f"key string, agg struct<rights:string,shown_by:string,shown_at:string>, "
    f"cho struct<about:string,creators:array<string>,type:string,medium:string,spatial:string,title:{_WORDS},created:{_WORDS},extent:{_WORDS},description:{_WORDS}>, resources map<string,{RESOURCE}>"
)
_ARROW_WORDS = pa.list_(pa.struct([("lang", pa.string()), ("text", pa.string())]))
_ARROW = {
    "agg": pa.struct([("rights", pa.string()), ("shown_by", pa.string()), ("shown_at", pa.string())]),
    "cho": pa.struct([("about", pa.string()), ("creators", pa.list_(pa.string())), *((n, pa.string()) for n in ("type", "medium", "spatial")), *((n, _ARROW_WORDS) for n in ("title", "created", "extent", "description"))]),
    "resources": pa.map_(pa.string(), pa.struct([("labels", _ARROW_WORDS), ("born", pa.string()), ("died", pa.string()), ("same", pa.list_(pa.string()))])),
}


def _words(nodes: list[Node]) -> list[dict]:
    return [{"lang": n.attributes.get("xml:lang"), "text": n.text or None} for n in nodes]


def _reference(node: Node | None) -> str | None:
    return node.attributes.get("rdf:resource") if node is not None else None


def described(xml: str | None) -> tuple[dict | None, dict | None, list[tuple[str, dict]]]:
    """The first aggregation and the first object at any depth, and all resources below the root by their name, the last of each."""
    root = tree(xml)
    if root is None:
        return None, None, []
    found: dict[str, Node] = {}
    for node in root.walk():
        if node.name in ("ore:Aggregation", "edm:ProvidedCHO"):
            found.setdefault(node.name, node)
    agg, cho = found.get("ore:Aggregation"), found.get("edm:ProvidedCHO")
    resources = {}
    for node in root.children:
        if (about := node.attributes.get("rdf:about")) is not None:
            born, died = node.one("rdaGr2:dateOfBirth"), node.one("rdaGr2:dateOfDeath")
            resources[about] = {"labels": _words(node.all("skos:prefLabel")), "born": born and born.text, "died": died and died.text, "same": [_reference(s) for s in node.all("owl:sameAs")]}
    return (
        agg and {"rights": _reference(agg.one("edm:rights")), "shown_by": _reference(agg.one("edm:isShownBy")), "shown_at": _reference(agg.one("edm:isShownAt"))},
        cho
        and {"about": cho.attributes.get("rdf:about"), "creators": [_reference(c) for c in cho.all("dc:creator")]}
        | {n: _reference(cho.one(e)) for n, e in (("type", "dc:type"), ("medium", "dcterms:medium"), ("spatial", "dcterms:spatial"))}
        | {n: _words(cho.all(e)) for n, e in (("title", "dc:title"), ("created", "dcterms:created"), ("extent", "dcterms:extent"), ("description", "dc:description"))},
        list(resources.items()),
    )


def _batched(batches: Iterator[pa.RecordBatch], row: Callable[[list], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            yield row([c.to_pylist() for c in batch.slice(k, _ROWS).columns])


def _descriptions(columns: list) -> pa.RecordBatch:
    parts = list(zip(*map(described, columns[1]), strict=True))
    arrays = [pa.array(columns[0], pa.string()), *(pa.array(list(p), t) for p, t in zip(parts, _ARROW.values(), strict=True))]
    return pa.RecordBatch.from_arrays(arrays, names=["key", *_ARROW])


def descriptions(rows: DataFrame) -> DataFrame:
    """(key, agg, cho, resources) of descriptions (key, xml); all is null or empty where the text is no whole XML."""
    return rows.select("key", "xml").mapInArrow(lambda b: _batched(b, _descriptions), DESCRIPTION)


# ---- harvested pages


_Record = tuple[str | None, str | None, str | None, str | None]


def _pulled(data: bytes | pa.Buffer) -> Iterator[_Record]:
    """The records of a page, each as soon as it has ended: beside the page itself, a piece of it and that piece's records are held."""
    data, out = memoryview(data), []
    path: list[str] = []
    now: dict = {}
    parser = _parser()

    def start(name: str, attributes: dict[str, str]) -> None:
        local = name.rpartition(":")[2]
        path.append(local)
        if local == "record" and "record" not in path[:-1]:
            now.clear()
            now["depth"] = len(path)
        elif "depth" in now:
            at = path[now["depth"] :]
            if at == ["header"] and "header" not in now:
                now["header"] = True
                now["status"] = attributes.get("status")
            elif name == "rdf:RDF" and at == ["metadata", "RDF"] and "from" not in now:
                now["from"] = parser.CurrentByteIndex

    def end(name: str) -> None:
        at = path[now["depth"] :] if "depth" in now else []
        if at == ["metadata", "RDF"] and "from" in now and "to" not in now:
            first = _TAG.match(data, now["from"]).end()
            now["to"] = first if data[first - 2 : first] == b"/>" else _TAG.match(data, parser.CurrentByteIndex).end()
        elif "depth" in now and not at:
            rdf = str(data[now["from"] : now["to"]], "utf-8") if "to" in now else None
            texts = [now[k].strip() if k in now else None for k in ("identifier", "datestamp")]
            out.append((now.get("status"), *texts, rdf))
            now.clear()
        path.pop()

    def text(part: str) -> None:
        at = path[now["depth"] :] if "depth" in now else []
        if len(at) == 2 and at[0] == "header" and at[1] in ("identifier", "datestamp"):
            now[at[1]] = now.get(at[1], "") + part

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    for k in range(0, len(data), _PIECE):
        try:
            parser.Parse(data[k : k + _PIECE], k + _PIECE >= len(data))
        except expat.ExpatError:
            yield from out
            return
        yield from out
        out.clear()


def records(page: str | None) -> list[_Record]:
    """(status, identifier, datestamp, rdf_xml) of the records of a page; the description is as it was sent.

    Prefixes of the protocol's own elements do not matter.  Of a page that is not well-formed the records before the
    fault count.
    """
    return list(_pulled(page.encode())) if page else []


def _harvested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records in batches of their own size, whatever the pages'."""
    rows: list[_Record] = []
    size = 0
    names = ["status", "identifier", "datestamp", "rdf_xml"]
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=names)
    for batch in batches:
        for page in batch.column(0):
            for record in _pulled(page.as_buffer() if page.is_valid else b""):
                rows.append(record)
                size += len(record[3] or "")
                if len(rows) >= _RECORDS or size >= _PIECE:
                    yield batch_of()
                    rows, size = [], 0
    if rows:
        yield batch_of()


def harvested(pages: DataFrame) -> DataFrame:
    """(status, identifier, datestamp, rdf_xml) of the records of harvested pages of XML in ``value``."""
    return pages.select(F.col("value")).mapInArrow(_harvested, "status string, identifier string, datestamp string, rdf_xml string")
