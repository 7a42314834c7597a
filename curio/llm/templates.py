"""Main text of web pages by equivalence classes of template tokens (operator 12).

Pages of one host are made from a template.  Its tokens are tags at their place in the page and whole blocks of text.

1. *Occurrence vectors.*  How often a token occurs on each page of its host is summed up to one commutative hash: a
   task adds up the tokens of its pages, and what is shuffled is a row for each token, host and task, never a page.
   Tokens of a host with one vector, on at least ``SHARE`` of its pages, form an equivalence class.
2. *Valid classes.*  A second pass over the pages counts, for each class, pages on which its tokens do not keep
   their order, and the slots (the gaps between consecutive tokens of a class) of other classes in which it occurs.
   A class out of order is dropped; one that always occurs within one slot of another is nested in that slot.
   The same pass sums up the text that each container holds over all pages of the host.
3. *Roles of slots.*  A slot is main text where its enclosing element is an article; if the template has none, where
   it belongs to the container with the most text that is neither linked nor the same on all pages.
4. *Extraction.*  A block belongs to the innermost slot around it.  Blocks of main slots stay, unless an element
   within the slot that the template does not have (an advert, comments) says otherwise.  Blocks that are template
   tokens themselves go, but not inside an article: a host may repeat whole articles.

Pages without a template (no host, or hosts of fewer than ``PAGES`` pages), and pages on which no main slot has text, are read by
the same rules for themselves: articles, else what is named content, else the container with the most text.

Definedness: null and empty pages have the empty text and no characters; a null url is no host; pages of any length
are read whole, in one pass each; repeated rows, null and repeated ids are rows of their own; an unclosed element ends
with the one around it; extra columns are ignored; an empty table gives no rows.  Blocks keep the page's order, so there
are no ties.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import common, html

#: Least pages of a host with a template, and the share of them on which a template's token occurs.
PAGES, SHARE = 3, 0.2
#: Least tokens of a class.
LEAST = 2
#: Bytes of templates that every task is given; beyond, they are joined with the pages.
TEMPLATE_BYTES = 32_000_000
#: Of a container's text, how much of the best one's it must have to be main text as well.
ALSO = 0.5


def host_of(url: str):
    """The host of a url, lower-cased, without user and port; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, html.Page]]:
    for batch in batches:
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            yield host, html.parse(text.as_py())


# ---- 1. classes

_TOKEN_SQL = "host string, token long, place string, pages long, total long, low long, high long, first long"
_TOKEN = pa.schema([("host", pa.string()), ("token", pa.int64()), ("place", pa.string()), ("pages", pa.int64()), ("total", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("first", pa.int64())])
_HELD = 200_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each host and token of the task; token 0 counts the pages.  ``place`` encloses what follows; a tab before it marks a block of text."""
    held: dict[tuple[str, int], list] = {}
    number = 0
    from pyspark import TaskContext

    context = TaskContext.get()
    seed = context.partitionId() if context else 0

    def out() -> Iterator[pa.RecordBatch]:
        keys = list(held)
        columns = [[k[0] for k in keys], [_signed(k[1]) for k in keys], *([held[k][c] for k in keys] for c in range(6))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TOKEN, strict=True)], schema=_TOKEN)
        held.clear()

    for host, page in _rows(batches):
        number += 1
        if not host:
            continue
        own = common.mix(np.array([seed * (1 << 40) + number], common.U64))
        seen: dict[int, list[int]] = {}
        for at, token in enumerate(page.tokens):
            if (s := seen.get(token)) is None:
                seen[token] = [1, at]
            else:
                s[0] += 1
        blocks = {b.at for b in page.blocks}
        count = np.fromiter((s[0] for s in seen.values()), common.U64, len(seen))
        vector = common.mix(own ^ (count * common.U64(common.BASE)))
        for (token, (n, at)), low, high in zip(seen.items(), (vector & common.U64(0xFFFFFFFF)).tolist(), (vector >> common.U64(32)).tolist(), strict=True):
            kept = held.get((host, token))
            if kept is None:
                place = page.places[at]
                held[host, token] = [("\t" if at in blocks else "") + place.labels, 1, n, low, high, at]
            else:
                kept[1] += 1
                kept[2] += n
                kept[3] += low
                kept[4] += high
                kept[5] += at
        of = held.setdefault((host, 0), [None, 0, 0, 0, 0, 0])
        of[1] += 1
        if len(held) > _HELD:
            yield from out()
    if held:
        yield from out()


def classes_of(pages: DataFrame) -> DataFrame:
    """(host, c, n, tokens): equivalence classes, numbered within their host, tokens in the order of the page; of a host of ``n`` pages."""
    tokens = pages.mapInArrow(_counted, _TOKEN_SQL).groupBy("host", "token").agg(F.max("place").alias("place"), *(F.sum(c).alias(c) for c in ("pages", "total", "low", "high", "first")))
    tokens = common.cut(tokens.where(F.col("pages") >= PAGES), "templates-tokens")
    n = tokens.where("token = 0").select("host", F.col("pages").alias("n"))
    often = tokens.where("token <> 0").join(n, "host").where(F.col("pages") >= F.col("n") * SHARE)
    grouped = often.groupBy("host", "n", "pages", "total", "low", "high").agg(F.sort_array(F.collect_list(F.struct("first", "token", "place"))).alias("tokens"))
    return grouped.where(F.size("tokens") >= LEAST).select("host", "n", F.xxhash64("pages", "total", "low", "high").alias("c"), "total", "tokens")


# ---- templates in tasks


class Template:
    """A host's classes as a task uses them: which class and position a token has."""

    __slots__ = ("of", "roles", "same", "widths")

    def __init__(self, packed: str):
        self.widths: list[int] = []
        self.of: dict[int, tuple[int, int]] = {}
        self.roles: list[list[bool]] = []
        self.same: set[int] = set()
        for k, (tokens, roles, same) in enumerate(json.loads(packed)):
            self.widths.append(len(tokens))
            self.roles.append(roles)
            self.of.update((t, (k, i)) for i, t in enumerate(tokens))
            self.same.update(same)

    def slots(self, page: html.Page) -> Iterator[tuple[html.Block, tuple[int, int] | None]]:
        """The blocks of a page that are not left out by their place, each with the innermost slot around it: (class, token before it).

        Tags open and close in pairs, so the last token of the template before a block begins that slot.
        """
        of, blocks = self.of, iter(page.blocks)
        b, slot = next(blocks, None), None
        for at, token in enumerate(page.tokens):
            if b is None:
                return
            if b.at == at:
                if b.place.role != html.OUT:
                    yield b, slot
                b = next(blocks, None)
            if (hit := of.get(_signed(token))) is not None:
                slot = hit


def _template(packed: str | None) -> Template | None:
    if packed is None:
        return None
    cache = common.process_cache().setdefault("templates", {})
    if len(cache) > 500:
        cache.clear()
    if packed not in cache:
        cache[packed] = Template(packed)
    return cache[packed]


def _with_templates(pages: DataFrame, templates: DataFrame, work, schema: str) -> DataFrame:
    """``work(rows, templates by host)`` over the pages; templates are given to all tasks if they are few enough, and joined otherwise."""
    size = templates.agg(F.coalesce(F.sum(F.length("packed") + F.length("host")), F.lit(0))).first()[0]
    if size <= TEMPLATE_BYTES:
        given = {r["host"]: r["packed"] for r in templates.collect()}
        return pages.mapInArrow(lambda b: work(((r, (given.get(r.column("host")[i].as_py()) for i in range(r.num_rows))) for r in b)), schema)
    return pages.join(templates, "host", "left").mapInArrow(lambda b: work((r, r.column("packed").to_pylist()) for r in b), schema)


# ---- 2. valid classes

_SEEN_SQL = "host string, c long, kind string, other long, slot int, n long, chars long, linked long"
_SEEN = pa.schema([("host", pa.string()), ("c", pa.int64()), ("kind", pa.string()), ("other", pa.int64()), ("slot", pa.int32()), ("n", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())])


def _positions(template: Template, tokens: list[int]) -> list[list[list[int]]]:
    """For each class the positions of each of its tokens on a page."""
    at: list[list[list[int]]] = [[[] for _ in range(n)] for n in template.widths]
    of = template.of
    for k, t in enumerate(tokens):
        if (hit := of.get(_signed(t))) is not None:
            at[hit[0]][hit[1]].append(k)
    return at


def _in_order(at: list[list[int]]) -> list[int] | None:
    """All positions of a class in a row, repetition after repetition; None if its tokens do not keep their order."""
    flat = [p for rep in zip(*at, strict=False) for p in rep]
    if len(flat) != sum(map(len, at)) or any(a >= b for a, b in zip(flat, flat[1:], strict=False)):
        return None
    return flat


def _checked(batches: Iterator) -> Iterator[pa.RecordBatch]:
    """What the pages say of the classes: disorder, the slots in which each occurs, and the text of slots."""
    seen: dict[tuple, list[int]] = {}
    for rows, packed in batches:
        for host, text, one in zip(rows.column("host").to_pylist(), rows.column("html"), packed, strict=True):
            if (template := _template(one)) is None:
                continue
            page = html.parse(text.as_py())
            found: list[tuple] = []
            at = [(_in_order(a), n) for a, n in zip(_positions(template, page.tokens), template.widths, strict=True)]
            for k, (flat, size) in enumerate(at):
                if flat is None:
                    found.append((k, "disorder", 0, 0, 1, 0, 0))
                elif flat:
                    reps = len(flat) // size
                    found.append((k, "occurs", 0, 0, reps, 0, 0))
                    for o, (around, width) in enumerate(at):
                        if o != k and around and len(around) // width <= reps:
                            for r in range(0, len(flat), size):
                                i = bisect_right(around, flat[r])
                                if i % width and bisect_right(around, flat[r + size - 1]) == i:
                                    found.append((k, "nests", o, (i - 1) % width, 1, 0, 0))
            for b, slot in template.slots(page):
                if slot is not None and _signed(page.tokens[b.at]) not in template.of:
                    found.append((slot[0], "text", b.place.role, slot[1], 1, len(b.text), b.linked))
            for c, kind, other, slot, *numbers in found:
                kept = seen.setdefault((host, c, kind, other, slot), [0, 0, 0])
                for i, n in enumerate(numbers):
                    kept[i] += n
    out = [(*key, *numbers) for key, numbers in seen.items()]
    for k in range(0, len(out), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 50_000], strict=True), _SEEN, strict=True)], schema=_SEEN)


def _packed(classes: pd.DataFrame) -> pd.DataFrame:
    """Classes of a host as every task gets them, before they are checked."""
    rows = sorted(zip(classes["total"], classes["c"], classes["tokens"], strict=True), key=lambda r: (r[0], -len(r[2]), r[1]))
    data = [([int(t["token"]) for t in tokens], [], []) for _, _, tokens in rows]
    places = [[t["place"] for t in tokens] for _, _, tokens in rows]
    return pd.DataFrame({"host": [classes["host"].iloc[0]], "packed": [json.dumps(data)], "places": [json.dumps(places)]})


def _main_containers(texts: dict[tuple[str, int], tuple[int, int]]) -> set[str]:
    """Containers of the main text, of {(labels, role): (chars, linked)} over all pages of a host or on one page."""
    if articles := {labels for (labels, role), (chars, _) in texts.items() if role == html.MAIN and chars}:
        return articles
    some = {labels: t for (labels, role), t in texts.items() if role == html.LIKE and t[0]} or {labels: t for (labels, _), t in texts.items()}
    worth = {labels: chars - 2 * linked for labels, (chars, linked) in some.items()}
    best = max(worth.values(), default=0)
    if best <= 0:
        return set()
    top = max(worth, key=lambda x: (worth[x], x))
    named = any(role == html.LIKE and t[0] for (_, role), t in texts.items())
    return {x for x in worth if x == top or x.startswith(f"{top}>") or (named and top.startswith(f"{x}>")) or worth[x] >= ALSO * best}


def _valid(kinds: dict[str, pd.DataFrame], classes: int) -> list[int]:
    """Classes that keep their order and are either outermost or nested: always in one slot of a class."""
    disorder = set(kinds["disorder"]["c"].tolist()) if "disorder" in kinds else set()
    occurs = dict(zip(kinds["occurs"]["c"], kinds["occurs"]["n"], strict=True)) if "occurs" in kinds else {}
    inside: dict[int, list[tuple[int, int]]] = defaultdict(list)
    if "nests" in kinds:
        for k, o, n in zip(*(kinds["nests"][c] for c in ("c", "other", "n")), strict=True):
            inside[k].append((o, n))
    found: set[int] = set()
    for k in range(classes):  # those of fewer occurrences come first, so what is around a class is settled before it
        if k in occurs and k not in disorder:
            around = [(o, n) for o, n in inside[k] if o in found]
            if not around or any(n == occurs[k] for _, n in around):
                found.add(k)
    return sorted(found)


def _slotted(packed: str, places: str, seen: pd.DataFrame) -> str:
    """The valid classes of a host, and whether each of their slots is main text."""
    data, where = json.loads(packed), json.loads(places)
    kinds = {kind: part for kind, part in seen.groupby("kind")}
    # what follows a block of text is enclosed by what encloses the block
    labels = [[p or "" for p in of] for of in where]
    texts: dict[tuple[str, int], tuple[int, int]] = {}
    if "text" in kinds:
        for k, i, role, chars, linked in zip(*(kinds["text"][c] for c in ("c", "slot", "other", "chars", "linked")), strict=True):
            key = html.container(labels[k][i]), int(role)
            before = texts.get(key, (0, 0))
            texts[key] = before[0] + int(chars), before[1] + int(linked)
    main = _main_containers(texts)
    article = any(role == html.MAIN and chars for (_, role), (chars, _) in texts.items())
    out = []
    for k in _valid(kinds, len(data)):
        tokens = data[k][0]
        same = [] if article else [t for t, p in zip(tokens, where[k], strict=True) if p.startswith("\t")]
        out.append((tokens, [_role(x.lstrip("\t"), main) for x in labels[k]], same))
    return json.dumps(out)


def _role(labels: str, main: set[str]) -> bool:
    """Whether text right below an element belongs to a main container: one of ``main``, or inside one."""
    while labels not in main:
        if not labels:
            return False
        labels = labels.rpartition(">")[0]
        if not labels:  # text outside of all elements is no container of theirs
            return False
    return True


def templates_of(pages: DataFrame) -> DataFrame:
    """(host, packed): the templates of hosts, from ``pages`` (host, html)."""
    classes = classes_of(pages)
    first = common.cut(classes.groupBy("host").applyInPandas(_packed, "host string, packed string, places string"), "templates-classes")
    seen = _with_templates(pages, first.select("host", "packed"), _checked, _SEEN_SQL)
    seen = seen.groupBy("host", "c", "kind", "other", "slot").agg(*(F.sum(x).alias(x) for x in ("n", "chars", "linked")))

    def built(template: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if not len(template):
            return pd.DataFrame({"host": [], "packed": []}).astype(str)
        return pd.DataFrame({"host": [template["host"].iloc[0]], "packed": [_slotted(template["packed"].iloc[0], template["places"].iloc[0], seen)]})

    return common.cut(first.groupBy("host").cogroup(seen.groupBy("host")).applyInPandas(built, "host string, packed string"), "templates")


# ---- 4. extraction


def main_text(page: html.Page, template: Template | None) -> str:
    """The text of the main slots of a page, by its host's template if that fits."""
    if template is not None:
        kept = [b.text for b, slot in template.slots(page) if slot is not None and template.roles[slot[0]][slot[1]] and _signed(page.tokens[b.at]) not in template.same]
        if kept:
            return " ".join(kept)
    return " ".join(_alone(page))


def _alone(page: html.Page) -> list[str]:
    """The main text of a page without a template."""
    texts: dict[tuple[str, int], list[int]] = {}
    for b in page.blocks:
        if b.place.role != html.OUT:
            kept = texts.setdefault((b.place.container.labels, b.place.role), [0, 0])
            kept[0] += len(b.text)
            kept[1] += b.linked
    main = _main_containers({key: (chars, linked) for key, (chars, linked) in texts.items()})
    return [b.text for b in page.blocks if b.place.role != html.OUT and _role(b.place.container.labels, main)]


def _extracted(columns: list[str], batches: Iterator) -> Iterator[pa.RecordBatch]:
    for rows, packed in batches:
        texts = [main_text(html.parse(text.as_py()), _template(one)) for text, one in zip(rows.column("html"), packed, strict=True)]
        for k in range(0, len(texts), 2_000):
            some = texts[k : k + 2_000]
            of = [rows.column(c).slice(k, len(some)) for c in columns]
            yield pa.RecordBatch.from_arrays([*of, pa.array(some, pa.string()), pa.array(map(len, some), pa.int64())], names=[*columns, "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    templates = templates_of(rows.select("host", "html"))
    return _with_templates(rows, templates, lambda b: _extracted(["page_id", "url"], b), f"page_id {kind}, url string, text string, n_chars long")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
