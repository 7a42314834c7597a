"""Interpolated modified Kneser-Ney language model (operator 8): counted in Spark, memory-mapped by workers.

A bigram model over words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and one end token a text.
Counting runs in two shuffles whose rows are *blobs*: each task sorts and merges the bigrams of its
texts first, cuts them by hash range into as many pieces as there are buckets, and a bucket's
reducer merges sorted arrays.  Frequent words are contexts of many bigrams; the buckets go by the
hash of the bigram, not of its context, so no word makes a bucket large.

The model is a folder of flat files below the shared folder, two for each bucket:

* ``bigrams-<k>``  directory (uint32), lower 32 hash bits (uint32, sorted within a directory slot), counts (uint8);
* ``words-<k>``    48-bit hashes (uint64, sorted), then arrays of uint32, or uint64 where a count needs it: count,
  continuation count, bigram types that begin with the word and were seen once, twice, three times or more.

Probabilities: p(w|u) = max(c(uw) - D(c(uw)), 0)/c(u) + g(u) p1(w), where p1 is the same over
continuation counts, interpolated with 1/(V+1).  All counts cover all training texts.

Definedness: a null or empty text is the end token alone; a word never seen has p1 from the uniform
part; with no training text at all every score is that of the uniform distribution over V+1 = 1
tokens, 0.  Very long texts are counted and scored whole; nothing is ordered, so there are no ties; rows that repeat an id or
a text count and are scored each; null ids count as the empty text where rows are held out; other columns are ignored,
whatever their names; an empty table gives no rows.  Files are written under a temporary name and renamed, so a task that runs twice is harmless.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curio.llm import common

U64 = np.uint64
END, BEGIN = U64(1), U64(2)  # hashes of words are 3 or more
_WORD_BITS = U64((1 << 48) - 1)
_C = U64(0xD6E8FEB86659FD93)
COLUMNS = ("count", "continuations", "once", "twice", "more")


def token_stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the token before each, n+1 offsets of the rows): 48-bit word hashes, with an end token a row."""
    words, words_at = common.word_hashes(data, at)
    offsets = words_at + np.arange(len(at))
    tokens = np.full(int(offsets[-1]), END, U64)
    body = np.ones(len(tokens), bool)
    body[offsets[1:] - 1] = False
    tokens[body] = np.maximum(words & _WORD_BITS, U64(3))
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets[:-1]] = BEGIN
    return tokens, before, offsets


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return common.mix(u * _C + v)


def word_place(words: np.ndarray) -> np.ndarray:
    """A 64-bit value to find a word's bucket by."""
    return common.mix(words)


def _merge(u: np.ndarray, v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, u, v, count) in the order of the hash."""
    h = pair_hash(u, v)
    order = np.argsort(h)
    h, u, v, c = h[order], u[order], v[order], c[order]
    at = common.runs(h)
    return h[at[:-1]], u[at[:-1]], v[at[:-1]], np.add.reduceat(c, at[:-1]) if len(h) else c


def _six(x: np.ndarray) -> bytes:
    """48-bit values in six bytes each, byte by byte plane."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return out.view("<u8").ravel()


def _fs(folder: str):
    """pyarrow's filesystem and path of a shared folder."""
    from pyarrow import fs

    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _store(folder: str, name: str, parts: list[np.ndarray]) -> None:
    import uuid

    where, path = _fs(folder)
    where.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(temporary) as out:
        for x in parts:
            out.write(np.ascontiguousarray(x))
    where.move(temporary, f"{path}/{name}")


def _load(folder: str, name: str) -> np.ndarray:
    """The file's bytes, mapped into memory where the shared folder is a mounted one."""
    from pyarrow import fs

    where, path = _fs(folder)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", np.uint8, "r")
    with where.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), np.uint8)


def train(docs: DataFrame, folder: str, buckets: int | None = None, flush: int = 1_500_000) -> dict:
    """Count the bigrams of ``docs.text`` and write the model to ``folder``; returns its constants."""
    spark = docs.sparkSession
    n = buckets or common.shuffle_parts(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def pieces() -> pa.RecordBatch:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            h, u, v, c = _merge(u, v, np.ones(len(u), np.int64))
            at = common.by_bucket(common.bucket_of(h, n), n)
            some = np.flatnonzero(np.diff(at))
            # within one flush four bytes hold any count
            blob = [(_six(u[a:b]), _six(v[a:b]), c[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for a, b in zip(at[some], at[some + 1], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array([x[k] for x in blob], pa.binary()) for k in range(3))], names=["bucket", "u", "v", "c"])

        waiting = 0
        for _, data, at in common.slices(batches):
            tokens, before, _ = token_stream(data, at)
            held.append((before, tokens))
            waiting += len(tokens)
            if waiting >= flush:
                yield pieces()
                held, waiting = [], 0
        if waiting:
            yield pieces()

    def bigrams(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        u = np.concatenate([_from_six(x) for x in rows["u"]])
        v = np.concatenate([_from_six(x) for x in rows["v"]])
        c = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel() for x in rows["c"]]).astype(np.int64)
        del rows
        h, u, v, c = _merge(u, v, c)
        low, directory, order = hash_file(h)
        # a count of 255 or more is stored as 255 and listed with its hash after the arrays
        big = np.flatnonzero(c >= 255)
        _store(folder, f"bigrams-{key[0]}", [np.array([len(h), len(directory), len(big)], "<u8"), h[big], c[big].astype("<u8"), directory, low, np.minimum(c, 255).astype(np.uint8)[order]])
        # what the words of this bucket's bigrams add up to; the last row has the counts of counts
        order = np.argsort(u)
        us, cs = u[order], c[order]
        at = common.runs(us)[:-1]
        begin = [us[at], *(np.add.reduceat(x.astype(np.int64), at) for x in (cs == 1, cs == 2, cs >= 3))]
        order = np.argsort(v)
        vs, cs = v[order], c[order]
        at = common.runs(vs)
        end = [vs[at[:-1]], np.add.reduceat(cs, at[:-1]), np.diff(at)]
        words = np.union1d(begin[0], end[0])
        table = np.zeros((len(words), 5), np.int64)
        table[np.searchsorted(words, end[0]), 0:2] = np.column_stack(end[1:])
        table[np.searchsorted(words, begin[0]), 2:5] = np.column_stack(begin[1:])
        place = common.bucket_of(word_place(words), n)
        order = np.argsort(place, kind="stable")
        words, table, place = words[order], table[order], place[order]
        at = common.by_bucket(place, n)
        out = [(int(k), _six(words[at[k] : at[k + 1]]), _table_bytes(table[at[k] : at[k + 1]])) for k in np.flatnonzero(np.diff(at))]
        out.append((-1, b"", np.array([(c == k).sum() for k in (1, 2, 3, 4)], "<i8").tobytes()))
        return pd.DataFrame(out, columns=["bucket", "words", "counts"])

    def words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w = np.concatenate([_from_six(x) for x in rows["words"]])
        table = np.concatenate([_from_table(x) for x in rows["counts"]])
        order = np.argsort(w, kind="stable")
        at = common.runs(w[order])[:-1]
        w, table = w[order][at], np.add.reduceat(table[order], at, axis=0)
        _store(folder, f"words-{key[0]}", _word_arrays(w, table))
        seen = table[:, 0] > 0
        return pd.DataFrame([(int(seen.sum()), int(table[:, 0].sum()), int(table[:, 1].sum()), *(int((table[:, 1] == k).sum()) for k in (1, 2, 3, 4)), int((table[:, 1] >= 1).sum()))], columns=["v", "n", "types", "k1", "k2", "k3", "k4", "some"])

    pieces = docs.select("text").mapInArrow(count, "bucket int, u binary, v binary, c binary")
    parts = common.cut(pieces.groupBy("bucket").applyInPandas(bigrams, "bucket int, words binary, counts binary"), "lm-words")
    kept = parts.where("bucket >= 0").groupBy("bucket").applyInPandas(words, "v long, n long, types long, k1 long, k2 long, k3 long, k4 long, some long")
    total = kept.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in kept.columns)).first().asDict()
    counts = np.sum([np.zeros(4, np.int64), *(np.frombuffer(bytes(r["counts"]), "<i8") for r in parts.where("bucket < 0").select("counts").collect())], axis=0)  # a row a bucket
    found = parts.where("bucket >= 0").select("bucket").distinct().count()
    model = {"folder": folder, "buckets": n, "empty": found == 0, "V": total["v"], "N": total["n"], "types": total["types"], "D": discounts(counts), "D1": discounts(np.array([total[f"k{k}"] for k in (1, 2, 3, 4)])), "classes": [total["k1"], total["k2"], total["some"] - total["k1"] - total["k2"]]}
    return model


def discounts(n: np.ndarray) -> list[float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams seen 1 to 4 times; 0.5, 1, 1.5 where those lack."""
    n1, n2, n3, n4 = (int(x) for x in n)
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [float(min(max(d, 0.05), k - 0.05)) for k, d in enumerate(found, 1)]


def _width(table: np.ndarray) -> int:
    """Bytes that the largest count needs, 4 or 8."""
    return 4 if table.max(initial=0) < 1 << 32 else 8


def _table_bytes(table: np.ndarray) -> bytes:
    """Planes of the counts' bytes, after their width."""
    width = _width(table)
    return bytes([width]) + np.ascontiguousarray(table.astype(f"<u{width}").view(np.uint8).reshape(-1, len(COLUMNS) * width).T).tobytes()


def _from_table(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(len(COLUMNS) * width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").astype(np.int64)


def _word_arrays(w: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """What a file of words holds: its length and the width of its counts, the words, a column of counts after another."""
    width = _width(table)
    return [np.array([len(w), width], "<u8"), w.astype("<u8"), *(table[:, k].astype(f"<u{width}") for k in range(len(COLUMNS)))]


def hash_file(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower 32 bits in order, directory, the order) of sorted hashes: slot s of the directory holds where hashes of slot s begin.

    Within a bucket the hashes are spread evenly over its range, so a slot holds about four.
    """
    span = _span(len(h))
    slot = _slot(h, span)
    order = np.lexsort((h & U64(0xFFFFFFFF), slot))
    return (h & U64(0xFFFFFFFF)).astype("<u4")[order], np.searchsorted(slot[order], np.arange(span + 1)).astype("<u4"), order


def _span(n: int) -> int:
    return max(1, n // 4)


def _slot(h: np.ndarray, span: int) -> np.ndarray:
    """By bits of a second scrambling, for the first ones are alike within a bucket."""
    return (((common.mix(h) >> U64(32)) * U64(span)) >> U64(32)).astype(np.int64)


class Model:
    """Look-ups in the files of a model, many at a time; files are mapped when first needed."""

    def __init__(self, constants: dict):
        self.m = constants
        self.files: dict = {}

    def _bigram_file(self, k: int):
        if ("b", k) not in self.files:
            raw = _load(self.m["folder"], f"bigrams-{k}")
            n, slots, big = (int(x) for x in raw[:24].view("<u8"))
            at = 24
            parts = []
            for size, kind in ((8 * big, "<u8"), (8 * big, "<u8"), (4 * slots, "<u4"), (4 * n, "<u4"), (n, np.uint8)):
                parts.append(raw[at : at + size].view(kind))
                at += size
            self.files["b", k] = parts
        return self.files["b", k]

    def _word_file(self, k: int):
        if ("w", k) not in self.files:
            raw = _load(self.m["folder"], f"words-{k}")
            n, width = (int(x) for x in raw[:16].view("<u8"))
            at = 16 + 8 * n
            self.files["w", k] = [raw[16:at].view("<u8"), *(raw[at + width * n * j : at + width * n * (j + 1)].view(f"<u{width}") for j in range(len(COLUMNS)))]
        return self.files["w", k]

    def bigram_counts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        h, which = np.unique(pair_hash(u, v), return_inverse=True)
        out = np.zeros(len(h), np.int64)
        at = common.by_bucket(common.bucket_of(h, self.m["buckets"]), self.m["buckets"])
        for k in np.flatnonzero(np.diff(at)):
            try:
                big, big_count, directory, low, count = self._bigram_file(int(k))
            except FileNotFoundError:
                continue
            q = h[at[k] : at[k + 1]]
            slot = _slot(q, len(directory) - 1)
            place, end = directory[slot].astype(np.int64), directory[slot + 1].astype(np.int64)
            want = (q & U64(0xFFFFFFFF)).astype(np.uint32)
            found = np.zeros(len(q), np.int64)
            left = np.flatnonzero(place < end)
            while len(left):
                hit = low[place[left]] == want[left]
                found[left[hit]] = count[place[left[hit]]]
                left = left[~hit]
                place[left] += 1
                left = left[place[left] < end[left]]
            if len(big) and (full := np.flatnonzero(found == 255)).size:
                found[full] = big_count[np.minimum(np.searchsorted(big, q[full]), len(big) - 1)]
            out[at[k] : at[k + 1]] = found
        return out[which]

    def word_counts(self, w: np.ndarray) -> np.ndarray:
        """A row of COLUMNS for each word."""
        place, which = np.unique(word_place(w), return_inverse=True)
        word = np.zeros(len(place), U64)
        word[which] = w
        out = np.zeros((len(place), 5), np.int64)
        at = common.by_bucket(common.bucket_of(place, self.m["buckets"]), self.m["buckets"])
        for k in np.flatnonzero(np.diff(at)):
            try:
                keys, *columns = self._word_file(int(k))
            except FileNotFoundError:
                continue
            q = word[at[k] : at[k + 1]]
            i = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
            hit = np.flatnonzero(keys[i] == q)
            out[at[k] + hit] = np.column_stack([c[i[hit]] for c in columns])
        return out[which]

    def score(self, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of each token."""
        m = self.m
        if m["empty"]:
            return np.zeros(len(tokens)), np.zeros(len(tokens), np.int64)
        both, which = np.unique(np.concatenate((tokens, before)), return_inverse=True)
        table = self.word_counts(both)
        t, b = which[: len(tokens)], which[len(tokens) :]
        d, d1 = np.array([0.0, *m["D"]]), np.array([0.0, *m["D1"]])
        k = table[:, 1]
        p1 = np.maximum(k - d1[np.minimum(k, 3)], 0) / m["types"] + (d1[1:] @ np.array(m["classes"])) / m["types"] / (m["V"] + 1)
        # a context's tokens: as often as the word itself, or as often as texts end for their begin
        ends = table[np.searchsorted(both, END), 0] if END in both else self.word_counts(np.array([END]))[0, 0]
        context = np.where(both == BEGIN, ends, table[:, 0]).astype(float)
        left = table[:, 2:5] @ d[1:]
        some = context > 0
        g = np.where(some, left / np.where(some, context, 1), 1.0)
        c = self.bigram_counts(before, tokens)
        p = np.where(some[b], np.maximum(c - d[np.minimum(c, 3)], 0) / np.where(some, context, 1)[b], 0.0) + g[b] * p1[t]
        return np.log10(p), table[t, 0]


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """One row a text: the columns ``keep``, n_tokens, n_known, train_tokens, base_score, score and perplexity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, name = common.process_cache(), json.dumps(model)
        if cache.get("lm", ("",))[0] != name:
            cache["lm"] = (name, Model(model))  # one at a time
        lm = cache["lm"][1]
        for part, data, at in common.slices(batches):
            tokens, before, offsets = token_stream(data, at)
            logs, counts = lm.score(tokens, before)
            base = np.log10((counts + 0.5) / (model["N"] + 0.5 * (model["V"] + 1)))
            sums = [np.add.reduceat(x, offsets[:-1]) for x in ((counts > 0).astype(np.int64), base, logs)]
            sizes = np.diff(offsets)
            out = [part.column(part.schema.get_field_index(c)) for c in keep]
            out += [pa.array(sizes), pa.array(sums[0]), pa.array(np.full(len(sizes), model["N"], np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(10.0 ** np.minimum(300, -sums[2] / sizes))]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.select(*keep, "text").mapInArrow(rows, ", ".join([*fields, "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"]))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").withColumn("held_out", common.remainder("doc_id", 5) == 1)
    model = train(docs.where("not held_out"), common.shared_folder(spark, "kneser-ney"))
    return score(docs, model)
