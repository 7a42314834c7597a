"""Numbered operators against brute force, and their defined results in odd cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curio.llm import common, decontam, jaccard, kn_lm, mixing, nn_descent, pii, quality, suffix_dedup, token_shards, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(7)
VOCABULARY = ["the", "of", "and", "été", "word"] + [f"w{i}" for i in range(200)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def table(spark, texts):
    """Documents with clashing extra columns."""
    rows = [(i, t, "en", "src", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "score", "source": "h"})


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (5, "A b c"), (None, "null id"), (6, "x" * 50_000), (7, "é ü 漢字 <|endoftext|>"), (8, "a b c")]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", lower(t)) if w]


# ---- 1


def naive_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out)


def test_pii_base_is_the_plain_patterns():
    rng = random.Random(1)
    alphabet = "ab.@-+ 0123456789()%_é\n"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert sorted(pii.detect(text)) == naive_base(text), text
    for text in ("4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "+44 20 7946 0958", "a@b@c.d", "a.b@c.d.e@f.g", "999.1.1.1"):
        assert sorted(pii.detect(text)) == naive_base(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to jane dot doe at example dot com today", "email", "jane dot doe at example dot com"),
        ("write to jane.doe [at] example [dot] com today", "email", "jane.doe [at] example [dot] com"),
        ("mail jane(at)example.com now", "email", "jane(at)example.com"),
        ("mail jаne@exаmple.com now", "email", "jаne@exаmple.com"),
        ("mail ｊａｎｅ＠example．com now", "email", "ｊａｎｅ＠example．com"),
        ("call plus four four two zero seven nine four six zero nine five eight please", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("host １９２.168.0.1 up", "ip", "１９２.168.0.1"),
        ("host 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"),
        ("ja​ne@example.com", "email", "ja​ne@example.com"),
        ("mail jane @ mail5 . example . com now", "email", "jane @ mail5 . example . com"),
        ("mail jane(a)example.com now", "email", "jane(a)example.com"),
        ("mail jane&#64;example.com now", "email", "jane&#64;example.com"),
        ("ruf plus vier neun drei null eins zwei drei vier fünf sechs an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
        ("tel +33 un deux trois quatre cinq six sept huit", "phone", "+33 un deux trois quatre cinq six sept huit"),
    ],
)
def test_pii_disguises(text, kind, part):
    base = pii.detect(text)
    assert (kind, text.index(part), text.index(part) + len(part)) in base + pii.disguised(text, base)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("call plus four 9 one 5 two 6 three 7 eight 1 now", "phone"),
        ("call plus four dash nine dash one dash five dash two dash six dash three dash seven dash eight now", "phone"),
        ("pay four 1 one 1 one 1 one 1 one 1 one 1 one 1 one 1 now", "card"),
        ("Four 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "card"),
    ],
)
def test_pii_mixed_runs(text, kind):
    assert kind in {k for k, _, _ in pii.disguised(text, pii.detect(text))}


def test_pii_gate_is_no_narrower_than_the_transducer():
    rng = random.Random(5)
    spoken = [*pii._WORDS, "ſix", "sİeben"]
    matched = 0
    for _ in range(5_000):
        run = rng.choice(["", "plus ", "(", "x ", "\n"])
        for _ in range(rng.randint(1, 5)):
            item = str(rng.randint(0, 9)) if rng.random() < 0.5 else rng.choice(spoken)
            run += rng.choice([str.lower, str.upper, str.title])(item) if "ſ" not in item else item
            run += rng.choice([" ", "-", ", ", ",", "--", " - "]) + rng.choice(["", "", "dash ", "hyphen-", "Dot ", "point,"])
        if pii._SPELLED.search(run):
            matched += 1
            assert pii._may_spell(run), run
    assert matched > 1_000


def test_pii_leaves_prose_alone():
    for text in ("we met at noon. two of one hundred at home", "look at this dot on the map", "one two three", "кот и дом, 12 мая", "one at two dot", "un six sept fois", "see @ home . it was", "(a) first. com"):
        assert pii.disguised(text, pii.detect(text)) == []


def test_pii_query(spark):
    docs = table(spark, [*ODD, (20, "a@b.cc and +49 30 1234567")])
    got = {r["doc_id"]: r for r in pii.digests(pii.find(docs)).collect()}
    assert got[20]["spans"] == "email:0:6,phone:11:25" and got[20]["n_email"] == 1
    assert got[20]["base_sha256"] == hashlib.sha256(got[20]["spans"].encode()).hexdigest()
    assert got[1]["spans"] == "" and got[1]["n_card"] == 0
    masked = pii.find(docs, masked=True).where("doc_id = 20").first()["masked"]
    assert masked == "<email> and <phone>"
    assert pii.digests(pii.find(docs.limit(0))).count() == 0


# ---- 2


def removed(docs):
    seen = collections.Counter()
    raw = [(d, (t or "").encode()) for d, t in docs]
    for _, b in raw:
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(b) > 0 and gone[0])
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [48, 2])
def test_suffix_dedup(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(2)
    line, short = prose(60, rng), prose(25, rng)
    docs = []
    for i in range(60):
        t = prose(rng.choice([5, 60, 120]), rng)
        t += short + prose(20, rng) if i % 3 == 0 else ""
        t += line if i % 4 == 0 else ""
        docs.append((i, t))
        if i % 6 == 0:
            docs.append((100 + i, t))
    docs += [(300, "ab" * 300), (301, None), (302, ""), (303, docs[2][1]), (303, docs[2][1]), (None, docs[5][1])]
    got = sorted((tuple(r) for r in suffix_dedup.remove(table(spark, docs).repartition(3)).collect()), key=str)
    assert [(*r[:5], bytes(r[5])) for r in got] == removed(docs)


def test_suffix_dedup_equal_rows_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    rng = random.Random(21)
    line = prose(45, rng)
    around = lambda: prose(60, rng) + line + prose(60, rng)
    equal = [(400 + i, around()) for i in range(8)]
    tasks = [[(i, around()) for i in range(k, k + 70)] + equal for k in (0, 100)]
    docs = table(spark, tasks[0]).coalesce(1).union(table(spark, tasks[1]).coalesce(1))
    got = sorted((tuple(r) for r in suffix_dedup.remove(docs).collect()), key=str)
    assert [(*r[:5], bytes(r[5])) for r in got] == removed([*tasks[0], *tasks[1]])


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove(table(spark, []), texts=False).count() == 0


# ---- 3


def test_nn_descent(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, 1, [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.15]) for i in range(300)]
    rows += [(400 + i, 2, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(100)]
    one = [float(np.float32(x)) for x in base]
    rows += [(600, 1, one), (601, 1, one), (602, None, one), (603, 1, None), (604, 1, [0.0] * 16), (605, 1, [float("nan")] * 16), (606, 1, [float("inf")] + one[1:]), (607, 1, []), (608, 1, one[:8]), (609, 3, one), (610, 1, [None, *one[1:]])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS node", "2 AS sim")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in nn_descent.near_duplicates(df).collect()}
    good = [i for i, (v, lab, e) in enumerate(rows) if lab is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = collections.defaultdict(set)
    for i in good:
        for j in good:
            if i != j and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                x, y = np.array(rows[i][2]), np.array(rows[j][2])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[i].add(j)
    for i, (v, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(rows[j][0] for j in seen)
        assert got[v] == (len(links[i]), least, v == least)
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def isolated(spark, n, pairs, rng, group=0):
    """n random vectors and, from id n, pairs at cosine 0.932 without other neighbours; a group of near ones at the end."""
    x = rng.normal(size=(n + pairs, 32))
    y = rng.normal(size=(pairs, 32))
    u = x[n:] / np.linalg.norm(x[n:], axis=1, keepdims=True)
    y -= (y * u).sum(axis=1, keepdims=True) * u
    y = 0.932 * u + math.sqrt(1 - 0.932**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    near = rng.normal(size=32) + rng.normal(size=(group, 32)) * 0.05
    rows = [(i, 1, v.tolist()) for i, v in enumerate(np.concatenate((x[:n], np.stack((u, y), axis=1).reshape(-1, 32), near)))]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def test_nn_descent_isolated_pairs(spark):
    df = isolated(spark, 12_000, 400, np.random.default_rng(2))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(df).collect()}
    found = sum(got[i] == got[i + 1] == (1, i) for i in range(12_000, 12_800, 2))
    assert found >= 397
    assert all(got[i] == (0, i) for i in range(12_000))


def test_nn_descent_finds_what_the_start_missed(spark, monkeypatch):
    """Hyperplanes too deep for the table, as a label of many millions has: pairs part at the start."""
    monkeypatch.setattr(nn_descent, "BLOCK", 64)
    monkeypatch.setattr(nn_descent, "LEAF", 16)
    rng = np.random.default_rng(12)
    near = rng.normal(size=(60, 1, 24)) + rng.normal(size=(60, 8, 24)) * 0.22  # groups of eight, most pairs linked
    rows = [(i, 1, v.tolist()) for i, v in enumerate(near.reshape(-1, 24))]
    rows += [(1000 + i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 24)))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    nodes = common.cut(nn_descent.nodes_of(df), "t")
    found = common.cut(nn_descent.start(nodes, common.cut(nn_descent.spaces_of(nodes), "t"), 0, 2), "t")
    graph = common.cut(nn_descent.best_of(found.where(f"sim < {nn_descent.JOINED}").selectExpr("*", "true AS new")), "t")
    comps = common.components(found.where(f"sim = {nn_descent.JOINED}").selectExpr("u a", "v b"))
    new = nn_descent.exact(nodes, nn_descent.descend(nn_descent.bytes_of(nodes), graph, comps).where(f"sim >= {nn_descent.THRESHOLD - nn_descent.MARGIN}"))
    assert new.count() > 0
    x = np.array([v for _, _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= nn_descent.THRESHOLD).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in nn_descent.near_duplicates(df).collect()}
    true = np.array([links[i] for i in range(480)])
    assert np.array([got[i] for i in range(480)]).sum() >= 0.99 * true.sum() and true.sum() > 500


def test_nn_descent_with_a_common_direction(spark):
    """All vectors are close to each other, as those of models with a strong common direction are, and a few pairs are closer."""
    rng = np.random.default_rng(9)
    n, dims = 6_000, 48
    base = rng.normal(size=dims)
    base *= math.sqrt(0.85) / np.linalg.norm(base)
    x = base + rng.normal(size=(n, dims)) * math.sqrt(0.15 / dims)
    x[n - 300 :] = x[:300] + rng.normal(size=(300, dims)) * math.sqrt(0.06 / dims)
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= nn_descent.THRESHOLD).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in nn_descent.near_duplicates(df).collect()}
    found, true = sum(min(got[i], links[i]) for i in range(n)), links.sum()
    assert true > 400 and found >= 0.98 * true and all(got[i] <= links[i] for i in range(n))


def test_nn_lists_are_longer_where_links_fill_them(spark):
    edges = [(1, 100 + i, 0.99 - i / 1000, True) for i in range(20)] + [(1, 200 + i, 0.5 - i / 100, True) for i in range(20)] + [(2, 100 + i, 0.8, True) for i in range(20)] + [(3, 100, 0.95, True)] + [(3, 200 + i, 0.5, True) for i in range(20)]
    got = collections.Counter(r["u"] for r in nn_descent.best_of(spark.createDataFrame(edges, "u long, v long, sim double, new boolean")).collect())
    assert got == {1: 2 * nn_descent.NEIGHBOURS, 2: nn_descent.NEIGHBOURS, 3: nn_descent.NEIGHBOURS}


def test_nn_audit_asks_more_until_links_are_seen(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "AUDIT", 5)
    nodes = common.cut(nn_descent.nodes_of(isolated(spark, 300, 3, np.random.default_rng(3))), "t")
    nothing = spark.createDataFrame([], "id long, component_id long")
    assert nn_descent.audit(nodes, nothing) == 0
    assert nn_descent.audit(common.cut(nn_descent.nodes_of(isolated(spark, 300, 0, np.random.default_rng(3))), "t"), nothing) is None


def test_nn_audit_of_nodes_not_links(spark):
    nodes = common.cut(nn_descent.nodes_of(isolated(spark, 0, 40, np.random.default_rng(3), 300)), "t")
    large = nodes.where("least >= 80").select("node", "least").collect()
    root = min(r["node"] for r in large)
    some = [(r["node"], root) for r in large]
    assert nn_descent.audit(nodes, spark.createDataFrame(some, "id long, component_id long")) == 0
    pairs = {r["least"]: r["node"] for r in nodes.where("least < 80").collect()}
    some += [(pairs[j], min(pairs[i], pairs[i + 1])) for i in range(0, 80, 2) for j in (i, i + 1)]
    assert nn_descent.audit(nodes, spark.createDataFrame(some, "id long, component_id long")) == 1


# ---- 4


def test_mixing_fits_targets(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        kind = i % 4
        t = prose(rng.randint(20, 60), rng)
        if kind == 1:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if kind == 2:
            t += " vile rotten" * 20
        texts.append((i, t))
        if i % 2 == 0 or kind == 1:
            labels.append((i, int(kind != 1), int(kind == 2)))
    docs = table(spark, [*texts, (1001, None), (1002, ""), (None, "no id")])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, lab).toPandas()
    assert len(got) == 403 and (got["rate"] >= 0).all()
    total = {d: (got[f"p_{d}"] * got["n_tokens"] * got["rate"]).sum() for d in mixing.DOMAINS}
    for d, w in mixing.TARGETS.items():
        assert abs(total[d] / sum(total.values()) - w) < 0.01
    members = got[["n_tokens", "p_clean", "p_low", "p_toxic"]].to_numpy(float)
    n, p, r = members[:, 0], members[:, 1:], np.ones(len(got))
    now = (n[:, None] * p).sum(axis=0)
    target = np.array([0.90, 0.06, 0.04]) * now[0] / 0.90
    for _ in range(200):  # the same descent, in numpy
        r = np.maximum(0, r - p @ ((((n * r)[:, None] * p).sum(axis=0) - target) / np.maximum(now, 1)))
    assert np.abs(r - got["rate"])[n > 0].max() < 0.05
    gaps = {r["domain"]: r for r in mixing.shares(mixing.mix(docs, lab)).collect()}
    assert all(abs(gaps[d]["by_rate"] - w) < 0.01 and abs(gaps[d]["by_copies"] - w) < 0.1 for d, w in mixing.TARGETS.items())
    again = mixing.resample(docs, lab)
    assert again.columns == docs.columns
    assert mixing.mix(docs.limit(0), lab).count() == 0
    assert mixing.mix(docs, lab.limit(0)).where("rate <> 1").count() == 0


# ---- 5


def components(docs):
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and 100 * both >= 80 * len(s | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(x for x in (least.get(top(i)), d, math.inf) if x is not None)
    return sorted(((d, len(sets[i]), least[top(i)] if least[top(i)] < math.inf else None) for i, (d, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("long_list, family_block, mark", [(48, 400_000, (1 << 64) - 1), (3, 200, 15)])
def test_jaccard(spark, long_list, family_block, mark, monkeypatch):
    """Also with long lists everywhere, families in many blocks, and fingerprints that many sets share."""
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", family_block)
    monkeypatch.setattr(jaccard, "HUB_GROUP", long_list)
    monkeypatch.setattr(jaccard, "DEALT_LIST", long_list + 9)
    monkeypatch.setattr(jaccard, "_MARK", np.uint64(mark))
    rng = random.Random(5)
    docs, line = [], prose(30, rng)
    for g in range(6):
        base = prose(rng.choice([8, 30, 60]), rng).split()
        base = line.split() + base[:12] if g % 2 else base
        for _ in range(rng.choice([2, 20])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(VOCABULARY)
            docs.append((1000 + len(docs), " ".join(t)))
    docs += [(900 + k, line + " " + prose(k % 7, rng)) for k in range(25)]
    docs += [(i, t) for i, t in ODD if i is not None]
    got = sorted((tuple(r) for r in jaccard.classes_of(table(spark, docs).repartition(3)).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == components(docs)


def test_word_counts_beyond_32_bits(tmp_path):
    w = np.array([5, 9, 11], np.uint64)
    for most in (7, (1 << 32) - 1, 1 << 32, 1 << 50):
        counts = np.arange(15, dtype=np.int64).reshape(3, 5)
        counts[1, 0] = most
        assert (kn_lm._from_table(kn_lm._table_bytes(counts)) == counts).all()
        order = np.argsort(kn_lm.word_place(w))  # any words of one bucket
        kn_lm._store(str(tmp_path), f"words-{most % 97}", kn_lm._word_arrays(w, counts))
        model = kn_lm.Model({"folder": str(tmp_path), "buckets": 1})
        (tmp_path / f"words-{most % 97}").rename(tmp_path / "words-0")
        assert (model.word_counts(w[order]) == counts[order]).all()
        (tmp_path / "words-0").unlink()


def test_jaccard_blocks_skip_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(200):
        size = rng.integers(2, 60, rng.integers(1, 5))
        which = np.repeat(np.arange(len(size)), size)
        n = rng.integers(5, 60, len(which))
        pos = rng.integers(0, n)
        order = np.lexsort((pos, n, which))
        n, pos, at = n[order], pos[order], np.concatenate(([0], np.cumsum(size)))
        got = {(int(i), int(j)) for x, y in jaccard.block_pairs(at, n, pos, chunk=100) for i, j in zip(x, y, strict=True)}
        i, j = np.triu_indices(len(n), 1)
        ok = (which[i] == which[j]) & jaccard._may_link(n[i], n[j], pos[i], pos[j])
        assert got == set(zip(i[ok].tolist(), j[ok].tolist(), strict=True))


def test_jaccard_odd(spark):
    got = {r["doc_id"]: r for r in jaccard.classes_of(table(spark, ODD)).collect()}
    assert got[1]["n_shingles"] == 0 and got[1]["component_id"] == 1
    assert got[8]["component_id"] == 5 and got[None]["component_id"] is None
    kept = jaccard.deduplicate(table(spark, ODD))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert jaccard.classes_of(table(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [0, 1_000])
def test_jaccard_deduplicate_by_row(spark, broadcast, monkeypatch):
    """Rows of a null or repeated id stay unless their own component has another row."""
    monkeypatch.setattr(jaccard, "BROADCAST_CLASSES", broadcast)
    rng = random.Random(17)
    texts = [prose(40, rng) for _ in range(36)]
    rows = [(None, t) for t in texts[:12]] + [(7, t) for t in texts[12:24]] + list(enumerate(texts[24:], 100))
    copies = [(None, texts[0] + " more"), (7, texts[12] + " more"), (7, texts[24] + " more"), (7, texts[12]), (None, texts[30]), (9, texts[1])]
    blanks = [(None, None), (7, " \n\t\x0b\x0c\r"), (7, ""), (7, ""), (50, "\u00a0")]
    got = [(r["doc_id"], r["text"]) for r in jaccard.deduplicate(table(spark, [*rows, *copies, *blanks]).repartition(3)).collect()]
    stay = {(d, t) for d, t in rows if t not in (texts[0], texts[1], texts[12], texts[24])} | {(9, texts[1]), (7, texts[24] + " more")}
    assert [x for x in got if x in stay] and stay <= set(got)
    rest = [x for x in got if x not in stay and x not in blanks]
    assert sorted(t.split(" more")[0] for _, t in rest) == sorted((texts[0], texts[12]))  # one of each pair that shares an id
    assert sorted(map(str, (x for x in got if x in blanks))) == sorted(map(str, blanks))
    assert len(got) == 36 + len(blanks)


# ---- 6


def test_token_shards_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_shards.default_tokenizer())
    rng = random.Random(6)
    alphabet = " \n\t'ab.é  1Z-​|<>"
    texts = [*ODD, (30, "foo<|endoftext|> bar"), *((100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))) for i in range(300))]
    rng.shuffle(texts)
    path = f"file://{tmp_path}/shards"
    token_shards.encode(table(spark, texts), path, token_shards.default_tokenizer(), parts=3, block_tokens=500)
    got = token_shards.decode(spark, path).orderBy("start").collect()
    ordered = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start = 0
    assert len(got) == len(ordered)
    for r, (d, t) in zip(got, ordered, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], list(r["ids"])) == (d, start, len(ids), ids)
        start += len(ids)
    crc = {r["start"]: r["ids_crc32"] for r in token_shards.digests(spark, path).collect()}
    assert all(crc[r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    empty = f"file://{tmp_path}/empty"
    token_shards.encode(table(spark, []), empty, token_shards.default_tokenizer())
    assert token_shards.digests(spark, empty).count() == 0


def test_wide_ranks():
    ids = np.random.default_rng(1).permutation(np.arange(70_001, dtype=np.uint32))
    assert (token_shards.unpack(*token_shards.pack(ids), len(ids)) == ids).all()


# ---- 7 and 9


def labelled(spark, mark):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(300):
        y = i % 3 == 0
        texts.append((i, mark(prose(rng.randint(10, 60), rng), y)))
        if i % 5:
            labels.append((i, int(y), int(y)))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int")
    return table(spark, [*texts, *((i and i + 5000, t) for i, t in ODD)]), lab, texts


@pytest.mark.parametrize("operator", ["quality", "toxicity"])
def test_classifiers(spark, operator):
    if operator == "quality":
        docs, labels, texts = labelled(spark, lambda t, y: t if y else " ".join(w + "%%%" for w in t.split()))
        model, predict, m, out = quality.fit(docs, labels), None, 3, 1
    else:
        docs, labels, texts = labelled(spark, lambda t, y: t + " vile " + t + " rotten" if y else t)
        model, predict, m, out = toxicity.fit(docs, labels), toxicity.predict, 4, 2
    rows = quality.score(docs, model, ("doc_id",), predict).collect()
    assert len(rows) == 300 + len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % m == out]
    assert np.mean([(score[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.9
    flipped = labels.selectExpr("doc_id", f"if(crc32(cast(doc_id as string)) % {m} = {out}, 1 - quality, quality) quality", f"if(crc32(cast(doc_id as string)) % {m} = {out}, 1 - toxic, toxic) toxic")
    again = (quality if operator == "quality" else toxicity).fit(docs, flipped)
    assert {r["doc_id"]: round(r["score"], 9) for r in quality.score(docs, again, ("doc_id",), predict).collect()} == {k: round(v, 9) for k, v in score.items()}
    none = (quality if operator == "quality" else toxicity).fit(docs, labels.limit(0))
    assert quality.score(docs, none, ("doc_id",), predict).first()["score"] == 0.5
    assert quality.score(docs.limit(0), model, ("doc_id",), predict).count() == 0


# ---- 8


def test_kneser_ney(spark):
    rng = random.Random(8)
    texts = [(i, prose(rng.randint(0, 80), rng)) for i in range(120)] + [(i and i + 500, t) for i, t in ODD]
    docs = table(spark, texts).withColumn("held_out", common.remainder("doc_id", 5) == 1)
    model = kn_lm.train(docs.where("not held_out"), common.shared_folder(spark, "kn"), flush=500)
    train = [["<end>" if w is None else w for w in [*words(t), None]] for i, t in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    unigrams = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter((u, w) for t in train for u, w in zip(["<s>", *t[:-1]], t, strict=True))
    spread = collections.Counter(w for _, w in pairs)
    d = [0, *kn_lm.discounts(np.array([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)]))]
    d1 = [0, *kn_lm.discounts(np.array([sum(c == k for c in spread.values()) for k in (1, 2, 3, 4)]))]
    total, left = collections.Counter(), collections.Counter()
    for (u, _), c in pairs.items():
        total[u] += c
        left[u] += d[min(c, 3)]
    n, v = sum(unigrams.values()), len(unigrams)

    def p(u, w):
        low = max(spread[w] - d1[min(spread[w], 3)], 0) / len(pairs) + sum(d1[min(c, 3)] for c in spread.values()) / len(pairs) / (v + 1)
        return low if not total[u] else max(pairs[u, w] - d[min(pairs[u, w], 3)], 0) / total[u] + left[u] / total[u] * low

    want = []
    for i, t in texts:
        toks = [*words(t), "<end>"]
        want.append((i, len(toks), sum(unigrams[w] > 0 for w in toks), n, sum(math.log10((unigrams[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks), sum(math.log10(p(u, w)) for u, w in zip(["<s>", *toks[:-1]], toks, strict=True))))
    got = kn_lm.score(docs, model).collect()
    key = lambda x: (str(x[0]), x[1], round(x[4], 6))
    for g, w in zip(sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-8 and abs(g[5] - w[5]) < 1e-8
    # probabilities of all tokens after a word add up to one with what is left for the unknown
    m = kn_lm.Model(model)
    vocabulary = sorted(unigrams)
    data = " ".join(x for x in vocabulary if x != "<end>").encode()
    tokens, _, _ = kn_lm.token_stream(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    for u in tokens[:5]:
        logs, _ = m.score(np.append(tokens, np.uint64(12345)), np.full(len(tokens) + 1, u))
        assert abs((10**logs).sum() - 1) < 1e-9
    nothing = kn_lm.train(docs.limit(0), common.shared_folder(spark, "kn"))
    assert kn_lm.score(docs, nothing).first()["score"] == 0.0
    assert kn_lm.score(docs.limit(0), model).count() == 0


# ---- 10


def contaminated(docs, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        if w and i is not None:
            k = min(10, len(w))
            for a in range(len(w) - k + 1):
                windows[tuple(w[a : a + k])].add(i)
    sizes = {len(x) for x in windows}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def test_clashing_columns(spark):
    """Columns with the names that operators use inside come through unharmed."""
    names = ["score", "row", "hit", "_row", "_hit", "_id", "id", "r", "copies", "_copy", "_rid", "rid", "class"]
    rows = [(i, f"the word of w{i} " * 12) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *(F.lit(n).alias(n) for n in names))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    for got in (decontam.decontaminate(docs, bench), decontam.remove_spans(docs, bench), mixing.resample(docs, labels), jaccard.deduplicate(docs), quality.score(docs, {"constant": 0.5}, tuple(docs.columns), into="score_").drop("score_")):
        assert got.columns == docs.columns and got.count() >= 1
        assert set(got.first().asDict().items()) >= {(n, n) for n in names}


def test_sample_is_bounded_in_documents(spark):
    docs = spark.range(100_000).select(F.when(F.col("id") < 50, F.col("id")).otherwise(7).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = common.labelled_sample(docs, labels.union(labels), "quality", 3, 1, 10).toPandas()
    assert len(got) == 20 and got["doc_id"].is_unique


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
    rng = random.Random(10)
    items = [(i, prose(rng.randint(1, 30), rng)) for i in range(12)] + [(50, None), (51, "..."), (None, "w1 w2"), (3, prose(12, rng))]
    docs = [(i, prose(30, rng)) for i in range(40)] + [(100 + (i or 0), prose(5, rng) + "! " + t.upper() + " -- " + prose(5, rng)) for i, t in items if t] + [(200, items[4][1]), (200, items[4][1])] + [x for x in ODD if x[0] is not None and x[0] != 4]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.report(table(spark, docs), bench).distinct().collect())
    assert got == sorted(set(contaminated(docs, items)))
    clean = decontam.decontaminate(table(spark, docs), bench)
    bad = {r[0] for r in got if r[5]}
    assert {r["doc_id"] for r in clean.collect()} == {x[0] for x in contaminated(docs, items) if not x[5]}
    spans = decontam.remove_spans(table(spark, docs), bench)
    assert {r[0] for r in decontam.report(spans, bench).where("n_hit > 9").collect()} <= bad
    assert decontam.report(table(spark, []), bench).count() == 0
    assert decontam.report(table(spark, docs), bench.limit(0)).where("contaminated").count() == 0


def test_pipeline_small(spark, tmp_path):
    """Each stage against its definition on the rows that it was given."""
    import corpus_pipeline as cp

    rng = random.Random(11)
    docs, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        t = prose(rng.randint(30, 60), rng)
        t = t if good else " ".join(w + "%%%" for w in t.split())
        docs.append((i, t, "en", "src", len(t)))
        labels.append((i, int(good), int(i % 8 == 1)))
    docs += [(1000 + i, docs[i][1] + " more", "en", "src", 0) for i in range(1, 40, 3)]
    items = [(1, " ".join(docs[5][1].split()[:14])), (2, prose(20, rng))]
    folder = str(tmp_path)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    given = spark.read.parquet(f"{folder}/documents.parquet")
    kept = common.cut(cp.keep_quality(spark, given, folder), "t")
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == given.columns and sum(i % 4 != 0 for i in ids if i < 1000) > 170 and sum(i % 4 == 0 for i in ids if i < 1000) < 8
    single = common.cut(cp.drop_near_duplicates(spark, kept, folder), "t")
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert {r["doc_id"] for r in single.collect()} == {d for d, _, c in components(rows) if d == c}
    clean = common.cut(cp.drop_benchmark(spark, single, folder), "t")
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _, _, _, _, hit in contaminated(rows, items) if not hit}
    mixed = common.cut(cp.mix_sources(spark, clean, folder), "t")
    assert mixed.columns == given.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    tokens = cp.write_tokens(spark, mixed, folder)
    assert tokens.count() == mixed.count()
    whole = cp.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, tokens.collect()))


def test_jaccard_families_of_many_short_texts_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAMILY_ROWS", 60)
    monkeypatch.setattr(jaccard, "OVERLAP_ROWS", 7)
    rng = random.Random(12)
    template = [f"t{k}" for k in range(30)]
    texts = []
    for i in range(400):
        own = rng.randrange(120)
        at = 5 + own % 20
        texts.append((i, " ".join([*template[:at], f"own{own}", f"more{i % 3}", *template[at:]])))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes_of(table(spark, texts)).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts for w in [t.split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in sets}
