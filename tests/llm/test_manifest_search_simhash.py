"""Manifest, lexical search and SimHash grouping against plain Python, on tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import lexical_search, merkle, simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, row long, fp long, block long, term string, unit int"
RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("aeioulnrsté") for _ in range(RNG.randint(2, 7))) for _ in range(150)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(min(r.choice(VOCAB) for _ in range(2)) for _ in range(n))


def rows():
    texts = [prose(60, i) for i in range(40)] + [None, "", " \n", "One", "two words", prose(4000, 99), prose(60, 3), prose(60, 3) + " more", prose(60, 5).upper(), "x,y;Z-1 é"]
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "t", 1, 2, 3, 4, "x", 5) for i, t in enumerate(texts)]
    return out + [out[3], out[3], (3, "another text", *out[3][2:]), (None, texts[7], *[None] * 10), (None, None, None, "s1", *[None] * 8)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def slow_tree(leaves):
    """(root, siblings by level of each leaf) by definition."""
    level, place, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, at in enumerate(place):
            run = level[at - at % 16 : at - at % 16 + 16]
            paths[leaf].append((run[: at % 16], run[at % 16 + 1 :]))
            place[leaf] = at // 16
        level = [digest(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def slow_manifest(table):
    trees = {}
    for doc_id, text, lang, source, n_chars, *_ in table:
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, digest(*map(field, (doc_id, source, lang, n_chars, text))), text, doc_id, lang, n_chars))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: slow_tree([leaf[2] for leaf in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    root, crown = slow_tree([made[s][0] for s in order])
    out = []
    for s, above in zip(order, crown, strict=True):
        for (_, _, leaf, text, doc_id, lang, n_chars), own in zip(sorted(trees[s], key=lambda x: x[:3]), made[s][1], strict=True):
            path = own + above
            start = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                low = text.translate({c: c + 32 for c in range(65, 91)})
                start = digest(*map(field, (doc_id, s, lang, n_chars, low)))
            for left, right in path:
                start = digest(*left, start, *right)
            out.append((doc_id, leaf, made[s][0], root, digest(*(x for left, right in path for x in left + right)), start, start == root))
    return out


def manifest_rows(docs):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", merkle.CAPITALS, merkle.SMALL))
    proofs = merkle.build(docs, tampered).proofs()
    siblings = F.array_join(F.transform(F.arrays_zip("before", "after"), lambda r: F.concat(r["before"], r["after"])), "")
    end = merkle.folded(F.coalesce("forged", "leaf"), F.col("before"), F.col("after"))
    return [tuple(r) for r in proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), end, end == F.col("root")).collect()]


def test_manifest_against_brute_force(docs, empty):
    assert sorted(manifest_rows(docs), key=str) == sorted(slow_manifest(rows()), key=str)
    assert manifest_rows(empty) == [] and merkle.build(empty).root().count() == 0


def test_manifest_of_several_kept_levels(spark):
    table = [(i, f"Text {i}" if i % 3 else f"text {i}", None, "hot", i) for i in range(4099)] + [(i, "t", "x", f"s{i}", 1) for i in range(5000, 5020)] + [(9000 + i, "T", None, "mid", 1) for i in range(18)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    manifest = merkle.build(docs)
    assert [x.count() for x in manifest.sources] == [len(table), 2 + 20 + 1, 22]
    assert {r.source: r.n_rows for r in manifest.subroots().collect()}["hot"] == 4099
    assert sorted(manifest_rows(docs), key=str) == sorted(slow_manifest(table), key=str)


@pytest.mark.parametrize("n", [1, 2])
def test_manifest_of_single_leaves(spark, n):
    table = [(i, "A b", None, f"s{i}", 3) for i in range(n)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(manifest_rows(docs), key=str) == sorted(slow_manifest(table), key=str)


# search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow_search(table, items, k):
    docs = [(d[0], terms(d[1])) for d in table if terms(d[1])]
    n_docs, total = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for doc_id, t in docs:
            m = 50 + (50 * len(t) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 20 * m)) for x in own if x in df)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return out


def item_rows():
    return [(1, prose(30, 3)), (2, prose(25, 70)), (3, ""), (4, None), (None, prose(9, 1)), (5, "nowhere qqqq"), (6, "X;y é"), (7, prose(300, 8)), (8, VOCAB[0]), (8, VOCAB[1] + " " + VOCAB[2])]


@pytest.mark.parametrize("size, items_at_once, k", [(lexical_search.BLOCK_BYTES, 256, 50), (900, 3, 50), (900, 2, 4)])
def test_search_against_brute_force(spark, docs, monkeypatch, size, items_at_once, k):
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", items_at_once)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", size)
    few = spark.createDataFrame(item_rows(), "item_id long, text string")
    index = lexical_search.build_index(docs if size > 900 else docs.repartition(12))
    assert size > 900 or index.n_blocks >= 8
    got = [tuple(r) for r in lexical_search.search(index, few, k).collect()]
    assert sorted(got, key=str) == sorted(slow_search(rows(), item_rows(), k), key=str)


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(item_rows(), "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(empty), items).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs), items.limit(0)).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = prose(500, 1).encode()
    whole = lexical_search.term_counts(text)
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    assert lexical_search.term_counts(text) == whole


def test_pair_bounds_skip_postings():
    """Documents each have one of two good terms, none both: with the pair's list the search stops earlier, with the same answer."""
    import pyarrow as pa

    n = 2000
    of = {"a": np.arange(0, n, 2), "b": np.arange(1, n, 2), "common": np.arange(n)}
    held = [{"item_id": 1, "unit": 0}], [{"item_id": 1, "unit": 0}], [{"item_id": 1, "unit": 1}]
    tfs = {t: 1 + (d % 37 == 0) * 3 for t, d in of.items()}
    lists = pa.table({"term": list(of), "w": [5000, 5000, 300], "held": list(held), "docs": [d.astype(np.int32).tobytes() for d in of.values()], "tfs": [tfs[t].astype(np.int32).tobytes() for t in of]})
    block = lexical_search.Block(lists, np.full(n, 20, np.int32).tobytes(), n, 20 * n)
    assert block.joint("a", "b") == (0, 0) and block.joint("a", "common")[0] == n // 2
    want = block.gain["common"].copy()
    want[of["a"]] += block.gain["a"]
    want[of["b"]] += block.gain["b"]
    docs, score, read = block.best(1, 10, 1, {})
    assert (np.sort(want)[-10:] == np.sort(score)[-10:]).all() and (want[docs] == score).all()
    top = int(np.sort(want)[-10])
    docs, score, read = block.best(1, 10, top, {})
    assert (np.sort(want)[-10:] == np.sort(score)[-10:]).all() and read < sum(map(len, of.values()))


# SimHash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(docs, empty):
    table = rows()
    fp = [slow_fingerprint(r[1]) for r in table]
    group = slow_groups(range(len(table)), [(i, j) for i in range(len(table)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    want = []
    for i, r in enumerate(table):
        ids = [table[j][0] for j in group if group[j] == group[i] and table[j][0] is not None]
        want.append((r[0], f"{fp[i]:016x}", min(ids, default=None)))
    assert sorted((tuple(r) for r in simhash_dedup.near_duplicates(docs).collect()), key=str) == sorted(want, key=str)
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = pa.array([prose(300, 1), None, prose(2, 2), prose(50, 3), "", prose(700, 4)])
    want = [slow_fingerprint(t) for t in texts.to_pylist()]
    assert simhash_dedup.fingerprints(texts).tolist() == want
    monkeypatch.setattr(simhash_dedup, "BLOCK", 13)
    assert simhash_dedup.fingerprints(texts).tolist() == want


@pytest.mark.parametrize("parts, ball", [(4, 1057), (4, 15), (3, 40), (2, 8)])
def test_links_connect_what_is_close(spark, parts, ball):
    r = np.random.default_rng(parts * 100 + ball)
    found = [int(x) for x in r.integers(0, 2**63, 300)]
    for center in [0, *found[:8]]:  # crowds, some bits of which never change
        for _ in range(90):
            x = center
            for b in r.integers(0, 64 if center else 20, r.integers(0, 5)):
                x ^= 1 << int(b)
            found.append(x)
    fp = np.unique(np.array(found, np.uint64))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    signed = fp.view(np.int64).tolist()
    want = slow_groups(signed, [(signed[i], signed[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    frame = spark.createDataFrame(pd.DataFrame({"fp": signed})).repartition(3)
    got = simhash_dedup.links(frame, len(fp), parts, ball).toPandas()
    apart = np.bitwise_count((got["a"].to_numpy() ^ got["b"].to_numpy()).view(np.uint64))
    assert apart.min() >= 1 and apart.max() <= 3
    assert slow_groups(signed, zip(got["a"].tolist(), got["b"].tolist(), strict=True)) == want


def test_thresholds_cost_least():
    r = np.random.default_rng(1)
    candidates = np.cumsum(r.integers(1, 500, (40, 3, 4)), axis=2).astype(float)
    candidates[:, :, 0] = 0
    keys = np.zeros((3, 4))
    chosen, cost = simhash_dedup.thresholds(candidates, keys)
    assert (chosen.sum(axis=1) == 4).all()
    for i in range(40):
        every = [candidates[i, 0, a] + candidates[i, 1, b] + candidates[i, 2, 4 - a - b] for a in range(4) for b in range(4) if 0 <= 4 - a - b <= 3]
        assert cost[i] == min(every)


def test_bits_that_go_together_share_a_part():
    together = np.eye(64)
    for a, b in ((3, 60), (17, 18), (60, 41)):
        together[a, b] = together[b, a] = 0.9
    layout = simhash_dedup.grouped_bits(together, 4)
    assert sorted(b for part in layout for b in part) == list(range(64)) and {len(p) for p in layout} == {16}
    assert any({3, 60, 41} <= set(part) for part in layout) and any({17, 18} <= set(part) for part in layout)
    assert [simhash_dedup.parts_for(n) for n in (1000, 10**8, 10**10)] == [4, 3, 2]
