"""The ten operators on a small table with nulls, empty and long texts, ties, repeated rows and extra columns."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import decontamination, language_id, minhash_dedup, mixing, quality_classifier, quality_rules, secret_scan, substring_dedup, textkernel, toxicity, url_filter, wordscores

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, bucket int, host string, rep string"
KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("aeioulnrst") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def table_rows():
    base, passage = prose(120, 1), prose(60, 2)
    texts = [base, base, base + " one more word", prose(80, 3) + " " + passage, passage + " " + prose(40, 4), None, "", "   ", "short text", prose(5000, 6)]
    texts += [prose(90, 10 + i) + f"\nfooter line number {i}" for i in range(8)] + [f'x token = "{KEY}" y ' + prose(30, 40), base.upper(), "é ß " + prose(20, 50)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, None, "b", 1, "h", "r") for i, t in enumerate(texts)]
    return rows + [rows[3], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substring_dedup_against_brute_force(spark, docs, empty):
    first = {}
    for r in table_rows():
        w = words(r[1])
        for i in range(len(w) - 12):
            if r[0] is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, r[0]), r[0])
    want = []
    for r in table_rows():
        w, gone = words(r[1]), set()
        for i in range(len(w) - 12):
            if r[0] is not None and first[tuple(w[i : i + 13])] < r[0]:
                gone.update(range(i, i + 13))
        want.append((r[0], len(w), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [(r.doc_id, r.n_words, r.kept_text) for r in substring_dedup.dedup_substrings(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring_dedup.dedup_substrings(empty).count() == 0
    small = substring_dedup.plan_blocks(docs, block_bytes=2000, buckets=8)
    assert small.n_blocks.sum() > 4
    got = [(r.doc_id, r.n_words, r.kept_text) for r in substring_dedup.dedup_substrings(docs, plan=small).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    history = substring_dedup.compact_runs(substring_dedup.index_runs(docs, small), 8)
    more = spark.createDataFrame([(70, prose(20, 77) + " " + table_rows()[9][1], None), (71, prose(30, 78), None)], "doc_id long, text string, fps string")
    again = substring_dedup.dedup_substrings(docs.where("doc_id < 5").select("doc_id", "text").unionByName(more.select("doc_id", "text")), history=history, plan=substring_dedup.plan_blocks(docs, 2000, 8))
    kept = {r.doc_id: r.kept_text for r in again.collect()}
    assert kept[70] == prose(20, 77) and kept[71] == prose(30, 78) and not any(kept[i] for i in range(5))


def test_blocks_of_sparse_and_repeated_ids(spark):
    texts = [prose(60, 5000 + i % 40) for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10**15, texts[0])] + [(500, prose(60, 6000 + i)) for i in range(300)] + [(501, prose(60, 6000 + i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plan = substring_dedup.plan_blocks(docs, block_bytes=4000, buckets=4)
    sizes = substring_dedup._blocks(docs, plan).groupBy("block", "part").count().collect()
    assert max(r["count"] for r in sizes) < 60 and len(sizes) > 40  # repeated ids are dealt to several parts
    got = {(r.doc_id, r.kept_text) for r in substring_dedup.dedup_substrings(docs, plan=plan).collect()}
    assert (10**15, "") in got and {t for d, t in got if d == 500} == {t for d, t in rows if d == 500} and {t for d, t in got if d == 501} == {""}


def test_five_thousand_repeated_ids_and_equal_rows(spark):
    """Every id that repeats much is split, however many there are; equal rows of one id don't meet in one task."""
    rows = [(i, prose(14, 9000 + i % 50) + f" end {i} {k}") for i in range(5000) for k in range(3)] + [(7777, prose(20, 1))] * 2000 + [(7778, prose(20, 1) + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plan = substring_dedup.plan_blocks(docs, block_bytes=60, buckets=4)
    assert (plan.parts > 1).sum() == 5001
    sizes = substring_dedup._blocks(docs, plan).groupBy("block", "part").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).collect()
    assert max(r.n for r in sizes) <= 3 and sum(r.copies for r in sizes) == len(rows)
    few = docs.where("doc_id < 60 or doc_id > 7000")
    got = substring_dedup.dedup_substrings(few, plan=substring_dedup.plan_blocks(few, block_bytes=60, buckets=4)).collect()
    assert sum(r.doc_id == 7777 and r.kept_text == prose(20, 1) for r in got) == 2000
    assert [r.kept_text for r in got if r.doc_id == 7778] == ["more"]
    assert all(r.kept_text == f"{r.doc_id} {r.kept_text[-1]}" for r in got if 50 <= r.doc_id < 60) and all(r.n_words == len(r.kept_text.split()) for r in got if r.doc_id < 50)


def test_second_hashes_settle_equal_fingerprints(spark, docs, monkeypatch):
    want = sorted((r.doc_id or -1, r.kept_text) for r in substring_dedup.dedup_substrings(docs).collect())
    full = substring_dedup._Block.__init__

    def coarse(self, docs, width, buckets):  # fingerprints of ten bits: nearly all windows collide
        full(self, docs, width, buckets)
        self.windows = self.windows & np.uint64(1023)
        ordered = np.sort(self.windows)
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, bool)
        self.fps, self.twice = ordered[new], np.diff(np.append(np.flatnonzero(new), len(ordered))) > 1
        self.runs = self._by_bucket(self.bucket(self.fps))

    rows = [r for r in table_rows() if r[0] is not None]
    told = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "copies": [1] * len(rows)})
    monkeypatch.setattr(substring_dedup._Block, "__init__", coarse)
    parts = [told.filter(pa.compute.equal(pa.compute.bit_wise_and(told["doc_id"], 1), i)) for i in (0, 1)]
    key = [(pa.scalar(i), pa.scalar(0)) for i in (0, 1)]
    first = pa.concat_tables([substring_dedup._runs_of_block(13, 2, False)(k, t) for k, t in zip(key, parts, strict=True)]).sort_by([("bucket", "ascending"), ("block", "ascending")])
    shared = pa.Table.from_batches(substring_dedup._find_shared(first.combine_chunks().to_batches()))
    of = [shared.filter(pa.compute.equal(shared["block"], i)) for i in (0, 1)]
    second = pa.concat_tables([substring_dedup._checks_of_block(13, 2)(*x) for x in zip(key, of, parts, strict=True)]).sort_by([("bucket", "ascending"), ("block", "ascending")])
    seen = pa.Table.from_batches(substring_dedup._probe(second.combine_chunks().to_batches()))
    out = substring_dedup._strip_block(13, 2)(key[0], pa.concat_tables([of[0], seen.filter(pa.compute.equal(seen["block"], 0))]), parts[0])
    assert out.num_rows == parts[0].num_rows  # block 0 is all even ids, before any odd one
    even = [r for r in rows if r[0] % 2 == 0]
    first_at = {}
    for d, t in sorted((r[0], r[1]) for r in even if r[1]):
        w = t.split()
        for i in range(len(w) - 12):
            first_at.setdefault(tuple(w[i : i + 13]), d)
    for d, text in zip(out["doc_id"].to_pylist(), out["kept_text"].to_pylist(), strict=True):
        w, gone = words(next(r[1] for r in even if r[0] == d)), set()
        for i in range(len(w) - 12):
            if first_at[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        assert text == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert want


def test_minhash_against_brute_force(docs, empty):
    def shingles(t):
        w = [x.lower() if x.isascii() else x for x in words(t)]
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    rows = [(r[0], shingles(r[1])) for r in table_rows() if r[0] is not None]
    comp = {i: i for i, _ in rows}
    for _ in rows:
        for i, a in rows:
            for j, b in rows:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = minhash_dedup.near_duplicates(docs, width=4).collect()
    assert len(got) == len(table_rows())
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(comp.items())
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 14] + [(40, 50), (40, 60)], "a long, b long").repartition(5)
    got = {r.node: r.component for r in minhash_dedup.components(edges).collect()}
    assert got == {i: 0 if i < 15 else 15 for i in range(31)} | {40: 40, 50: 40, 60: 40}


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    u = rng.integers(0, 2**63, 600).astype(np.uint64)
    sig = minhash_dedup.super_minhash(np.concatenate((u[:500], u[100:600])), np.repeat([0, 1], 500), 2, 160)
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.12


def test_decontamination(spark, docs, empty):
    item = words(table_rows()[9][1])[200:230]
    changed = item.copy()
    changed[7] = "zzz"
    bench = spark.createDataFrame([(1, " ".join(changed)), (2, prose(30, 999)), (3, None), (None, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_tokens, r.n_equal) for r in decontamination.find_overlaps(docs, bench).collect()} == {(9, 1, 30, 29)}
    assert decontamination.drop_contaminated(docs, bench).count() == len(table_rows()) - 1
    assert decontamination.find_overlaps(empty, bench).count() == 0
    assert decontamination.find_overlaps(docs, bench.limit(0)).count() == 0


def _overlaps_by_brute_force(doc, item, least_words=13, least_percent=80):
    """(doc_start, item_start, n_tokens, n_equal) of every overlap, window by window."""
    out = set()
    for shift in range(1 - len(item), len(doc)):
        lo, hi = max(0, shift), min(len(doc), shift + len(item))
        same = [doc[i] == item[i - shift] for i in range(lo, hi)]
        if len(item) < least_words:
            good = [(0, len(item))] if len(same) == len(item) and 100 * sum(same) >= least_percent * len(item) else []
        else:
            at = [i for i, x in enumerate(same) if x]
            good = [(s, e + 1) for s in at for e in at if e + 1 - s >= least_words and 100 * sum(same[s : e + 1]) >= least_percent * (e + 1 - s)]
        for s, e in good:
            if not any((a, b) != (s, e) and a <= s and e <= b for a, b in good):
                out.add((lo + s, lo + s - shift, e - s, sum(same[s:e])))
    return out


def test_decontamination_loses_no_overlap(spark):
    r = random.Random(8)
    items = [prose(60, 700 + i).split() for i in range(4)] + [prose(n, 720 + n).split() for n in (3, 4, 5, 6, 8, 9, 10, 12, 13)]
    items.append(items[0][:25] + prose(25, 790).split())  # shares a template with the first
    texts = []
    for same, other in ((13, 5), (14, 6), (15, 7), (20, 9)):  # runs that are overlaps, parted so that the whole stretch is not
        long = prose(3 * same + 2 * other, 900 + same).split()
        items.append(long)
        texts.append(prose(20, same).split() + [w if i % (same + other) < same else "changed" for i, w in enumerate(long)] + prose(9, other).split())
    for item in items[:14]:
        for rate in (0.0, 0.1, 0.2):
            texts.append(prose(r.randint(0, 30), r.random()).split() + [w if r.random() >= rate else "other" for w in item] + prose(r.randint(0, 30), r.random()).split())
    for wrong in ((4, 9), (3, 7, 11), (3, 8, 13, 18)):  # the widest spread over 13, 15 and 20 tokens
        n = {2: 13, 3: 15, 4: 20}[len(wrong)]
        texts.append(["before"] + [w if i not in wrong else "other" for i, w in enumerate(items[1][:n])] + ["after"])
    texts.append(items[2][:15] + prose(5, 991).split() + items[2][20:40] + prose(300, 992).split() + items[2])
    want = {(d, i, *x) for d, doc in enumerate(texts) for i, item in enumerate(items) for x in _overlaps_by_brute_force(doc, item)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = decontamination.find_overlaps(docs, bench).drop("text_key").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) > 50


def test_secrets(docs, empty):
    got = [r for r in secret_scan.find_secrets(docs).collect() if r.doc_id == 18]
    assert [(s.kind, s.start, s.end) for s in got[0].spans if s.kind != "format"] == [("assign", 2, 51), ("hex", 11, 51)]
    clean = secret_scan.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.where(F.col("text").contains(KEY)).count() == 0
    assert clean.where("text is null").count() == 2
    assert secret_scan.find_secrets(empty).count() == 0


BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def random_key(r, n, chars=BASE62):
    return "".join(r.choice(chars) for _ in range(n - 3)) + "".join(map(r.choice, (chars[:26], chars[26:52] or chars, chars[-10:])))


def test_secrets_behind_long_paths(spark):
    r = random.Random(3)
    key = [random_key(r, 40) for _ in range(81)]
    path = [".".join(r.choice(VOCAB) for _ in range(12)) + ".v2" for _ in range(82)]
    rows = [(i, f'x token = "{key[i]}" y {path[i]} z') for i in range(80)]
    rows += [(90, f"{prose(10, 1)} {path[80]}.key={key[80]} {prose(10, 2)}"), (91, f"{prose(10, 3)} {path[81]} {prose(10, 4)}")]
    clean = {r.doc_id: r.text for r in secret_scan.redact_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert key[80] not in clean[90] and prose(10, 2) in clean[90]
    assert clean[91] == rows[81][1]


def test_formats_are_inferred(spark):
    """Bare keys of formats seen in labelled values are found, ordinary identifiers and other lengths are not."""
    r = random.Random(4)
    hexa = "0123456789abcdef"
    formats = (lambda: "ghk_" + random_key(r, 36), lambda: f"sk-{random_key(r, 20)}-{random_key(r, 24)}", lambda: "".join(r.choice(hexa.upper()) for _ in range(31)) + "7")
    rows = [(i, f'{prose(6, i)} api_key: "{formats[i % 3]()}" {prose(6, i + 1)}') for i in range(150)]
    ordinary = (lambda: f"mail{r.randint(1, 9)}.example.com", lambda: str(r.randint(10**15, 10**16 - 1)), lambda: "".join(r.choice(VOCAB) for _ in range(5)), lambda: f"build-{r.randint(2000, 2030)}-{r.choice(VOCAB)}-final")
    rows += [(200 + i, f"{prose(6, i)} {ordinary[i % 4]()} {prose(6, i + 1)}") for i in range(200)]
    planted = {500 + i: formats[i % 3]() for i in range(60)}
    rows += [(d, f"{prose(6, d)} {key} {prose(6, d + 1)}") for d, key in planted.items()]
    others = {600 + i: t for i, t in enumerate([ordinary[i % 4]() for i in range(80)] + [random_key(r, 19)[:17] for _ in range(5)])}
    rows += [(d, f"{prose(6, d)} {t} {prose(6, d + 1)}") for d, t in others.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanner = secret_scan.fit(docs)
    assert scanner.secret["assign"].states > 10  # lengths and places of marks are states
    got = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == "format"} for r in secret_scan.find_secrets(docs).collect()}
    texts = dict(rows)
    found = [d for d, key in planted.items() if (texts[d].index(key), texts[d].index(key) + len(key)) in got[d]]
    wrong = [d for d in list(range(200, 400)) + list(others) if got[d]]
    assert len(found) / len(planted) > 0.95 and not wrong
    total = sum(np.exp((len(s) + 1) * scanner.secret["assign"].log_likelihood(s)) for s in {secret_scan.symbols(k) for k in planted.values()})
    assert total < 1  # likelihoods of different strings add up to less than one


def test_a_rare_credential_is_learned(spark):
    docs = spark.range(80_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 777, f'x token = "{KEY}" y').otherwise("nothing here").alias("text"))
    assert secret_scan.fit(docs).learned


def test_line_frequency(spark, docs, empty):
    many = spark.createDataFrame([(i, f"All rights reserved 20{i % 90 + 10}\n" + prose(40, i), "a") for i in range(12)] + [(99, "All rights reserved 2024\nshort left here", "a"), (100, None, None)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.line_frequency(many).collect()}
    assert got[0].kept and got[0].n_removed_words == 4
    assert not got[99].kept and not got[100].kept and got[100].base_failed
    assert quality_rules.line_frequency(docs).count() == len(table_rows())
    assert quality_rules.line_frequency(empty).count() == 0


def test_lines_are_removed(spark):
    rows = [(i, f"All rights reserved 20{i % 90 + 10}\n" + prose(40, i), "a", 1) for i in range(12)] + [(99, "All rights reserved 2024\nshort left here", "a", 5), (100, None, None, None), (50, prose(30, 50) + "\n\n" + prose(30, 51), "b", 7)]
    got = quality_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")).collect()
    texts = {r.doc_id: (r.text, r.n_chars) for r in got}
    assert texts == {i: (prose(40, i), len(prose(40, i))) for i in range(12)} | {50: (rows[-1][1], 7)}


def test_a_line_above_the_absolute_limit(spark):
    rows = [(i, ("same line in each\n" if i < 30 else "") + prose(30, i), "a") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert quality_rules.line_frequency(docs).where("n_removed_words > 0").count() == 0
    assert quality_rules.line_frequency(docs, most_docs=20).where("n_removed_words = 4").count() == 30


def test_mixing_stays_within_a_block(spark, docs, empty):
    rows = spark.createDataFrame([(i, "ab"[i % 7 > 4], "x") for i in range(700)], "doc_id long, source string, mix_slot string")
    got = mixing.mix(rows, block_docs=5, period=100).select("source", "mix_slot", "mix_release", "mix_deadline", "mix_block").distinct().toPandas()
    assert ((got.mix_slot >= got.mix_release) & (got.mix_slot < got.mix_deadline)).all()
    assert got.mix_slot.is_unique
    slots = got[got.mix_slot < 100].groupby("source").size()
    for t in range(1, 100):
        for s in "ab":
            assert abs(((got.source == s) & (got.mix_slot < t)).sum() - slots[s] * t / 100) < 1
    assert mixing.mix(docs).count() == len(table_rows())
    assert mixing.mix(empty).count() == 0


def test_mixing_weights_names_and_missing_ids(spark):
    rows = [(i if i % 3 else None, "abc"[i % 3 if i < 900 else 0], i, i, i, i, i, i, f"t{i}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slots long, slot long, period long, before long, n_docs long, nth long, text string")
    got = mixing.mix(docs, block_docs=4, period=100, weights={"a": 1.0, "b": 3.0, "zzz": 5.0})
    assert got.columns[:9] == docs.columns
    assert {tuple(r)[:9] for r in got.collect()} == set(rows)  # helper names don't touch columns of the same names
    first = got.where("mix_slot < 100").groupBy("source").agg(F.countDistinct("mix_slot").alias("n")).collect()
    share = {r.source: r.n for r in first}
    assert abs(share["b"] - 3 * share["a"]) <= 4 and share["c"] == 1  # c has no weight and gets the least
    pieces = [r.n for r in got.where("doc_id is null").groupBy("mix_rank", "source").agg(F.count("*").alias("n")).collect()]
    assert max(pieces) == 1
    table_of_weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", 2.0), ("zzz", 5.0)], "name string, share double")
    assert {tuple(r) for r in mixing.mix(docs, block_docs=4, period=100, weights=table_of_weights).collect()} == {tuple(r) for r in got.collect()}


def _ranks_by_brute_force(edges, seed, forward, damping=0.85, rounds=24):
    out = {h: (1 - damping) * v for h, v in seed.items()}
    moving = dict(out)
    total = {}
    for (a, b), w in edges.items():
        key = a if forward else b
        total[key] = total.get(key, 0) + w
    for _ in range(rounds):
        new = {}
        for (a, b), w in edges.items():
            x, y = (a, b) if forward else (b, a)
            if x in moving:
                new[y] = new.get(y, 0) + damping * moving[x] * w / total[x]
        for h, v in new.items():
            out[h] = out.get(h, 0) + v
        moving = new
    return out


def test_url_rules(spark):
    rows = [(1, "http://www.a.com/en/1", ""), (2, "https://WWW.A.com/fr/1", ""), (3, None, None), (4, "nothing", ""), (5, "http://b.example.com/en/7?q", "<a href='/x'>"), (6, "http://b.net/de/1#x", None), (7, "http://x.example.net/de/81", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got[1] == ("www.a.com", "/en/1", "com/en/", "block") and got[3] == got[4] == ("", "", None, "allow")
    assert got[2] == ("www.a.com", "/fr/1", None, "block")  # its host is a blocked seed
    assert got[5] == ("b.example.com", "/en/7", "example.com/en/7", "allow") and got[6][2:] == ("net/de/", "allow") and got[7][2:] == ("example.net/de/8", "block")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_distrust_and_trust_reach_other_hosts(spark):
    """No host below is a seed but bad.com and good.net: verdicts of the rest come by links alone."""
    chain = [(i, f"http://h{i}.gov/", f'<a href="http://h{i + 1}.gov/">') for i in range(12)] + [(12, "http://h12.gov/", '<a href="http://bad.com/">')]
    rows = chain + [(20, "http://bad.com/en/1", ""), (21, "http://good.net/de/1", '<a href="http://saved.gov/"><a href="//saved.gov/2"><A HREF=http://m.gov/>'), (22, "http://saved.gov/x", '<a href="http://bad.com/">'), (23, "http://other.gov/", '<a href="/bad.com/">'), (24, "http://m.gov/1", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages).collect()}
    assert got == {i: "block" for i in range(13)} | {20: "block", 21: "allow", 22: "allow", 23: "allow", 24: "allow"}
    edges = {(r.src, r.dst): r.weight for r in url_filter.host_edges(url_filter.with_rules(url_filter.split_urls(pages))).collect()}
    assert edges[("good.net", "saved.gov")] == 2 and ("other.gov", "other.gov") not in edges
    seeds = spark.createDataFrame([("bad.com", 0.0, 1.0), ("good.net", 1.0, 0.0)], "host string, trust0 double, distrust0 double")
    ranks = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(seeds, spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, weight double")).collect()}
    trust, distrust = _ranks_by_brute_force(edges, {"good.net": 1.0}, True), _ranks_by_brute_force(edges, {"bad.com": 1.0}, False)
    for host in trust.keys() | distrust.keys():
        assert ranks[host] == pytest.approx((trust.get(host, 0), distrust.get(host, 0)))
    without = pages.where("page_id <> 21")  # what saved saved.gov is the link from a trusted host
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(without).collect()}[22] == "block"


def test_links_to_hosts_without_a_page(spark):
    rows = [(1, "http://bad.com/en/1", ""), (2, "http://a.gov/", '<a href="http://x.y.bad.org/">'), (3, "http://b.gov/", '<a href="http://hub.gov/">'), (4, "http://y.bad.org/es/1", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block"}  # x.y.bad.org has no page but a blocked parent


def test_toxicity_and_language(spark, docs, empty):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(40, 1000 + i) + (" stupid idiot stupyd moron" if bad else " calm gentle"), "en"))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(d, lab).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in got)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert toxicity.score_documents(docs, lab.limit(0)).count() == len(table_rows())
    assert toxicity.score_documents(empty, lab).count() == 0
    pred = {(r.doc_id, r.lang_pred) for r in language_id.identify_languages(docs).collect()}
    assert (5, "und") in pred and (6, "und") in pred and (0, "en") in pred
    assert language_id.identify_languages(empty).count() == 0


def test_letters(spark):
    rows = [(1, "½ ²"), (2, "³ 12 ."), (3, "é"), (4, "дом"), (5, "  \n"), (6, None), (7, "_ 7"), (8, "x")] + [(10 + i, prose(30, i)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en" if i >= 10 else None, "x") for i, t in rows], "doc_id long, text string, lang string, lang_pred string")
    pred = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(docs).collect()}
    assert {i for i, (lang, _) in pred.items() if lang == "und"} == {i for i, t in rows if not any(c.isalpha() for c in t or "")}
    assert pred[1] == ("und", 0.0)


def test_every_language_is_learned(spark):
    """A hundred and fifty languages of a few texts each, a repeated row, and one in so many rows that it can't be drawn by chance."""
    letters = [f"{chr(0x3B1 + i % 24)}{chr(0x430 + i // 24)}" for i in range(150)]
    said = lambda i, seed: " ".join(random.Random(seed).choice((letters[i], letters[i] * 2, letters[i] * 3)) for _ in range(40))
    rows = [(150 * k + i, said(i, 150 * k + i), f"l{i:03d}") for k in range(4) for i in range(150)] + [(5000, VOCAB[0] + " " + VOCAB[7], "copied")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs)
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5}
    assert set(model.langs) == learned and len(learned) > 145
    got, _ = model.predict(pa.array([said(i, 10_000 + i) for i in range(150)]))
    assert np.mean([g == f"l{i:03d}" for i, g in enumerate(got) if f"l{i:03d}" in learned]) > 0.9


def test_ties_of_votes():
    model = language_id.Model(["de", "en", "fr", "nl"], np.eye(4, language_id.BUCKETS, dtype=np.float32), np.arange(4))
    family = model.families.index("germanic")
    assert model.members[family] == [0, 1, 3] and model.between[family] == [(0, 1), (0, 3), (1, 3)]
    assert model.vote(family, np.array([1.0, -1.0, 1.0])) == (0, -1.0)  # each wins once: all worst duels are alike, the first counts
    assert model.vote(family, np.array([1.0, -2.0, 1.0])) == (1, -1.0) and model.vote(family, np.array([1.0, 1.0, -1.0]))[0] == 0


def test_toxicity_of_few_labels_and_ties(spark):
    rows = [(i, prose(30, 500 + i) + (" stupid idiot moron" if i % 2 else " calm gentle kind")) for i in range(24)] + [(99, prose(30, 7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(24))
    kept = toxicity.informative(np.array([[0, 3, 0, 10, 5], [0, 0, 3, 10, 5]]), np.array([10.0, 10.0]))
    assert kept.tolist() == [1, 2]  # what none has, all have, or both classes have alike tells nothing
    even = docs.select("doc_id", toxicity.score_udf(np.zeros(toxicity.BUCKETS), 0.0)("text").alias("s"))
    assert {r.s for r in even.collect()} == {0.5}


def test_svm_against_plain_descent():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 5))
    y = np.where(x[:, 0] - 0.5 * x[:, 1] + 0.3 + 0.3 * rng.standard_normal(60) > 0, 1, -1)
    share = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean()) / len(y)

    def loss(w, b):
        return 0.5 * w @ w + 10.0 * (share * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()

    w, b = np.zeros(5), 0.0
    for _ in range(20000):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * share * y
        w, b = w - 2e-3 * (w - 20 * (x.T @ slack)), b + 2e-3 * 20 * slack.sum()
    assert loss(*language_id.linear_svm(x, y, steps=2000)) == pytest.approx(loss(w, b), rel=1e-3)


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20000) < 0.7
    right = (0.95, 0.9, 0.8, 0.7, 0.85)
    v = np.array([np.where(rng.random(20000) < 0.3, 2, np.where(rng.random(20000) < p, good, ~good)) for p in right]).T
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    share, tab, post = quality_classifier.expectation_maximisation(patterns, counts.astype(float), steps=300)
    assert share == pytest.approx(0.7, abs=0.03)
    for k, p in enumerate(right):
        assert tab[1, k, 1] / (tab[1, k, 1] + tab[1, k, 0]) == pytest.approx(p, abs=0.04)
    prior = np.log([1 - share, share])
    for pattern, q in zip(patterns[:40].tolist(), post[:40], strict=True):  # the posterior, vote by vote
        z = [prior[c] + sum(np.log(tab[c, k, vote]) for k, vote in enumerate(pattern)) for c in (0, 1)]
        assert q == pytest.approx(np.exp(z[1]) / (np.exp(z[0]) + np.exp(z[1])), abs=1e-3)


def test_measures_against_brute_force():
    def repeated(w, n):
        seen = {}
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append(i)
        return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + n)})

    texts = [prose(50, 1), prose(20, 2) + " " + prose(20, 2), "a b c d e f a b c d e f x", "Ä!! OK (x) --- 12, " * 3, "x" * 100_000, prose(40_000, 3), None, "", " \n", "b a", "a, b: C. D ÉA"]
    measured, n = quality_classifier.measures(pa.array(texts))
    for m, k, text in zip(measured, n, texts, strict=True):
        w = words(text)
        assert k == len(w)
        if not w:
            assert not m.any()
            continue
        share = [sum(map(f, w)) / k for f in (lambda x: x.encode().isupper() and len(x.encode()) > 1, lambda x: len(x.encode()) < 4 and not any(c.isalnum() or ord(c) > 127 for c in x), lambda x: x[-1] in ".,;:?", lambda x: len(x.encode()) <= 3)]
        assert [m[1], m[3], m[6]] == pytest.approx(share[:3]) and m[7] == pytest.approx(share[3] if k >= 20 else 0.12)
        assert m[2] == pytest.approx(repeated(w, 5) / k) and m[8] == pytest.approx(repeated(w, 10) / k)
        assert m[4] == pytest.approx(text.count("!") / k) and m[0] == pytest.approx(sum(c in "#*$%&|<>" for c in text) / k)
        assert m[5] == pytest.approx(max(map(w.count, set(w))) / k if k >= 20 else 0)


def test_words_of_a_column():
    texts = ["a b", "  x\ty ", None, "", "q", "é ß\n\nlong" * 3, "z" * 9000 + " tail", "(a) -- b,c!", "..."]
    got = textkernel.Words.of(pa.array(texts).slice(1))
    raw = [bytes(got.data[a : a + n]) for a, n in zip(got.at, got.length, strict=True)]
    assert raw == [x for t in texts[1:] for x in (t or "").encode().split()]
    assert got.count.tolist() == [len((t or "").split()) for t in texts[1:]]
    alone = np.concatenate([textkernel.word_hashes((t or "").encode()) for t in texts[1:]])
    assert (got.hashes() == alone).all() and len(set(alone.tolist())) == len(set(raw))
    assert not set(got.hashes(salt=1).tolist()) & set(alone.tolist())
    bare = textkernel.Words.of(pa.array(texts[-2:])).trimmed(decontamination.MARK)
    assert [bytes(bare.data[a : a + n]) for a, n in zip(bare.at, bare.length, strict=True)] == [b"a", b"b,c"] and bare.count.tolist() == [2, 0]


def test_gradient_of_toxicity_reaches_misspellings(spark):
    rows = [(i, prose(30, 1000 + i) + (" stupidest idiotic" if i % 3 == 0 else ""), i % 3 == 0) for i in range(300)]
    weights, bias = toxicity.train([toxicity.document_ngrams(w) for w in toxicity.letter_words(pa.array([t for _, t, _ in rows]))], np.array([int(b) for *_, b in rows]), np.array([2 / 3, 1 / 3]))
    unseen, plain = (toxicity.text_scores(pa.array(t), weights[:, None], toxicity.SIZES)[0][:, 0] for t in (["stupiddest", "idiootic"], VOCAB[:50]))
    assert unseen.min() > plain.max()


def test_text_scores_against_word_by_word():
    rng = np.random.default_rng(7)
    weights = rng.standard_normal((1 << 10, 3))
    texts = ["Ein WORT, ein wort; noch1eins", None, "", "12 34", "É" * 5 + " x", prose(300, 5), "y" * 40_000 + " z"]
    got, n = wordscores.text_scores(pa.array(texts), weights, (1, 2, 3))
    scorer = wordscores.word_scorer(weights, (1, 2, 3))
    for row, k, w in zip(got, n, wordscores.letter_words(pa.array(texts)), strict=True):
        assert k == len(w) and row == pytest.approx(scorer(w).mean(axis=0) if w else np.zeros(3))
        if w:
            assert row == pytest.approx(wordscores.mean_gram_vector(w, (1, 2, 3), 1 << 10) @ weights, abs=1e-5)


def test_quality(spark, docs, empty):
    rows = [(i, prose(60, 2000 + i)) for i in range(60)] + [(100 + i, " ".join(w.upper() + "!!" for w in prose(60, 3000 + i).split())) for i in range(15)] + [(500, None), (501, "")]
    got = {r.doc_id: r.kept for r in quality_classifier.classify_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[i] for i in range(60)]) > 0.95 and np.mean([got[100 + i] for i in range(15)]) < 0.1
    assert not got[500] and not got[501]
    assert quality_classifier.keep_good(docs).columns == docs.columns
    assert quality_classifier.classify_quality(empty).count() == 0
