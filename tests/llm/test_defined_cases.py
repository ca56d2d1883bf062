"""Base columns of secrets by a scanner without patterns, limits met exactly, dirty tables on either side."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, quality_rules, secret_scan, url_filter
from tests.conftest import SF_SMALL
from tests.llm.test_operators import prose

VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
CAPITALS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def run_end(text, at, chars):
    while at < len(text) and text[at] in chars:
        at += 1
    return at


def assignment(text, at):
    """(start of the value, its end) of an assignment that begins here, or None."""
    for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
        here = text[at : at + len(name)]
        if here.isascii() and here.lower() == name:
            i = at + len(name)
            i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
            i = run_end(text, i, {" "})
            if text[i : i + 1] not in (":", "=") or i >= len(text):
                continue
            i = run_end(text, i + 1, {" "})
            i += text[i : i + 1] in ("'", '"') and i < len(text)
            end = run_end(text, i, VALUE)
            if end > i:
                return i, end
    return None


def base_by_scanning(text):
    found, at = [], 0
    while at < len(text):
        if hit := assignment(text, at):
            if hit[1] - hit[0] >= 6:
                found.append((at, 0, hit[1]))
            at = hit[1]
        else:
            at += 1
    at = 0
    while (at := text.find("AKIA", at)) >= 0:
        end = run_end(text, at + 4, CAPITALS)
        if end - at >= 20:
            found.append((at, 1, end))
        at = end if end > at + 4 else at + 1
    at = 0
    while at < len(text):
        end = run_end(text, at, set("0123456789abcdef"))
        if end - at >= 24:
            found.append((at, 2, end))
        at = max(end, at + 1)
    return sorted(found)


def test_base_of_secrets_by_scanning(spark, tmp_path):
    r = random.Random(8)
    bits = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "token", '"', "'", " ", "  ", ":", "=", "\n", "é", "ſ", "K", "AKIA", "AKIA" + "Q7" * 9, "0af" * 9, "abc/def+1", "x.y=z-", "ABCDEF", "12", "ß"]
    made = [(10**6 + i, "".join(r.choice(bits) for _ in range(r.randint(1, 60))), None, None, None) for i in range(400)] + [(10**7, None, None, None, None), (10**7 + 1, "", None, None, None)]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame(made, docs.schema).unionByName(docs).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {d.doc_id: d.text or "" for d in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    got = secret_scan.op4_secret_scan(spark, str(tmp_path)).collect()
    assert sorted(g.doc_id for g in got) == sorted(texts)
    seen = Counter()
    for g in got:
        base = base_by_scanning(texts[g.doc_id])
        told = [f"{secret_scan.KINDS[k]}:{start}:{end}" for start, k, end in base]
        counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
        assert [g.n_assign, g.n_access, g.n_hex] == counts, texts[g.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [s for s in g.spans.split(",") if s and not s.startswith("format:")] == told
        seen.update(k for _, k, _ in base)
    assert min(seen[k] for k in range(3)) > 20


def test_lines_at_the_limits_stay(spark):
    """Eight texts of a host are not above eight, ten of two hundred not above five percent; one more is."""

    def removed(n_docs, n_with):
        rows = [(i, ("the same short footer\n" if i < n_with else "") + prose(30, i), "a") for i in range(n_docs)]
        return quality_rules.line_frequency(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("n_removed_words = 4").count()

    assert [removed(20, 8), removed(20, 9), removed(200, 10), removed(200, 11)] == [0, 9, 0, 11]


def test_pages_with_repeats_nulls_and_clashing_names(spark):
    """A host that links to a blocked one is blocked, whatever its page_id; a long page's last link counts."""
    long = "x" * 400_000 + "<a href='http://far.org/1'>"
    rows = [(1, "http://www.a.com/en/1", None), (None, "http://b.org/1", "<a href='http://www.a.com/en/1'>"), (2, "http://c.net/de/1", long), (2, "http://c.net/de/1", long), (3, "http://far.org/1", ""), (None, None, None)]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = Counter(map(tuple, url_filter.judge_urls(plain).collect()))
    assert sum(want.values()) == len(rows) and want[(2, "c.net", "/de/1", "net/de/", "allow")] == 2
    assert want[(None, "b.org", "/1", None, "block")] == 1 and want[(3, "far.org", "/1", None, "allow")] == 1 and want[(None, "", "", None, "allow")] == 1
    names = ("host", "path", "rule", "verdict", "rank", "trust", "distrust", "step", "rule_action", "blocked", "weight")
    clash = plain.select("*", *[F.lit("http://z.org/").alias(n) for n in names])
    assert Counter(map(tuple, url_filter.judge_urls(clash).collect())) == want


@pytest.mark.parametrize("side", ["benchmark", "documents"])
def test_overlaps_with_repeats_and_clashing_names(spark, side):
    item = prose(40, 71)
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item), (3, prose(6, 72)), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a b {item} c"), (1, f"a b {item} c"), (2, prose(50, 73)), (None, item), (5, prose(6, 72))], "doc_id long, text string")
    want = {(d, i, start, 0, n, n) for d, start, n, items in ((1, 2, 40, (1, 2, None)), (None, 0, 40, (1, 2, None)), (5, 0, 6, (3,))) for i in items}
    names = [F.lit(7).alias(n) for n in ("item_key", "text_key", "tokens", "hash", "at", "shift", "hit_at", "item_tokens", "n")]
    if side == "benchmark":
        bench = bench.select("*", *names, F.lit(9).alias("doc_id"))
    else:
        docs = docs.select("*", *names, F.lit(9).alias("item_id"))
    got = [tuple(r) for r in decontamination.find_overlaps(docs, bench).drop("text_key").collect()]
    assert set(got) == want and len(got) == len(want)
    left = decontamination.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]
