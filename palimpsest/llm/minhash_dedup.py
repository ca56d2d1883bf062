"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find grouping.

Signatures. In SuperMinHash every shingle draws one random permutation of the slots, step by step; at
step i it offers the rank (i, r) to the i-th slot of its permutation, and a slot keeps the least rank.
All values of step i are below those of step i+1, so a document stops as soon as every slot is filled.
The steps run on all shingles of a batch of documents at once.

Candidates. Documents with equal shingle sets are one class from the start. A class has `bands` bucket
keys of `rows` slots each. In a bucket every class is paired with the bucket's first and last class
only, never with all others. Verified pairs are grouped. Then the buckets that still hold several
groups are compared in full, in square blocks of classes, but only across groups. Pairs are not listed:
a block names the pairs of tiles (parts of bounded size of what shares buckets) in which signatures
leave a link possible; each pair of tiles is then settled at once on the full shingle sets, and gives a
forest of its links. No bucket is capped; a pair that shares a bucket is left out only if its whole signatures
agree in fewer slots than six standard deviations below what the least similarity gives.

With 32 bands of 5 slots two sets of similarity 0.8 share no bucket with probability 3e-6 (0.85: 7e-9).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.textkernel import GOLDEN, LOWER, Words, in_sorted, mix, odd_constants, slices, text_bytes, window_hashes, word_hashes
from palimpsest.tables import discard, materialize, table

BANDS, ROWS = 32, 5
SHINGLE_WORDS, PERCENT = 5, 80
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
BATCH_SHINGLES = 120_000
SALT_SHINGLES = 100_000
TILE_SHINGLES = 250_000
BLOCK_CLASSES = 256
SIGN_SCHEMA = "doc_id long, n_shingles long, set_key binary, band_keys array<long>, signature binary"


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles; fewer words make one shingle of all."""
    return _shingles(word_hashes(text, table=LOWER), width)


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    if len(h) < width:
        return window_hashes(h, len(h)) + np.uint64(len(h)) if len(h) else h
    return np.unique(window_hashes(h, width))


def super_minhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """Signatures (n_docs x slots) of documents given as flat arrays of elements and document numbers."""
    sig = np.full(n_docs * slots, EMPTY, np.uint64)
    e, d = elements, doc
    k0 = k1 = perm = None
    for i in range(slots):
        x = mix(e + np.uint64((i + 1) * int(GOLDEN) & int(EMPTY)))
        rank = np.uint64(i << 32) | (x >> np.uint64(32))
        k = (i + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - i)) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        if i == 0:
            slot = k0 = k
        elif i == 1:
            k1, slot = k, np.where(k == k0, 0, k)
        else:
            rows = np.arange(len(e))
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint16), (len(e), 1))
                for j, kj in enumerate((k0, k1)):
                    perm[rows, kj], perm[rows, j] = perm[rows, j], perm[rows, kj]
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, i]
        np.minimum.at(sig, d * slots + slot, rank)
        open_docs = (sig.reshape(n_docs, slots) == EMPTY).any(axis=1)
        stay = open_docs[d]
        if not stay.any():
            break
        if not stay.all():
            e, d, k0, k1 = e[stay], d[stay], k0[stay], k1 if k1 is None else k1[stay]
            perm = perm if perm is None else perm[stay]
    return sig.reshape(n_docs, slots)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per document and band."""
    cells = signatures.reshape(len(signatures), bands, rows)
    keys = np.zeros((len(signatures), bands), np.uint64)
    for j, c in enumerate(odd_constants(rows, salt=1)):
        keys += mix(cells[:, :, j] + c) * c
    return mix(keys + np.arange(bands, dtype=np.uint64) * GOLDEN)


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids, sets):
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys, sigs = [None] * len(ids), [None] * len(ids)
            if len(full):
                doc = np.repeat(np.arange(len(full)), sizes[full])
                signatures = super_minhash(np.concatenate([sets[i] for i in full]), doc, len(full), bands * rows)
                bk, low = band_keys(signatures, bands, rows).view(np.int64), signatures.astype(np.uint16)
                for r, i in enumerate(full.tolist()):
                    keys[i], sigs[i] = bk[r].tolist(), low[r].tobytes()
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            columns = [(ids, pa.int64()), (sizes.tolist(), pa.int64()), (digests, pa.binary()), (keys, pa.list_(pa.int64())), (sigs, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["doc_id", "n_shingles", "set_key", "band_keys", "signature"])

        for batch in batches:
            ids, sets, weight = [], [], 0
            for at, end in slices(batch.column(1), 1 << 20):
                part = batch.slice(at, end - at)
                words = Words.of(part.column(1))
                h = words.hashes(table=LOWER)
                for doc_id, w, n in zip(part.column(0).to_pylist(), words.first.tolist(), words.count.tolist(), strict=True):
                    s = _shingles(h[w : w + n], width)
                    ids.append(doc_id)
                    sets.append(s)
                    weight += len(s) + 64
                    if weight > BATCH_SHINGLES:
                        yield flush(ids, sets)
                        ids, sets, weight = [], [], 0
            if ids:
                yield flush(ids, sets)

    return run


def signatures(docs: DataFrame, width: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, set_key (digest of the set), band_keys, signature (low 16 bits of each slot)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_sign(width, bands, rows), SIGN_SCHEMA)


def _verify(width: int, percent: int):
    def run(centers: pa.Table, members: pa.Table) -> pa.Table:
        a, b = [], []
        sets = [(i, shingle_set(t, width)) for i, t in zip(centers.column("a").to_pylist(), text_bytes(centers.column("text")), strict=True)]
        for other, text in zip(members.column("b").to_pylist(), text_bytes(members.column("text")), strict=True):
            mine = shingle_set(text, width)
            for center, s in sets:
                both = int(in_sorted(s, mine).sum())
                if both and 100 * both >= percent * (len(s) + len(mine) - both):
                    a.append(center)
                    b.append(other)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b, nb) those whose full shingle sets are similar enough.

    The members of a center meet it in groups of at most SALT_SHINGLES shingles, so a center with
    many or long members is spread over many tasks.
    """
    heavy = materialize(
        pairs.groupBy("a").agg(F.sum("nb").alias("w")).where(F.col("w") > SALT_SHINGLES).select("a", F.expr(f"int(w div {SALT_SHINGLES}) + 1").alias("salts")),
        "heavy-centers",
    )
    salted = pairs.join(heavy, "a", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int"))

    def fresh(*names):  # both sides of the cogroup come from the same tables: give each its own columns
        return [F.col(x).alias(x) for x in names]

    centers = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select(*fresh("a", "salt", "text"))
    members = salted.select("a", "salt", "b").join(texts.withColumnRenamed("doc_id", "b"), "b").select(*fresh("a", "salt", "b", "text"))
    found = centers.groupBy("a", "salt").cogroup(members.groupBy("a", "salt")).applyInArrow(_verify(width, percent), "a long, b long")
    return found.distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition -> (node, root), the root being the least of its set."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        some = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(n) for n in some], pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its least node.

    Each round runs union-find inside the partitions, hooks every node to its least root, shortens the
    chains by pointer jumping and goes on with the contracted edges; the number of roots at least halves
    each round. All joins are on tables in the shared folder, so a hub's key can be split.
    """
    labels, left = None, edges.select("a", "b")
    while True:
        kept = hooks = materialize(left.mapInArrow(_forest, "node long, root long").groupBy("node").agg(F.min("root").alias("root")), "hooks")
        if hooks.isEmpty():
            break
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = materialize(hooks.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "hooks")
            discard(kept)  # nothing else reads the chains before the jump
            kept, hooks = jumped, jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        up = hooks.select(F.col("node").alias("component"), F.col("root").alias("higher"))
        if labels is None:
            labels = hooks.select("node", F.col("root").alias("component"))
        else:
            old = labels.join(up, "component", "left").select("node", F.coalesce("higher", "component").alias("component"))
            fresh = hooks.select("node", F.col("root").alias("component")).join(labels.select("node"), "node", "left_anti")
            labels = materialize(old.unionByName(fresh), "labels")
        for side in ("a", "b"):
            lifted = hooks.select(F.col("node").alias(side), F.col("root").alias("up"))
            left = left.join(lifted, side, "left").withColumn(side, F.coalesce("up", side)).drop("up")
        left = materialize(left.where("a <> b").distinct(), "contracted")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def _possible_squares(percent: int, slots: int):
    """One square block of a bucket -> the tile pairs where signatures leave a link across groups possible."""
    least = int(slots * (percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / slots) ** 0.5))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        rep, n, comp, side, home, tile = (t.column(c).to_numpy() for c in ("rep", "n", "comp", "side", "home", "tile"))
        sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(len(rep), slots)
        xs, ys = np.flatnonzero(side == i), np.flatnonzero(side == j)
        found = set()
        for x in xs:
            other = ys[ys > x] if i == j else ys
            fit = (comp[other] != comp[x]) & (100 * np.minimum(n[other], n[x]) >= percent * np.maximum(n[other], n[x]))
            other = other[fit]
            other = other[(sig[other] == sig[x]).sum(axis=1) >= least]
            mine = (int(home[x]), int(tile[x]))
            found.update(tuple(sorted((mine, theirs))) for theirs in set(zip(home[other].tolist(), tile[other].tolist(), strict=True)))
        found = list(found)
        columns = {"home_i": [f[0][0] for f in found], "tile_i": [f[0][1] for f in found], "home_j": [f[1][0] for f in found], "tile_j": [f[1][1] for f in found]}
        return pa.table({k: pa.array(v, pa.int32() if k.startswith("tile") else pa.int64()) for k, v in columns.items()})

    return run


def _settle_square(width: int, percent: int):
    """All classes of a tile pair with their texts -> a forest of the exact links across groups."""

    def run(t: pa.Table) -> pa.Table:
        rep, comp = t.column("rep").to_numpy(), t.column("comp").to_numpy()
        sets = [shingle_set(text, width) for text in text_bytes(t.column("text"))]
        size = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1  # only shingles of two sets or more can add to an intersection
        column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for c in range(0, int(shared.sum()), 4096):
            lo, hi = np.searchsorted(column, (c, c + 4096))
            dense = np.zeros((len(sets), 4096), np.float32)
            dense[owner[lo:hi], column[lo:hi] - c] = 1
            both += dense @ dense.T
        both = both.astype(np.int64)
        link = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (comp[:, None] != comp[None, :]) & (both > 0)
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        a, b = [], []
        for x, y in zip(*(v.tolist() for v in np.nonzero(np.triu(link))), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[rx] = ry
                a.append(min(rep[x], rep[y]))
                b.append(max(rep[x], rep[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Group documents whose sets of distinct width-word shingles (A-Z lower-cased) have Jaccard >= percent/100.

    Returns one row per input row: doc_id, n_shingles, component_id (the least doc_id reachable over
    links), kept (doc_id = component_id).

    Defined cases: null, empty or wordless text has no shingles and is linked with nothing; a text of
    fewer words than width is one shingle; rows that repeat a doc_id are one document; rows without a
    doc_id are not linked, have a null component_id and are kept; an empty table gives an empty result.
    Only doc_id and text are read, so further columns may have any names.
    """
    slots = bands * rows
    signed = materialize(signatures(docs, width, bands, rows), "signatures")
    usable = signed.where("doc_id is not null and set_key is not null")
    classes = materialize(
        usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("band_keys").alias("band_keys"), F.any_value("signature").alias("signature")),
        "classes",
    )
    banded = classes.select("rep", "n", F.explode("band_keys").alias("bucket"))
    spot = F.struct("rep", "n")
    buckets = materialize(banded.groupBy("bucket").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi")).where("lo.rep < hi.rep"), "buckets")
    members = materialize(banded.join(buckets, "bucket").select("bucket", "rep", "n", "lo", "hi"), "members")

    def close(na, nb):
        return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)

    stars = members.select("rep", "n", F.explode(F.array("lo", "hi")).alias("c")).where(F.col("c.rep") != F.col("rep")).where(close(F.col("n"), F.col("c.n")))
    low_first = F.col("c.rep") < F.col("rep")
    pairs = materialize(
        stars.select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b"), F.when(low_first, F.col("n")).otherwise(F.col("c.n")).alias("nb")).distinct(),
        "star-pairs",
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = materialize(texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id"), "candidate-texts")
    links = materialize(verified(pairs, texts, width, percent), "links")
    groups = components(links)

    labelled = materialize(
        members.select("bucket", "rep", "n").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("comp")),
        "labelled",
    )
    unsettled = materialize(
        labelled.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size"), F.min("rep").alias("least")).where("c0 < c1").select("bucket", "least", F.expr(f"int((size - 1) div {BLOCK_CLASSES}) + 1").alias("sides")),
        "unsettled-buckets",
    )
    in_question = materialize(labelled.join(unsettled, "bucket"), "in-question")
    # classes that share buckets get the same home, in most cases; a home is cut into tiles of bounded size
    homes = materialize(in_question.groupBy("rep").agg(F.min("least").alias("home"), F.any_value("n").alias("n")), "homes")
    tiles = F.greatest(F.expr(f"int((count(*) - 1) div {BLOCK_CLASSES}) + 1"), F.expr(f"int(sum(n) div {TILE_SHINGLES}) + 1"))
    cut = materialize(homes.groupBy("home").agg(tiles.alias("tiles")), "tiles")
    homes = homes.join(cut, "home").select("rep", "home", F.pmod(F.xxhash64("rep"), "tiles").cast("int").alias("tile"))
    open_classes = materialize(homes.join(classes.select("rep", "signature"), "rep"), "open-classes")
    squares = (
        in_question.join(open_classes, "rep")
        .withColumn("side", F.pmod(F.xxhash64("home", "tile"), "sides").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        .select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "n", "comp", "home", "tile", "signature")
    )
    square = ["home_i", "tile_i", "home_j", "tile_j"]
    possible = squares.groupBy("bucket", "i", "j").applyInArrow(_possible_squares(percent, slots), "home_i long, tile_i int, home_j long, tile_j int").distinct()
    possible = materialize(possible, "possible-squares")
    both_tiles = F.array_distinct(F.array(F.struct(F.col("home_i").alias("home"), F.col("tile_i").alias("tile")), F.struct(F.col("home_j").alias("home"), F.col("tile_j").alias("tile"))))
    comps = in_question.groupBy("rep").agg(F.min("comp").alias("comp"))
    placed = open_classes.select("rep", "home", "tile").join(comps, "rep")
    placed = placed.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("home", "tile", "rep", "comp", "text")
    told = possible.select(*square, F.explode(both_tiles).alias("t")).select(*square, "t.home", "t.tile").join(placed, ["home", "tile"]).select(*square, "rep", "comp", "text")
    more = told.groupBy(*square).applyInArrow(_settle_square(width, percent), "a long, b long")
    groups = materialize(components(materialize(links.unionByName(more), "all-links")), "groups")

    known = classes.select("set_key", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(known, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole documents table: four-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, sym.b FROM reach JOIN sym ON sym.a = reach.r),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.c AS component_id, d.doc_id = comp.c AS kept
FROM documents d JOIN comp ON comp.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
