"""Merkle manifest of a dataset: checkpoint-and-recompute.

Every document is a leaf, every source a tree of fan-out FAN over its leaves by ascending doc_id, and the trees'
roots are the leaves of one more tree. Of a tree only every LEVELS-th level is kept as a table: an aligned
subtree of FAN ** LEVELS nodes is climbed in one task and only its top is written. To extract proofs, a task takes
such a subtree's kept nodes and the path of its top, works out the missing levels in between, emits every node's
siblings and forgets the levels. So a task holds one aligned subtree, however large a source is.

Leaves are numbered without a window over a source: rows are dealt by ranges of (source, doc_id), and small counts per
range and source give the offsets. Texts are read once, to make the leaves; after that only digests move.

Defined cases: null fields have a mark of their own; a null source is a tree of its own and the first one; null
doc_ids come first within their source; rows that repeat a doc_id stand next to each other in the order of their leaves; a
single leaf is its tree's root, and a single tree's root the whole root; an empty table has no leaf, no root and
no proof. Only doc_id, source, lang, n_chars and text are read, so further columns may have any names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.tables import discard, materialize, table

FAN, LEVELS = 16, 3
CHUNK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "before array<string>, after array<string>"


def _field(value: Column) -> Column:
    """A value with its length in bytes before it; '-' for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a document row; columns given by name take the place of its own."""
    return F.sha2(F.concat(*(_field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def folded(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to, as an expression over the two arrays of siblings."""
    return F.aggregate(F.arrays_zip(before.alias("before"), after.alias("after")), leaf, lambda digest, run: F.sha2(F.concat(run["before"], digest, run["after"]), 256))


def _placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with a tree, with their place pos in it (from 0, by order) and the tree's size n.

    order must tell all rows apart that differ; `row` in it spreads equal ones over ranges.
    """
    dealt = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), name)  # the range's number, then the row's in it
    part = F.shiftright("at", 33)
    spans = dealt.groupBy(part.alias("part"), "tree").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("part", "tree", "first", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("offset"), F.sum("here").over(tree).alias("n"))
    placed = dealt.withColumn("part", part).join(spans, ["part", "tree"])
    return placed.select(*nodes.columns, (F.col("offset") + F.col("at") - F.col("first")).alias("pos"), "n")


def _height(n: int, most: int = LEVELS) -> int:
    """Levels above n nodes until one is left, most at most."""
    up = 0
    while n > 1 and up < most:
        n, up = -(-n // FAN), up + 1
    return up


def _climbed(digests: list[str], n: int) -> list[list[str]]:
    """The levels of an aligned subtree of a level of n nodes, its own nodes first."""
    levels = [digests]
    for _ in range(_height(n)):
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + FAN]).encode()).hexdigest() for i in range(0, len(below), FAN)])
    return levels


def _top(key: tuple, t: pa.Table) -> pa.Table:
    """An aligned subtree's nodes -> its top, a node of the next kept level."""
    t, n = t.sort_by("pos"), t.column("n")[0].as_py()
    top = _climbed(t.column("digest").to_pylist(), n)[-1][0]
    return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": pa.array([-(-n // CHUNK)], pa.int64()), "digest": [top]})


def _chunked(nodes: DataFrame, *columns: str) -> DataFrame:
    return nodes.select("tree", F.expr(f"pos div {CHUNK}").alias("chunk"), "pos", "n", "digest", *columns)


def _kept_levels(bottom: DataFrame, name: str) -> list[DataFrame]:
    """A level and every LEVELS-th above it, as tables, until each tree has one node."""
    levels = [bottom]
    while not levels[-1].where("n > 1").isEmpty():
        tops = _chunked(levels[-1]).groupBy("tree", "chunk").applyInArrow(_top, "tree string, pos long, n long, digest string")
        levels.append(materialize(tops, f"{name}-{LEVELS * len(levels)}"))
    return levels


def _paths(carried: list[str]):
    """An aligned subtree's nodes and the path of its top -> the path of each node.

    The levels between are worked out anew from the nodes and forgotten with the task's return.
    """

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        levels = _climbed(nodes.column("digest").to_pylist(), nodes.column("n")[0].as_py())
        rest = {c: above.column(c)[0].as_py() for c in ("before", "after", "subroot", "root")}
        before, after = [], []
        for i in range(len(nodes)):
            left, right = [], []
            for level in levels[:-1]:
                start = i - i % FAN
                left.append("".join(level[start:i]))
                right.append("".join(level[i + 1 : start + FAN]))
                i //= FAN
            before.append(left + rest["before"])
            after.append(right + rest["after"])
        out = {c: nodes.column(c) for c in ("tree", "pos", "digest", *carried)}
        out |= {c: pa.array([rest[c]] * len(nodes), pa.string()) for c in ("subroot", "root")}
        return pa.table(out | {"before": pa.array(before, pa.list_(pa.string())), "after": pa.array(after, pa.list_(pa.string()))})

    return run


def _descend(levels: list[DataFrame], top: DataFrame, carried: str = "") -> DataFrame:
    """Paths of the nodes of the lowest level, from the paths (tree, subroot, root, before, after) of the trees' own roots."""
    path = top.withColumn("pos", F.lit(0).cast("long"))
    if len(levels) == 1:  # every leaf is its tree's root
        return levels[0].join(path.drop("pos"), "tree")
    for number, level in reversed(list(enumerate(levels[:-1]))):
        extra = carried if number == 0 else ""
        names = [x.split()[0] for x in extra.split(", ") if x]
        above = path.select("tree", F.col("pos").alias("chunk"), "subroot", "root", "before", "after")
        pairs = _chunked(level, *names).groupBy("tree", "chunk").cogroup(above.groupBy("tree", "chunk"))
        path = pairs.applyInArrow(_paths(names), f"tree string, pos long, digest string, {extra + ', ' if extra else ''}subroot string, root string, {PATH}")
    return path


@dataclass
class Manifest:
    """The kept levels of the sources' trees and of the tree over their roots, lowest first.

    sources[0]: tree, doc_id, digest, forged, pos, n; other levels: tree, pos, n, digest. tree is '' for a
    null source, else 's' and the source; in top all nodes are of the tree ''.
    """

    sources: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> DataFrame:
        """One row with the root's digest; none for an empty dataset."""
        return self.top[-1].select(F.col("digest").alias("root"))

    def subroots(self) -> DataFrame:
        """source, n_rows, subroot."""
        size = self.sources[0].groupBy("tree").agg(F.count("*").alias("n_rows"))
        source = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
        return self.sources[-1].join(size, "tree").select(source.alias("source"), "n_rows", F.col("digest").alias("subroot"))

    def proofs(self) -> DataFrame:
        """Per row: doc_id, leaf, forged, subroot, root, and before / after: what stands left and right of the row's node in its run, level by level."""
        no_siblings = F.array().cast("array<string>")
        peak = self.top[-1].select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), no_siblings.alias("before"), no_siblings.alias("after"))
        crown = _descend(self.top, peak, "name string")
        crown = materialize(crown.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "before", "after"), "crown")
        out = _descend(self.sources, crown, "doc_id long, forged string")
        return out.select("doc_id", F.col("digest").alias("leaf"), "forged", "subroot", "root", "before", "after")


def build(docs: DataFrame, forged: Column | None = None) -> Manifest:
    """The manifest of a table; forged is a text that takes a row's own to see whether its proof tells (null: none)."""
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    text = F.lit(None).cast("string") if forged is None else forged
    other = F.when(text.isNotNull(), leaf_digest(text=text))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), other.alias("forged"))
    leaves = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = materialize(_placed(leaves, ["doc_id", "digest", "row"], "leaves-in-order").drop("row"), "placed-leaves")
    discard(leaves)
    sources = _kept_levels(placed, "tree-level")
    subroots = sources[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = materialize(_placed(subroots, ["name"], "subroots-in-order"), "placed-subroots")
    return Manifest(sources, _kept_levels(top, "top-level"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole documents table: a proof per row, and what a row that was tampered with folds to."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", CAPITALS, SMALL))
    proofs = build(docs, tampered).proofs()
    runs = F.arrays_zip("before", "after")
    siblings = F.array_join(F.transform(runs, lambda run: F.concat(run["before"], run["after"])), "")
    out = proofs.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("before"), F.col("after")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, bottom: str, levels: int) -> str:
    """CTEs {name}0..: the nodes (tree, pos, n, d, leaf) of each level, and {name}p: siblings and folding parts of each leaf's path."""
    parts = [bottom]
    for k in range(1, levels + 1):
        parts.append(
            f"""{name}{k} AS (SELECT tree, pos // {FAN} AS pos, CASE WHEN any_value(n) = 1 THEN 1 ELSE (any_value(n) + {FAN - 1}) // {FAN} END AS n,
  CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {name}{k - 1} GROUP BY tree, pos // {FAN})"""
        )
        parts.append(
            f"""{name}s{k} AS (SELECT x.tree, x.pos, CASE WHEN x.n > 1 THEN coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') END AS l,
  CASE WHEN x.n > 1 THEN coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') END AS r
  FROM {name}{k - 1} x JOIN {name}{k - 1} y ON x.tree = y.tree AND x.pos // {FAN} = y.pos // {FAN} GROUP BY x.tree, x.pos, x.n)"""
        )
    return ",\n".join(parts)


#: Sources of up to FAN ** 5 documents and up to FAN ** 2 sources: more than any test table has.
_DEEP, _WIDE = 5, 2


def _fold_sql(names: list[tuple[str, int, str]], start: str) -> tuple[str, str, str]:
    """(siblings, folded digest, joins) as SQL over aliases of the path's levels."""
    siblings, digest, joins = [], start, []
    for name, levels, (tree, pos) in names:
        for k in range(1, levels + 1):
            a = f"j{name}{k}"
            joins.append(f"JOIN {name}s{k} {a} ON {a}.tree = {tree} AND {a}.pos = {pos} // {FAN ** (k - 1)}")
            siblings.append(f"coalesce({a}.l || {a}.r, '')")
            joins.append(f", LATERAL (SELECT CASE WHEN {a}.l IS NULL THEN {digest} ELSE sha256({a}.l || {digest} || {a}.r) END AS f) f{name}{k}")
            digest = f"f{name}{k}.f"
    return " || ".join(siblings), digest, "\n".join(joins)


def _op11_sql() -> str:
    def field(c):
        return f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')"

    def leaf(text):
        return f"sha256({' || '.join(field(c) for c in ('CAST(doc_id AS VARCHAR)', 'source', 'lang', 'CAST(n_chars AS VARCHAR)', text))})"

    # DuckDB has no crc32: its remainder by 5 from a table of the 256 steps, over the digits of the id
    crc = f"""list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, {_crc_table_sql("xor(c, b) & 255")}))"""
    lowered = f"translate(text, '{CAPITALS}', '{SMALL}')"
    siblings, digest, joins = _fold_sql([("s", _DEEP, ("d.tree", "d.pos")), ("t", _WIDE, ("top.tree", "top.pos"))], "d.start")
    return f"""
WITH docs AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {leaf("text")} AS d, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(lowered)} END AS forged FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs),
{_tree_sql("s", "s0 AS (SELECT tree, pos, n, d FROM placed)", _DEEP)},
{_tree_sql("t", f"t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, d, tree AS name FROM s{_DEEP})", _WIDE)},
d AS (SELECT doc_id, tree, pos, d AS leaf, coalesce(forged, d) AS start FROM placed)
SELECT d.doc_id, d.leaf, top.d AS subroot, root.d AS root, sha256({siblings}) AS proof_sha256, {digest} AS folded_root, {digest} = root.d AS verified
FROM d JOIN t0 top ON top.name = d.tree CROSS JOIN t{_WIDE} root
{joins}
"""


def _crc_table_sql(index: str) -> str:
    """Eight steps of the reflected CRC-32 on a byte, as nested expressions would be huge: a list of its 256 results, worked out here."""
    steps = []
    for byte in range(256):
        c = byte
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        steps.append(c)
    return f"([{', '.join(map(str, steps))}]::BIGINT[])[({index}) + 1]"


OP11_SQL = _op11_sql()
