"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Target weights become whole slots of a period: source i gets c_i of P slots. Its k-th block (from 0) has
release floor(k P / c_i) and deadline ceil((k + 1) P / c_i), and in every slot the released block with the
earliest deadline runs. As the slots are used up exactly, every block lies in its window, so in every
prefix of the schedule a source is less than one block away from its weight. The schedule depends on the
weights alone and repeats every period, so one period is worked out (an aggregate over its slots, on one
row of all sources) and block b of source i goes to slot (b div c_i) P + slot_i(b mod c_i).

Within its source a document's place is its rank by md5 of doc_id. The rank is found without sorting a
source as one group: the md5 range is cut into pieces of about RANGE_DOCS documents, counted, and ranked
piece by piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.tables import materialize, table

PERIOD = 1000
BLOCK_DOCS = 16
RANGE_DOCS = 1000


#: Helper columns are named with this prefix, which columns of docs may not have.
OWN = "__mix_"


def target_slots(sizes: DataFrame, period: int = PERIOD) -> DataFrame:
    """(mix_source, n_docs, target) -> the same with period and slots: slots of a period in proportion to target.

    Largest remainders fill the period; every source gets one slot at least, a period of fewer than four
    slots per source is lengthened. The table has one row per source.
    """
    everything = Window.partitionBy(F.lit(1))
    spread = sizes.withColumn("period", F.greatest(F.lit(period), 4 * F.count("*").over(everything)))
    spread = spread.withColumn("share", (F.col("period") - F.count("*").over(everything)) * F.col("target") / F.sum("target").over(everything))
    spread = spread.withColumn("whole", F.floor("share"))
    spare = F.col("period") - F.count("*").over(everything) - F.sum("whole").over(everything)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("share") - F.col("whole"), 9)), "mix_source"))
    return spread.withColumn("slots", (1 + F.col("whole") + (place <= spare).cast("long")).cast("long")).select("mix_source", "n_docs", "period", "slots")


def period_schedule(weights: DataFrame) -> DataFrame:
    """Earliest deadline first over one period: (mix_source, nth, slot, slots, period), one row per slot.

    The sources of one period are one row, and a slot looks at each of them: the time is that of the period
    times the number of sources, so this is for up to a few thousand sources (1,000 take seconds). It does
    not depend on the number of documents.
    """
    one = weights.groupBy().agg(F.sort_array(F.collect_list(F.struct("mix_source", "slots"))).alias("s"), F.first("period").cast("long").alias("p")).where("p is not null")
    step = """
      aggregate(
        sequence(0L, p - 1),
        named_struct('next', transform(s, x -> 0L), 'out', cast(array() as array<int>)),
        (acc, t) -> transform(
          array(array_min(transform(filter(sequence(0, size(s) - 1),
            i -> acc.next[i] < s[i].slots and (acc.next[i] * p) div s[i].slots <= t),
            i -> struct(((acc.next[i] + 1) * p + s[i].slots - 1) div s[i].slots as deadline, i as i))).i),
          pick -> named_struct('next', transform(acc.next, (n, i) -> if(i = pick, n + 1, n)), 'out', concat(acc.out, array(pick)))
        )[0]
      ).out"""
    slots = one.select("s", "p", F.posexplode(F.expr(step)).alias("slot", "i")).select(F.expr("s[i].mix_source").alias("mix_source"), F.expr("s[i].slots").alias("slots"), F.col("p").alias("period"), F.col("slot").cast("long").alias("slot"))
    nth = F.row_number().over(Window.partitionBy("mix_source").orderBy("slot")) - 1
    return slots.withColumn("nth", nth.cast("long"))


def _targets(sizes: DataFrame, weights: dict[str, float] | DataFrame | None) -> DataFrame:
    """sizes with target: the given weight of each source, or the root of its size where no weights are given."""
    if weights is None:
        return sizes.withColumn("target", F.sqrt("n_docs"))
    if isinstance(weights, dict):
        weights = sizes.sparkSession.createDataFrame(list(weights.items()), "mix_source string, target double")
    named = weights.select(F.coalesce(F.col(weights.columns[0]).cast("string"), F.lit("")).alias("mix_source"), F.col(weights.columns[1]).cast("double").alias("target"))
    named = named.groupBy("mix_source").agg(F.max("target").alias("target"))
    return sizes.join(named, "mix_source", "left").withColumn("target", F.greatest(F.coalesce("target", F.lit(0.0)), F.lit(1e-9)))


def mix(docs: DataFrame, source: str = "source", block_docs: int = BLOCK_DOCS, period: int = PERIOD, weights: dict[str, float] | DataFrame | None = None) -> DataFrame:
    """docs, all rows and columns, with mix_rank, mix_block, mix_slot, mix_release, mix_deadline.

    weights gives the target weight of each source, as a dictionary or as a table (source, weight) of one row
    per source; without it, weights are the roots of the sources' sizes. A source without a weight, or with
    none above 0, gets the least share there is, one slot of a period. Reading by (mix_slot, mix_rank) gives the
    mixture. mix_rank counts a source's documents from 0, mix_block is its block of block_docs documents. While
    every source lasts, the deviation bound holds; afterwards the slots of exhausted sources stay empty and
    nothing is dropped or repeated.

    Defined cases: a null source counts as the source ''; rows with a null doc_id rank by a hash of the whole
    row and so are spread like others; equal doc_ids, and equal rows, rank next to each other in any order; an
    empty table gives an empty result; columns of docs keep their values, those named mix_rank, mix_block,
    mix_slot, mix_release and mix_deadline are replaced. Helper columns are named __mix_*, and docs may have no
    columns of such names.
    """
    added = ["mix_rank", "mix_block", "mix_slot", "mix_release", "mix_deadline"]
    src, key, n, piece, within, before, nth, slots, per, slot, rank, block = (OWN + x for x in ("source", "key", "n", "piece", "within", "before", "nth", "slots", "period", "slot", "rank", "block"))
    plain = [F.col(c).cast("string") for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    whole_row = F.concat(F.lit("row "), F.xxhash64(*[F.coalesce(c, F.lit("")) for c in plain]).cast("string"))
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), whole_row).cast("binary"))
    keyed = docs.withColumn(src, F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn(key, md5)
    sizes = materialize(keyed.groupBy(F.col(src).alias("mix_source")).agg(F.count("*").alias("n_docs")), "source-sizes")
    schedule = materialize(period_schedule(target_slots(_targets(sizes, weights), period)), "period-schedule")
    sized = sizes.select(F.col("mix_source").alias(src), F.col("n_docs").alias(n))
    at = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32) * F.ceil(F.col(n) / RANGE_DOCS)).cast("long")
    cut = keyed.join(sized, src).withColumn(piece, at).drop(n)
    counts = materialize(cut.groupBy(src, piece).agg(F.count("*").alias(n)), "piece-sizes")
    offsets = materialize(counts.select(src, piece, (F.sum(n).over(Window.partitionBy(src).orderBy(piece)) - F.col(n)).alias(before)), "piece-offsets")
    number = F.row_number().over(Window.partitionBy(src, piece).orderBy(key, "doc_id")) - 1
    ranked = cut.withColumn(within, number).join(offsets, [src, piece])
    ranked = ranked.withColumn(rank, (F.col(before) + F.col(within)).cast("long")).withColumn(block, F.expr(f"{rank} div {block_docs}"))
    planned = schedule.select(F.col("mix_source").alias(src), F.col("nth").alias(nth), F.col("slot").alias(slot), F.col("slots").alias(slots), F.col("period").alias(per))
    ranked = ranked.join(planned.select(src, slots, per).distinct(), src).withColumn(nth, F.col(block) % F.col(slots))
    placed = ranked.join(planned.select(src, nth, slot), [src, nth])
    base = F.expr(f"{block} div {slots}") * F.col(per)
    values = [F.col(rank), F.col(block), base + F.col(slot), base + F.expr(f"({nth} * {per}) div {slots}"), base + F.expr(f"(({nth} + 1) * {per} + {slots} - 1) div {slots}")]
    return placed.select(*[c for c in docs.columns if c not in added], *[v.alias(c) for v, c in zip(values, added, strict=True)])


def mixed_order(docs: DataFrame, weights: dict[str, float] | DataFrame | None = None) -> DataFrame:
    """docs with mix_slot, laid out in the order of the mixture; cases as in mix."""
    ordered = mix(docs, weights=weights).orderBy("mix_slot", "mix_rank")
    return ordered.drop("mix_rank", "mix_block", "mix_release", "mix_deadline")


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    """The schedule of every document of the table, with target weights in proportion to the root of source sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs)


OP7_SQL = f"""
WITH RECURSIVE sizes AS (SELECT coalesce(source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
p AS (SELECT greatest({PERIOD}, 4 * count(*)) AS period, count(*) AS k, sum(sqrt(n)) AS total FROM sizes),
share AS (SELECT src, n, (period - k) * sqrt(n) / total AS share, floor((period - k) * sqrt(n) / total) AS whole, period, k FROM sizes, p),
w AS (
  SELECT src, period, CAST(1 + whole + CASE WHEN row_number() OVER (ORDER BY round(share - whole, 9) DESC, src) <= period - k - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS c FROM share
), lists AS (SELECT list(src ORDER BY src) AS srcs, list(c ORDER BY src) AS cs, any_value(period) AS period FROM w),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(cs, lambda c: CAST(0 AS BIGINT)) AS nxt, CAST(NULL AS BIGINT) AS pick FROM lists
  UNION ALL
  SELECT t + 1, list_transform(nxt, lambda n, i: CASE WHEN i = chosen THEN n + 1 ELSE n END), chosen FROM (
    SELECT t, nxt, period, list_min(list_transform(list_filter(range(1, len(cs) + 1), lambda i: nxt[i] < cs[i] AND (nxt[i] * period) // cs[i] <= t + 1),
      lambda i: ((nxt[i] + 1) * period + cs[i] - 1) // cs[i] * 1000000 + i)) % 1000000 AS chosen
    FROM edf, lists WHERE t < period - 1)
), sched AS (
  SELECT srcs[pick] AS src, cs[pick] AS c, period, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM edf, lists WHERE pick IS NOT NULL
), r AS (
  SELECT doc_id, source, coalesce(source, '') AS src, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS mix_rank FROM documents
), b AS (SELECT r.*, mix_rank // {BLOCK_DOCS} AS mix_block, w.c, w.period FROM r JOIN w USING (src))
SELECT b.doc_id, b.source, b.mix_rank, b.mix_block, CAST((mix_block // b.c) * b.period + slot AS BIGINT) AS mix_slot,
  CAST((mix_block // b.c) * b.period + (nth * b.period) // b.c AS BIGINT) AS mix_release,
  CAST((mix_block // b.c) * b.period + ((nth + 1) * b.period + b.c - 1) // b.c AS BIGINT) AS mix_deadline
FROM b JOIN sched ON sched.src = b.src AND sched.nth = b.mix_block % b.c
"""
