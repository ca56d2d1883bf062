"""URL filters: fixed rules, then link-graph propagation, in DataFrame operations only.

Edges run between hosts: hyperlinks of a page to another host, resolved against the page's own url and
weighted by their number, and both ways between a host and its parent below the registered domain
(www.a.example.com and a.example.com). Trusted seeds are the hosts of allow-ruled pages, blocked seeds those of
block-ruled pages, each in proportion to its ruled pages. Trust follows the links; distrust follows them
backwards, to those who link to blocked seeds. Both are personalised PageRank; a host is blocked when its
distrust outweighs its trust and is above a threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.tables import materialize, table

#: Action, host, path of each rule.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
#: A host's distrust counts from this share of what an average blocked seed starts from.
LEAST_SHARE = 0.05
#: Longest walks that count, in links. All longer ones together hold 0.85^25 = 1.7 % of the seeds' mass, and a
#: chain of single links falls below LEAST_SHARE after 18.
ROUNDS = 24
#: Rounds whose joins make up one job; then the ranks are written to the shared folder.
ROUNDS_A_JOB = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_urls(pages: DataFrame) -> DataFrame:
    """pages' page_id and html with host and path; both empty for a null url or one without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        "page_id",
        F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, pattern, 2).alias("path"),
        "html",
    )


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """Add rule (host and path of the longest rule that fits, else null) and rule_action."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # longer rules are put on top
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, action = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return urls.withColumn("rule", rule).withColumn("rule_action", action)


HREF = r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)^(?:https?:)?//([^/?#]+)"


def host_edges(urls: DataFrame) -> DataFrame:
    """(src, dst, weight): links of pages of src to dst, and parent links of weight 1.

    A link without a host of its own is resolved against its page's url and so stays on its host.
    """
    paged = urls.where("host <> ''")
    links = paged.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1)).alias("href"))
    target = F.translate(F.regexp_extract("href", TARGET, 1), UPPER, LOWER)
    links = links.select("src", F.when(target == "", F.col("src")).otherwise(target).alias("dst")).where("src <> dst")
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = paged.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    child = hosts.where(F.size(F.split("host", r"\.")) > 3).select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst"))
    both = child.unionByName(child.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """Personalised PageRank of seeds (host, trust0, distrust0) over edges: (host, trust, distrust).

    Trust follows src to dst in proportion to weight over the weights out of src, distrust follows dst to
    src over the weights into dst. What a round passes on is kept apart from what has arrived, so a round
    touches only hosts that got something in the last one, and the work ends when nothing moves any more.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("all_out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("all_in"))
    shares = edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("weight") / F.col("all_out")).alias("down"), (F.col("weight") / F.col("all_in")).alias("up"))
    zero = F.lit(0.0)
    moves = shares.select(F.col("src").alias("host"), F.col("dst").alias("to"), "down", zero.alias("up")).unionByName(shares.select(F.col("dst").alias("host"), F.col("src").alias("to"), zero.alias("down"), "up"))
    moves = materialize(moves.groupBy("host", "to").agg(F.sum("down").alias("down"), F.sum("up").alias("up")), "moves")
    rest = 1 - damping
    start = seeds.select("host", (rest * F.col("trust0")).alias("trust"), (rest * F.col("distrust0")).alias("distrust"))
    arrived, moving = [start], start.where("trust > 0 or distrust > 0")
    for at in range(0, rounds, ROUNDS_A_JOB):
        told = []
        for step in range(at, min(at + ROUNDS_A_JOB, rounds)):
            sent = moves.join(moving, "host").select(F.col("to").alias("host"), (damping * F.col("down") * F.col("trust")).alias("trust"), (damping * F.col("up") * F.col("distrust")).alias("distrust"))
            moving = sent.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
            told.append(moving.withColumn("step", F.lit(step)))
        job = told[0]
        for more in told[1:]:
            job = job.unionByName(more)
        job = materialize(job, "ranks")
        arrived.append(job.select("host", "trust", "distrust"))
        moving = job.where(F.col("step") == min(at + ROUNDS_A_JOB, rounds) - 1).select("host", "trust", "distrust").where("trust > 0 or distrust > 0")
        if moving.isEmpty():
            break
    total = arrived[0]
    for more in arrived[1:]:
        total = total.unionByName(more)
    return total.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    Defined cases: a null url or one without :// has empty host and path, no rule and the verdict allow; a
    null html has no links; repeated rows count as further evidence; null page_ids are kept; equal trust and
    distrust allow; without blocked seeds all is allowed; an empty table gives an empty result. Other columns
    than page_id, url and html are not read.
    """
    urls = with_rules(split_urls(pages), rules)
    acted = [F.sum((F.coalesce("rule_action", F.lit("")) == act).cast("double")).alias(name) for act, name in (("allow", "allowed"), ("block", "blocked"))]
    hosts = materialize(urls.where("host <> ''").groupBy("host").agg(*acted), "hosts")
    total = hosts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"), F.sum((F.col("blocked") > 0).cast("long")).alias("n")).first()
    seeds = hosts.select("host", (F.col("allowed") / (total.allowed or 1.0)).alias("trust0"), (F.col("blocked") / (total.blocked or 1.0)).alias("distrust0"))
    ranks = propagate(seeds, materialize(host_edges(urls), "host-edges"))
    least = LEAST_SHARE * (1 - DAMPING) / (total.n or 1)
    # rounded, so that equal ranks are equal whatever the order of their sums
    worse = (F.round(F.col("distrust") / least, 6) > F.round(F.col("trust") / least, 6)) & (F.round(F.col("distrust") / least, 6) > 1)
    blocked = ranks.where(worse).select("host", F.lit(True).alias("host_blocked"))
    out = urls.drop("html").join(blocked, "host", "left")
    verdict = F.coalesce("rule_action", F.when(F.col("host_blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Judge every url of the pages table."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _sql() -> str:
    fits = [(h + p, a, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for a, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, _, c in fits) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for _, a, c in fits) + " END"
    rounds = "".join(
        f""", r{i + 1} AS MATERIALIZED (SELECT m.dst AS host, sum({DAMPING} * m.down * r.trust) AS trust, sum({DAMPING} * m.up * r.distrust) AS distrust
  FROM moves m JOIN r{i} r ON r.host = m.src GROUP BY m.dst)"""
        for i in range(ROUNDS)
    )
    everything = " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(ROUNDS + 1))
    least = LEAST_SHARE * (1 - DAMPING)
    href = HREF.replace('\\"', '"').replace("'", "''")
    return rf"""
WITH u AS (
  SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), j AS (SELECT *, {rule} AS rule, {action} AS act FROM u),
h AS (SELECT host, sum(CASE WHEN act = 'block' THEN 1 ELSE 0 END) AS blocked, sum(CASE WHEN act = 'allow' THEN 1 ELSE 0 END) AS allowed FROM j WHERE host <> '' GROUP BY host),
tot AS (SELECT greatest(sum(allowed), 1) AS a, greatest(sum(blocked), 1) AS b, greatest(sum(CASE WHEN blocked > 0 THEN 1 ELSE 0 END), 1) AS n FROM h),
r0 AS (SELECT host, (1 - {DAMPING}) * allowed / a AS trust, (1 - {DAMPING}) * blocked / b AS distrust FROM h, tot),
l0 AS (SELECT host AS src, translate(regexp_extract(href, '{TARGET}', 1), '{UPPER}', '{LOWER}') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '{href}', 1)) AS href FROM j WHERE host <> '')),
l1 AS (SELECT src, dst, count(*) AS w FROM l0 WHERE dst <> '' AND src <> dst GROUP BY src, dst),
k AS (SELECT host FROM h UNION SELECT dst FROM l1),
ch AS (SELECT host, regexp_replace(host, '^[^.]*\.', '') AS parent FROM k WHERE len(string_split(host, '.')) > 3),
e AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM l1 UNION ALL SELECT host, parent, 1 FROM ch UNION ALL SELECT parent, host, 1 FROM ch) GROUP BY src, dst),
s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS down, w / sum(w) OVER (PARTITION BY dst) AS up FROM e),
moves AS (SELECT src, dst, sum(down) AS down, sum(up) AS up FROM (SELECT src, dst, down, 0.0 AS up FROM s UNION ALL SELECT dst, src, 0.0, up FROM s) GROUP BY src, dst){rounds},
ranks AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM ({everything}) GROUP BY host),
blocked AS (SELECT host FROM ranks, tot WHERE round(distrust / ({least} / n), 6) > round(trust / ({least} / n), 6) AND round(distrust / ({least} / n), 6) > 1)
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""


OP9_SQL = _sql()
