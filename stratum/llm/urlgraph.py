"""URL filters: rules by host and path, and for the rest trust and distrust carried along links between hosts.

Pages that rules allow make their hosts trusted seeds, pages that rules block make theirs distrusted ones. Trust is a
personalised PageRank along the links, distrust one along the reversed links: a host that links to bad ones is suspect.
A page without a rule is blocked if its host has at least ``threshold`` of its trust and distrust in distrust. As only
the share counts, scores are carried on until none changes by more than a billionth of itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_key, cut, drop

#: (verdict, host and path), as stated by the filter's users.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 6, 0.6
#: Scores are final when a round changes none by more than this share of itself.
TOLERANCE = 1e-9
#: Edges, in both directions, that one task carries to the end; rounds from look to look beyond that.
LAST_EDGES, LOOK = 262_144, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?\s*([a-z][a-z0-9+.-]*://[^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_scores(seeds: DataFrame, links: DataFrame, rounds: int | None = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE, last: int | None = None) -> DataFrame:
    """host, trust and distrust after ``rounds`` rounds, from ``seeds`` (host, trust, distrust) and ``links`` (a, b, n).

    Both spread in one join: a link carries trust from a to b and distrust from b to a, each in proportion to its share
    of the links that leave a host in that direction. Links within a host carry nothing. Without ``rounds``, until a
    round changes no score by more than ``tolerance`` of itself: a score that has just left 0 changes by all of itself,
    so every host that a seed reaches is reached (up to some 4,000 links away, where scores underflow), and the greatest
    relative change never grows from round to round, so that none is missed between two looks. Graphs of up to ``last``
    (``LAST_EDGES``) edges are carried to the end by one task; of larger ones every ``LOOK``-th round is looked at.
    """
    links = links.where("a <> b")
    forward = links.join(links.groupBy("a").agg(F.sum("n").alias("all")), "a").select(F.col("a").alias("from"), F.col("b").alias("to"), (F.col("n") / F.col("all")).alias("trust_share"), F.lit(0.0).alias("distrust_share"))
    back = links.join(links.groupBy("b").agg(F.sum("n").alias("all")), "b").select(F.col("b").alias("from"), F.col("a").alias("to"), F.lit(0.0).alias("trust_share"), (F.col("n") / F.col("all")).alias("distrust_share"))
    edges = cut(forward.unionByName(back))
    scores = seeds
    if edges.isEmpty():
        return scores
    sums = [F.sum(c).alias(c) for c in ("trust", "distrust")]

    def carried(scores: DataFrame) -> DataFrame:
        shares = edges.join(scores, edges["from"] == scores["host"]).select(F.col("to").alias("host"), (damping * F.col("trust") * F.col("trust_share")).alias("trust"), (damping * F.col("distrust") * F.col("distrust_share")).alias("distrust"))
        return seeds.unionByName(shares)

    if rounds is not None:
        for i in range(rounds):
            scores = carried(scores).groupBy("host").agg(*sums)
            if i % 3 == 2:
                scores = cut(scores)
        return scores
    if edges.count() <= (LAST_EDGES if last is None else last):
        found = _carried_to_the_end(edges, scores, damping, tolerance)
        drop(edges)
        return found.unionByName(scores.join(found.select("host"), "host", "left_anti"))
    was = [F.sum(c).alias(c) for c in ("trust_was", "distrust_was")]
    none = [F.lit(0.0).alias(c) for c in ("trust", "distrust")]
    moved = " OR ".join(f"{c} - {c}_was > {tolerance!r} * {c}" for c in ("trust", "distrust"))
    read = None
    while True:
        for i in range(LOOK - 1):
            scores = carried(scores).groupBy("host").agg(*sums)
            if i % 3 == 2:
                scores = _instead(scores, read)
                read = scores
        before = scores.select("host", *none, F.col("trust").alias("trust_was"), F.col("distrust").alias("distrust_was"))
        ahead = carried(scores).withColumn("trust_was", F.lit(0.0)).withColumn("distrust_was", F.lit(0.0))
        looked = _instead(ahead.unionByName(before).groupBy("host").agg(*sums, *was), read)
        read, scores = looked, looked.select("host", "trust", "distrust")
        if looked.where(moved).isEmpty():
            drop(edges)
            return scores


def _instead(df: DataFrame, read: DataFrame | None) -> DataFrame:
    """``df`` as a table; the one that it was computed from isn't read again."""
    table = cut(df)
    if read is not None:
        drop(read)
    return table


def _carried_to_the_end(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Scores at convergence of the hosts that have links, in one task, for graphs of a bounded number of edges."""
    none = F.lit(None).cast("string").alias("to")
    linked = edges.select(F.col("from").alias("host")).distinct()
    starts = seeds.join(linked, "host", "left_semi").select(F.col("host").alias("from"), none, F.col("trust").alias("trust_share"), F.col("distrust").alias("distrust_share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        is_seed = table["to"].is_null().to_numpy()
        ends = pa.concat_arrays([c for name in ("from", "to") for c in table[name].chunks]).dictionary_encode()
        codes, hosts = ends.indices.fill_null(-1).to_numpy(zero_copy_only=False), ends.dictionary
        a, b = codes[: len(is_seed)], codes[len(is_seed) :]
        start, carried = np.zeros((2, len(hosts))), []
        for k, name in enumerate(("trust_share", "distrust_share")):
            share = table[name].to_numpy()
            np.add.at(start[k], a[is_seed], share[is_seed])
            some = ~is_seed & (share > 0)
            carried.append((a[some], b[some], damping * share[some]))
        score = start
        while True:
            after = np.stack([start[k] + np.bincount(b, score[k][a] * w, len(hosts)) for k, (a, b, w) in enumerate(carried)])
            done = (after - score <= tolerance * after).all()
            score = after
            if done:
                break
        yield pa.RecordBatch.from_arrays([hosts, pa.array(score[0]), pa.array(score[1])], ["host", "trust", "distrust"])

    rows = edges.select("from", "to", "trust_share", "distrust_share").unionByName(starts)
    return cut(rows.repartition(1).mapInArrow(run, "host string, trust double, distrust double"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ``://``, has empty host and path, fits no rule and is allowed: nothing is known of it.
    A host without seeds or links has no trust and no distrust and is allowed; a null or empty html has no links, a long
    one is read whole. Rows that share a page_id, or are null there, are judged each by its own url; repeated rows count
    as often in the scores. Hosts with very many pages are broadcast with their scores. Other columns are ignored,
    whatever their names; an empty table gives no rows. Scores are those at convergence; the SQL stops after ``ROUNDS``
    rounds, so it agrees only where pages don't link between hosts.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = base.withColumn("rule", rule).withColumn("ruled", verdict)
    counts = cut(ruled.groupBy("host").agg(F.sum(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("good"), F.sum(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("bad"), F.count(F.lit(1)).alias("n")))
    seeds = cut(counts.where("host <> ''").select("host", (F.col("good") / F.col("n")).alias("trust"), (F.col("bad") / F.col("n")).alias("distrust")))
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), 1)
    targets = base.where("host <> ''").select(F.col("host").alias("a"), F.explode(hrefs).alias("url")).select("a", host_of(F.col("url")).alias("b"))
    links = targets.where("b <> '' AND a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    scores = host_scores(seeds, links, rounds=None).where("trust > 0 OR distrust > 0")
    known = cut(scores.join(counts.select("host", "n"), "host", "left"))
    n_known = known.count()
    narrow = ruled.drop("html")
    joined = narrow.join(F.broadcast(known), "host", "left") if n_known <= BROADCAST_ROWS else by_key(narrow, known, "host", "n", pages.count())
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when((distrust > 0) & (distrust >= threshold * (trust + distrust)), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def _oracle() -> str:
    fits = []
    for kind, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits.append((f"(host = '{rule_host}' OR ends_with(host, '.{rule_host}')) AND starts_with(path, '{slash}{rule_path}')", text, kind))
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    host = lambda c: lower.format(f"regexp_extract(coalesce({c}, ''), '(?s)^.*?://([^/?#]*)', 1)")
    rounds = "".join(
        f""", s{i + 1} AS (
  SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (SELECT * FROM s0 UNION ALL
    SELECT e.t, {DAMPING} * s.trust * e.ts, {DAMPING} * s.distrust * e.ds FROM edges e JOIN s{i} s ON e.f = s.host) GROUP BY host)"""
        for i in range(ROUNDS)
    )
    href = _HREF.replace("'", "''")
    return f"""
WITH base AS (
  SELECT page_id, {host("url")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages
), ruled AS (SELECT *, {case(1)} AS rule, {case(2)} AS ruled FROM base
), s0 AS (
  SELECT host, sum(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE ELSE 0 END) / count(*) AS trust, sum(CASE WHEN ruled = 'block' THEN 1.0::DOUBLE ELSE 0 END) / count(*) AS distrust FROM ruled WHERE host <> '' GROUP BY host
), urls AS (SELECT host AS a, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)) AS url FROM base WHERE host <> ''
), links AS (SELECT a, b, count(*) AS n FROM (SELECT a, {host("url")} AS b FROM urls) WHERE b <> '' AND a <> b GROUP BY ALL
), edges AS (
  SELECT a AS f, b AS t, n / sum(n) OVER (PARTITION BY a) AS ts, 0.0::DOUBLE AS ds FROM links UNION ALL
  SELECT b, a, 0.0::DOUBLE, n / sum(n) OVER (PARTITION BY b) FROM links
){rounds}
SELECT page_id, r.host, path, rule,
  coalesce(ruled, CASE WHEN coalesce(distrust, 0) > 0 AND distrust >= {THRESHOLD} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0.0::DOUBLE) AS trust, coalesce(distrust, 0.0::DOUBLE) AS distrust
FROM ruled r LEFT JOIN (SELECT * FROM s{ROUNDS} WHERE trust > 0 OR distrust > 0) s ON r.host = s.host
"""


ORACLE = _oracle()
