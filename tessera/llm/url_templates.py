"""URL filters (2): a path-template tree per host, with wildcards, merged branches and smoothed labelled purity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import only, staged, table

#: (verdict, host and path prefix) that decide before the templates do.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Levels of the tree on which wide nodes are found and branches merged; deeper segments stay as they are, items as `*`.
DEPTH = 4
#: A tree node's children become one wildcard if it has so many different ones, and so many per page.
WIDE_CHILDREN, WIDE_SHARE = 20, 0.3
#: Branches whose labels differ from their siblings' by at most so many standard errors, and whose continuations differ by
#: at most the Hoeffding bound of this risk, are merged.
SIMILAR, RISK = 1.96, 0.05
#: Weight of the prior (half good, half bad), and the share of bad from which a template is rejected.
PRIOR, REJECT = 2.0, 0.8

#: Templates that are broadcast to the pages at most, and over how many tasks a template's pages are dealt beyond.
BROADCAST_TEMPLATES, SALTS = 200_000, 16

#: A segment that names an item rather than a place: with digits, or long hexadecimal.
ITEM = r"^(?:.*[0-9].*|[0-9a-fA-F-]{16,})$"


def split_url(url) -> tuple[F.Column, F.Column]:
    """Host and path columns; both are empty where the url is null or has no `://`."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def first_rule(host, path, rules) -> F.Column:
    """The longest rule that fits as (verdict, rule), else null. A rule fits its host and that host's subdomains."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _merged(leaves: DataFrame) -> DataFrame:
    """(host, template, s, n, bad, good) with cluster: the template with similar sibling branches as `~`, level by level.

    Siblings are the children of one node of the merged tree that are most often followed alike. A branch joins the others if what follows it is
    distributed alike (half the sum of absolute differences within the Hoeffding bound of both counts) and, where both
    it and the others hold labelled pages, their shares of bad ones differ by no more than SIMILAR standard errors.
    """
    bound = math.sqrt(math.log(2 / RISK) / 2)
    leaves = leaves.withColumn("cluster", F.lit(""))
    for d in range(1, DEPTH + 1):
        there = F.size("s") >= d
        rest = F.array_join(F.transform(F.slice("s", d + 1, F.greatest(F.size("s") - d, F.lit(0))), lambda x: F.when(x.isin("*", ""), x).otherwise(F.lit("~"))), "/")
        leaves = leaves.withColumn("seg", F.when(there, F.try_element_at("s", F.lit(d)))).withColumn("rest", rest)
        live = leaves.where(there)
        sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
        kinds = live.groupBy("host", "cluster", "seg", "rest").agg(*sums)
        branch = kinds.groupBy("host", "cluster", "seg").agg(*[F.sum(c).alias(f"b_{c}") for c in ("n", "bad", "good")], F.max(F.struct("n", "rest"))["rest"].alias("usual"))
        family = branch.groupBy("host", "cluster", "usual").agg(*[F.sum(f"b_{c}").alias(f"f_{c}") for c in ("n", "bad", "good")], F.count("*").alias("f_branches"))
        kinds = kinds.join(branch, ["host", "cluster", "seg"])
        follow = kinds.groupBy("host", "cluster", "usual", "rest").agg(F.sum("n").alias("r_n"))
        share = F.col("n") / F.col("b_n") - (F.col("r_n") - F.col("n")) / (F.col("f_n") - F.col("b_n"))
        tested = kinds.join(family.where("f_branches > 1"), ["host", "cluster", "usual"]).join(follow, ["host", "cluster", "usual", "rest"])
        apart = tested.groupBy("host", "cluster", "seg", "b_n", "b_bad", "b_good", "f_n", "f_bad", "f_good").agg(F.sum(F.greatest(share, F.lit(0.0))).alias("apart"))
        n, m = F.col("b_bad") + F.col("b_good"), F.col("f_bad") + F.col("f_good") - F.col("b_bad") - F.col("b_good")
        p = (F.col("f_bad") + 1) / (F.col("f_bad") + F.col("f_good") + 2)
        differ = F.abs(F.col("b_bad") / F.nullif(n, F.lit(0)) - (F.col("f_bad") - F.col("b_bad")) / F.nullif(m, F.lit(0)))
        alike = (n == 0) | (m == 0) | (differ <= SIMILAR * F.sqrt(p * (1 - p) * (1 / F.nullif(n, F.lit(0)) + 1 / F.nullif(m, F.lit(0)))))
        similar = (F.col("apart") <= bound * (1 / F.sqrt("b_n") + 1 / F.sqrt(F.col("f_n") - F.col("b_n")))) & alike
        joined = apart.where(similar).select("host", "cluster", "seg", F.lit(True).alias("similar"))
        step = F.when(F.size("s") >= d, F.concat(F.lit("/"), F.when(F.col("similar"), F.lit("~")).otherwise(F.col("seg")))).otherwise(F.lit(""))
        leaves = staged(leaves.join(joined, ["host", "cluster", "seg"], "left").withColumn("cluster", F.concat("cluster", step)).drop("seg", "rest", "similar"), "urls-tree")
    deeper = F.slice("s", DEPTH + 1, F.greatest(F.size("s") - DEPTH, F.lit(0)))
    return leaves.withColumn("cluster", F.concat("cluster", F.array_join(F.transform(deeper, lambda x: F.concat(F.lit("/"), x)), "")))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, bad_share.

    What a rule decides is the labelled part. Per host, paths form a tree by segment; item-like segments, and on the
    first DEPTH levels the children of nodes with very many, become `*`. Similar sibling branches are merged (_merged), so that
    branches without labels share those of the branches that are built alike; branches whose labels disagree stay
    apart. A template is rejected if the smoothed share of bad labels in its merged branch is REJECT or more; without
    labels there it keeps the prior's one half and is allowed. Null and malformed urls have an empty host. Equal urls
    get equal rows; an empty table gives an empty result; other columns are ignored.
    """
    base = only(pages, "page_id", "url")
    host, path = split_url(F.col("url"))
    rows = base.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", first_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "hit.rule", F.col("hit.verdict").alias("ruled"))
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    rows = rows.withColumn("_s", F.transform(segments, lambda x: F.when(x.rlike(ITEM), F.lit("*")).otherwise(x))).withColumn("template", F.lit(""))
    for d in range(DEPTH):
        there = F.size("_s") > d
        rows = rows.withColumn("_seg", F.when(there, F.try_element_at("_s", F.lit(d + 1))))
        # Children are counted once per node, with partial sums per child first; only wide nodes come back.
        children = rows.where(there).groupBy("host", "template", "_seg").agg(F.count("*").alias("n"))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
        wide = nodes.where((F.col("c") >= WIDE_CHILDREN) & (F.col("c") >= WIDE_SHARE * F.col("n"))).select("host", "template", F.lit(True).alias("wide"))
        rows = staged(rows.join(wide, ["host", "template"], "left"), "urls").withColumn("template", F.concat("template", F.when(there, F.concat(F.lit("/"), F.when(F.col("wide"), F.lit("*")).otherwise(F.col("_seg")))).otherwise(F.lit("")))).drop("_seg", "wide")
    deeper = F.slice("_s", DEPTH + 1, F.greatest(F.size("_s") - DEPTH, F.lit(0)))
    rows = rows.withColumn("template", F.concat("template", F.array_join(F.transform(deeper, lambda x: F.concat(F.lit("/"), x)), ""))).drop("_s")
    bad, good = F.count_if(F.col("ruled") == "block"), F.count_if(F.col("ruled") == "allow")
    leaves = rows.groupBy("host", "template").agg(F.count("*").alias("n"), bad.alias("bad"), good.alias("good"))
    leaves = _merged(staged(leaves.withColumn("s", F.split(F.regexp_replace("template", "^/", ""), "/", -1)), "urls-leaves"))
    clusters = leaves.groupBy("host", "cluster").agg(F.sum("bad").alias("c_bad"), F.sum("good").alias("c_good"))
    purity = (F.col("c_bad") + PRIOR / 2) / (F.col("c_bad") + F.col("c_good") + PRIOR)
    decided = staged(leaves.join(clusters, ["host", "cluster"]).select("host", "template", purity.alias("bad_share")), "urls-decided")
    # Templates are few; where they aren't, pages are dealt by page too, so that one hot template isn't one task.
    if decided.count() <= BROADCAST_TEMPLATES:
        out = rows.join(F.broadcast(decided), ["host", "template"])
    else:
        salted = decided.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("_k", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "template", "_k"])
    verdict = F.coalesce("ruled", F.when(F.col("bad_share") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "bad_share")


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge_urls over the whole table of pages; see there for nulls, repeats and empty tables."""
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    """The same rows in DuckDB SQL: a pair of steps for each level of the tree."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        at, _, rest = rule.partition("/")
        cases.append((f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}')", rule, verdict))
    pick = lambda i: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[i]}'" for c in cases) + " END"
    item = ITEM.replace("(?:", "(")
    bound = repr(math.sqrt(math.log(2 / RISK) / 2))
    steps = [
        "u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{upper.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"t0 AS (SELECT *, {pick(1)} AS rule, {pick(2)} AS ruled, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda x: CASE WHEN regexp_matches(x, '{item}') THEN '*' ELSE x END) AS s, '' AS template FROM h)",
    ]
    for d in range(1, DEPTH + 1):
        steps += [
            f"l{d} AS (SELECT *, CASE WHEN len(s) >= {d} THEN s[{d}] END AS seg FROM t{d - 1})",
            f"w{d} AS (SELECT host, template FROM (SELECT host, template, seg, count(*) AS n FROM l{d} WHERE seg IS NOT NULL GROUP BY ALL) GROUP BY ALL HAVING count(*) >= {WIDE_CHILDREN} AND count(*) >= {WIDE_SHARE} * sum(n))",
            f"t{d} AS (SELECT l.* EXCLUDE (seg, template), l.template || CASE WHEN seg IS NULL THEN '' WHEN w.host IS NOT NULL THEN '/*' ELSE '/' || seg END AS template FROM l{d} l LEFT JOIN w{d} w ON l.host = w.host AND l.template = w.template)",
        ]
    deeper = f"CASE WHEN len(s) > {DEPTH} THEN '/' || array_to_string(s[{DEPTH + 1}:], '/') ELSE '' END"
    steps += [
        f"p AS (SELECT * EXCLUDE (template), template || {deeper} AS template FROM t{DEPTH})",
        "c0 AS (SELECT host, template, count(*) AS n, count(*) FILTER (ruled = 'block') AS bad, count(*) FILTER (ruled = 'allow') AS good, string_split(regexp_replace(template, '^/', ''), '/') AS s, '' AS cluster FROM p GROUP BY host, template)",
    ]
    for d in range(1, DEPTH + 1):
        rest = f"array_to_string(list_transform(s[{d + 1}:], lambda x: CASE WHEN x IN ('*', '') THEN x ELSE '~' END), '/')"
        p = "((f_bad + 1) / (f_bad + f_good + 2))"
        n, m = "(b_bad + b_good)", "(f_bad + f_good - b_bad - b_good)"
        steps += [
            f"x{d} AS (SELECT *, CASE WHEN len(s) >= {d} THEN s[{d}] END AS seg, {rest} AS rest FROM c{d - 1})",
            f"k{d} AS (SELECT host, cluster, seg, rest, sum(n) AS n, sum(bad) AS bad, sum(good) AS good FROM x{d} WHERE seg IS NOT NULL GROUP BY ALL)",
            f"b{d} AS (SELECT host, cluster, seg, sum(n) AS b_n, sum(bad) AS b_bad, sum(good) AS b_good, max({{'n': n, 'rest': rest}}).rest AS usual FROM k{d} GROUP BY ALL)",
            f"f{d} AS (SELECT host, cluster, usual, sum(b_n) AS f_n, sum(b_bad) AS f_bad, sum(b_good) AS f_good FROM b{d} GROUP BY ALL HAVING count(*) > 1)",
            f"r{d} AS (SELECT host, cluster, usual, rest, sum(n) AS r_n FROM k{d} JOIN b{d} USING (host, cluster, seg) GROUP BY ALL)",
            f"a{d} AS (SELECT host, cluster, seg, b_n, b_bad, b_good, f_n, f_bad, f_good, sum(greatest(n / b_n - (r_n - n) / (f_n - b_n), 0.0)) AS apart FROM k{d} JOIN b{d} USING (host, cluster, seg) JOIN f{d} USING (host, cluster, usual) JOIN r{d} USING (host, cluster, usual, rest) GROUP BY ALL)",
            f"s{d} AS (SELECT host, cluster, seg FROM a{d} WHERE apart <= {bound} * (1 / sqrt(b_n) + 1 / sqrt(f_n - b_n)) AND ({n} = 0 OR {m} = 0 OR abs(b_bad / nullif({n}, 0) - (f_bad - b_bad) / nullif({m}, 0)) <= {SIMILAR} * sqrt({p} * (1 - {p}) * (1 / nullif({n}, 0) + 1 / nullif({m}, 0)))))",
            f"c{d} AS (SELECT x.* EXCLUDE (seg, rest, cluster), x.cluster || CASE WHEN x.seg IS NULL THEN '' WHEN s.seg IS NOT NULL THEN '/~' ELSE '/' || x.seg END AS cluster FROM x{d} x LEFT JOIN s{d} s ON x.host = s.host AND x.cluster = s.cluster AND x.seg = s.seg)",
        ]
    steps += [
        f"g AS (SELECT host, template, bad, good, cluster || {deeper} AS cluster FROM c{DEPTH})",
        f"d AS (SELECT host, template, (sum(bad) OVER v + {PRIOR / 2}) / (sum(bad) OVER v + sum(good) OVER v + {PRIOR}) AS bad_share FROM g WINDOW v AS (PARTITION BY host, cluster))",
    ]
    return f"WITH {', '.join(steps)} SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN bad_share >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, p.template, bad_share::DOUBLE AS bad_share FROM p JOIN d ON p.host = d.host AND p.template = d.template"


OP2_SQL = _sql()
