"""URL filters: path rules, and an empirical-Bayes reputation of hosts where no rule fits.

The reputation of a host is a beta posterior over its share of bad pages. Its prior is the posterior mean of its
registered domain, whose prior is that of its suffix, whose prior is the share over all pages; how strongly a level
holds to the level above is a number of pseudo-pages fitted to the spread between its members (method of moments).
A page is blocked where the lower bound of its host's posterior exceeds a threshold. All of it is aggregation over
pages and joins of small keys; pages meet their host's verdict in a join that Spark may split for hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import table

#: (host, path, verdict); the longest rule that fits wins.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Suffixes of two labels; any other suffix is the last label.
LONG_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz"]
#: A host is blocked if its share of bad pages exceeds MAX_BAD with a one-sided certainty of Z standard deviations.
MAX_BAD, Z = 0.5, 1.645
LEAST_PSEUDO, MOST_PSEUDO = 2.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null and where `://` is missing."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """The public suffix and the registered domain (suffix and one label more) of a host; the host itself if shorter."""
    last_two = F.substring_index(host, ".", -2)
    long = last_two.isin(LONG_SUFFIXES)
    return F.when(long, last_two).otherwise(F.substring_index(host, ".", -1)), F.when(long, F.substring_index(host, ".", -3)).otherwise(last_two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _level(members: DataFrame, key: str, parent: str) -> DataFrame:
    """Counts and the pseudo-count of each `parent`, from counts n, bad of its members."""
    share = F.col("bad") / F.col("n")
    sums = members.groupBy(parent).agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("k"),
        F.sum(F.when(F.col("n") > 0, F.col("n") * share * share)).alias("q"),
    )
    return sums


def _pseudo(k: Column, n: Column, bad: Column, q: Column) -> Column:
    """Pseudo-pages by moments: the spread of the members' shares beyond what sampling explains."""
    m = bad / F.nullif(n, F.lit(0))
    between = (q - n * m * m) / F.nullif(n, F.lit(0))
    sampling = m * (1 - m) * k / F.nullif(n, F.lit(0))
    extra = between - sampling
    fitted = F.when(extra > 1e-9, m * (1 - m) / extra - 1).otherwise(MOST_PSEUDO)
    return F.least(F.greatest(F.coalesce(fitted, F.lit(MOST_PSEUDO)), F.lit(LEAST_PSEUDO)), F.lit(MOST_PSEUDO))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """Rows host, n, bad, mean, bound for `outcomes` (host, bad: 0, 1 or null for pages without a label).

    `mean` and `bound` describe the posterior share of bad pages; `bound` is the mean less Z standard deviations of
    the beta posterior. With no labels at all the mean is 0. An empty table gives no rows.
    """
    hosts = outcomes.groupBy("host").agg(
        F.sum(F.when(F.col("bad").isNotNull(), 1).otherwise(0)).alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")
    )
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    domains = _level(hosts, "host", "domain").withColumn("suffix", suffix_and_domain(F.col("domain"))[0])
    suffixes = _level(domains.select("domain", "suffix", "n", "bad"), "domain", "suffix")
    top = _level(suffixes.select("suffix", F.lit(1).alias("one"), "n", "bad"), "suffix", "one")
    top = top.select(F.coalesce(F.col("bad") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("m0"), _pseudo(F.col("k"), F.col("n"), F.col("bad"), F.col("q")).alias("s0"))

    def shrunk(prior: Column, strength: Column) -> Column:
        return (F.col("bad") + strength * prior) / (F.col("n") + strength)

    # `top` is one row
    suffixes = suffixes.crossJoin(F.broadcast(top)).select("suffix", shrunk(F.col("m0"), F.col("s0")).alias("m1"), _pseudo(F.col("k"), F.col("n"), F.col("bad"), F.col("q")).alias("s1"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("m1"), F.col("s1")).alias("m2"), _pseudo(F.col("k"), F.col("n"), F.col("bad"), F.col("q")).alias("s2"))
    a, b = F.col("bad") + F.col("s2") * F.col("m2"), F.col("n") - F.col("bad") + F.col("s2") * (1 - F.col("m2"))
    return (
        hosts.join(domains, "domain").withColumn("a", a).withColumn("b", b)
        .select(
            "host", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"),
            (F.col("a") / (F.col("a") + F.col("b")) - Z * F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))).alias("bound"),
        )
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """Adds host, path, rule and verdict to `pages` (page_id, url); `outcomes` has rows url, bad (0 or 1).

    Null urls and urls without `://` have an empty host, for which outcomes are pooled like for any other. Hosts that
    have no outcome at all are judged by the priors above them. Pages keep their repeats; columns of these names are
    replaced, all others pass through. An empty table stays empty.
    """
    host, path = host_and_path(F.col("url"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.drop("host", "path", "rule", "verdict", "bound").withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("_ruled", ruled)
    known = outcomes.select(host_and_path(F.col("url"))[0].alias("host"), "bad")
    unlabelled = judged.select("host", F.lit(None).cast("int").alias("bad"))
    reputation = host_reputation(known.unionByName(unlabelled)).select("host", (F.col("bound") > max_bad).alias("_blocked"), "bound")
    out = judged.join(reputation, "host", "left")
    return out.withColumn("verdict", F.coalesce("_ruled", F.when(F.col("_blocked"), "block").otherwise("allow"))).drop("_ruled", "_blocked")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pages as rows url, bad. A page shows the document whose number ends its path; labels are by document.

    A page is bad if its document is of low quality or toxic. Pages without a number or a label give no row.
    """
    number = F.regexp_extract(F.col("url"), r"://[^?#]*/([0-9]{1,18})(?:[./?#]|$)", 1)
    shown = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id"))
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    # one outcome for each document, however often its label is repeated
    marks = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return shown.join(marks, "doc_id").select("url", "bad")


def op4(spark, sf_dir: str) -> DataFrame:
    """A verdict for every page: its longest rule's, else that of its host's reputation."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("bound", 6).alias("bad_bound"))


#: The same in SQL for every column of op4.
OP4_SQL = """
WITH p AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
                 WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
                 WHEN ('.' || host) LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
                 WHEN ('.' || host) LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
                 WHEN ('.' || host) LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM h),
m AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
o AS (SELECT r.host, m.bad FROM r JOIN m ON m.doc_id = try_cast(nullif(regexp_extract(r.url, '://[^?#]*/([0-9]{{1,18}})(?:[./?#]|$)', 1), '') AS BIGINT)),
x AS (
  SELECT r.host, coalesce(any_value(c.n), 0)::DOUBLE AS n, coalesce(any_value(c.bad), 0)::DOUBLE AS bad
  FROM r LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS bad FROM o GROUP BY host) c USING (host) GROUP BY r.host),
hosts AS (
  SELECT *, array_to_string(string_split(host, '.')[-1:], '.') AS s1, array_to_string(string_split(host, '.')[-2:], '.') AS s2,
         array_to_string(string_split(host, '.')[-3:], '.') AS s3 FROM x),
hosts2 AS (
  SELECT host, n, bad, CASE WHEN s2 IN ({long}) THEN s2 ELSE s1 END AS suffix, CASE WHEN s2 IN ({long}) THEN s3 ELSE s2 END AS domain FROM hosts),
d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad, count(*) FILTER (n > 0) AS k, sum(bad * bad / nullif(n, 0)) AS q FROM hosts2 GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, count(*) FILTER (n > 0) AS k, sum(bad * bad / nullif(n, 0)) AS q FROM d GROUP BY suffix),
t AS (SELECT sum(n) AS n, sum(bad) AS bad, count(*) FILTER (n > 0) AS k, sum(bad * bad / nullif(n, 0)) AS q FROM s),
pd AS (SELECT *, bad / nullif(n, 0) AS m FROM d), ps AS (SELECT *, bad / nullif(n, 0) AS m FROM s), pt AS (SELECT *, bad / nullif(n, 0) AS m FROM t),
fd AS (SELECT *, (q - n * m * m) / nullif(n, 0) - m * (1 - m) * k / nullif(n, 0) AS e FROM pd),
fs AS (SELECT *, (q - n * m * m) / nullif(n, 0) - m * (1 - m) * k / nullif(n, 0) AS e FROM ps),
ft AS (SELECT *, (q - n * m * m) / nullif(n, 0) - m * (1 - m) * k / nullif(n, 0) AS e FROM pt),
gd AS (SELECT *, least(greatest(CASE WHEN e > 1e-9 THEN m * (1 - m) / e - 1 ELSE 1000 END, 2), 1000) AS w FROM fd),
gs AS (SELECT *, least(greatest(CASE WHEN e > 1e-9 THEN m * (1 - m) / e - 1 ELSE 1000 END, 2), 1000) AS w FROM fs),
gt AS (SELECT *, least(greatest(CASE WHEN e > 1e-9 THEN m * (1 - m) / e - 1 ELSE 1000 END, 2), 1000) AS w FROM ft),
ms AS (SELECT gs.suffix, gs.w, (gs.bad + gt.w * coalesce(gt.m, 0)) / (gs.n + gt.w) AS mean FROM gs, gt),
md AS (SELECT gd.domain, gd.w, (gd.bad + ms.w * ms.mean) / (gd.n + ms.w) AS mean FROM gd JOIN ms USING (suffix)),
mh AS (SELECT host, bad + w * mean AS a, n - bad + w * (1 - mean) AS b FROM hosts2 JOIN md USING (domain)),
v AS (SELECT host, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM mh)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN bound > {most} THEN 'block' ELSE 'allow' END AS verdict, round(bound, 6) AS bad_bound
FROM r JOIN v USING (host)
""".format(long=", ".join(f"'{x}'" for x in LONG_SUFFIXES), z=Z, most=MAX_BAD)
