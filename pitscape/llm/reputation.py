"""URL filter by empirical-Bayes reputation of hosts, with fixed rules in front.

Labelled outcomes of pages (bad or not) are counted per host, registered domain and
suffix. Each level's rate is a beta-binomial posterior whose prior is the posterior mean
of the level above, weighted as ``strength`` observations: suffix under the rate of all pages, domain
under its suffix, host under its domain. A page is blocked if the posterior's lower bound
(mean minus ``z`` standard deviations) of its host's bad rate is above ``limit``.

Only DataFrame functions. Counts combine map-side; the page side of the one join is dealt by host, and
a hot host is split by the engine, since the other side has one row per host.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed (no host,
no reputation); a host without labels takes its domain's posterior, and so on up; of repeated
labels of a page the worst counts; null labels are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscape.llm.common import columns

#: (host, path prefix, verdict); fixed values of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRENGTH, Z, LIMIT = 8.0, 1.0, 0.25


def with_host_and_path(pages: DataFrame) -> DataFrame:
    after = pages.withColumn("rest", F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) end"))
    after = after.withColumn("rest", F.substring_index(F.substring_index("rest", "#", 1), "?", 1))
    return after.withColumns(
        {
            "host": F.coalesce(F.translate(F.substring_index("rest", "/", 1), UPPER, LOWER), F.lit("")),
            "path": F.coalesce(F.expr("case when instr(rest, '/') > 0 then substring(rest, instr(rest, '/')) end"), F.lit("")),
        }
    ).drop("rest")


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, prefix, says in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(rule_host + prefix)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def reputation(hosts: DataFrame, strength: float = STRENGTH, z: float = Z) -> DataFrame:
    """``bound`` per host from (host, n, bad): the lower posterior bound of its bad rate."""
    levels = hosts.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})
    total = levels.agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    top = levels.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(total))  # one row
    # the rate of all pages, by one bad and one good page more
    rate = (F.col("all_bad") + 1) / (F.col("all_n") + 2)
    top = top.select("suffix", ((F.col("bad") + rate * strength) / (F.col("n") + strength)).alias("suffix_rate"))
    middle = levels.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(top, "suffix")
    middle = middle.select("domain", ((F.col("bad") + F.col("suffix_rate") * strength) / (F.col("n") + strength)).alias("domain_rate"))
    a = F.col("bad") + F.col("domain_rate") * strength
    n = F.col("n") + strength
    mean = a / n
    return levels.join(middle, "domain").select("host", (mean - z * F.sqrt(mean * (1 - mean) / (n + 1))).alias("bound"))


def judged(pages: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; labels: (doc_id = page_id, quality, toxic), bad if quality is 0 or toxic 1."""
    p = with_host_and_path(columns(pages, "page_id", "url"))
    bad = F.greatest(1 - F.col("quality"), F.col("toxic")).cast("long")
    known = columns(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)")
    known = known.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    known = known.groupBy("page_id").agg(F.max("bad").alias("bad"))
    counts = (
        p.select("page_id", "host").where("host <> ''").join(known, "page_id", "left").groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    rule, says = rule_of(F.col("host"), F.col("path"))
    own = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return p.join(reputation(counts), "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"))


ORACLE = """
with u as (select page_id, case when instr(url, '://') > 0 then split_part(split_part(substr(url, instr(url, '://') + 3), '#', 1), '?', 1) end as rest from pages),
p as (select page_id, coalesce(translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
             coalesce(case when instr(rest, '/') > 0 then substr(rest, instr(rest, '/')) end, '') as path from u),
k as (select doc_id as page_id, max(greatest(1 - quality, toxic)) as bad from labels where doc_id is not null and quality in (0, 1) and toxic in (0, 1) group by 1),
h as (select host, count(bad)::double as n, coalesce(sum(bad), 0)::double as bad,
             regexp_extract(host, '[^.]*\\.?[^.]*$') as domain, regexp_extract(host, '[^.]*$') as suffix
      from p left join k using (page_id) where host <> '' group by host),
g as (select (sum(bad) + 1) / (sum(n) + 2) as rate from h),
s as (select suffix, (sum(bad) + (select rate from g) * 8.0::double) / (sum(n) + 8.0::double) as r from h group by suffix),
d as (select domain, suffix, (sum(bad) + any_value(s.r) * 8.0::double) / (sum(n) + 8.0::double) as r from h join s using (suffix) group by domain, suffix),
m as (select host, n + 8 as n, (bad + d.r * 8.0::double) / (n + 8.0::double) as mean from h join d using (domain)),
b as (select host, mean - sqrt(mean * (1 - mean) / (n + 1)) as bound from m),
f as (select p.*, b.bound,
        (host = 'net' or host like '%.net') and starts_with(path, '/') as r1,
        (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') as r2,
        (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') as r3,
        (host = 'org' or host like '%.org') and starts_with(path, '/fr/') as r4
      from p left join b using (host))
select page_id, host, path,
       case when r2 then 'example.net/en/' when r3 then 'example.com/de/' when r4 then 'org/fr/' when r1 then 'net/' end as rule,
       case when r2 then 'allow' when r3 then 'block' when r4 then 'allow' when r1 then 'block' when bound > 0.25 then 'block' else 'allow' end as verdict
from f
"""
