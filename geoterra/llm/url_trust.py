"""URL verdicts by rules, and for other urls by trust and distrust that spread over host links.

Trust is a personalised PageRank from hosts with allowed pages along links; distrust one from hosts with blocked
pages against them, since who links to a blocked host is suspect. All in DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: Fixed values: (verdict, host, path) of the production rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""[hH][rR][eE][fF]\s*=\s*["']?(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (lower-case) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, the longer host where two are as long; null without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted. ``pages`` has host and html."""
    to = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), to.alias("dst")).withColumn("dst", F.translate("dst", UPPER, LOWER))
    return links.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def spread(seeds: DataFrame, links: DataFrame, tolerance: float = 1e-9, damping: float = 0.85) -> DataFrame:
    """(kind, host, score) from seeds (kind, host, weight) along links (kind, src, dst, n) by personalised PageRank.

    Weights add up to 1 for each kind; each round passes on ``damping`` of what a host gained in the round before by the
    links' counts, until no host gains more than ``tolerance`` of its score. A host that is reached for the first time
    gains all of it, so every host that links lead to has a score. The state is a table of hosts, written every round.
    """
    seeds = seeds.groupBy("kind", "host").agg(F.sum("weight").alias("weight"))
    every = seeds.groupBy("kind").agg(F.sum("weight").alias("every"))
    own = (F.col("weight") / F.col("every") * (1 - damping)).alias("score")
    state = written(seeds.join(every, "kind").select("kind", "host", own, own.alias("gain")), "trust")
    out = links.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    links = written(links.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("out")).alias("share")), "host-links")
    while True:
        moved = state.filter("gain > 0").join(links, ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.lit(0.0).alias("score"), (F.col("gain") * F.col("share") * damping).alias("gain"))
        both = state.select("kind", "host", "score", F.lit(0.0).alias("gain")).union(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("gain").alias("gain"))
        state = written(both.select("kind", "host", (F.col("score") + F.col("gain")).alias("score"), "gain"), "trust")
        if state.filter(F.col("gain") > F.col("score") * tolerance).isEmpty():
            return state.select("kind", "host", "score")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, ratio: float = 1.0, tolerance: float = 1e-9) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust and distrust of its host.

    A fitting rule decides; else a page is blocked if its host's distrust is more than ``ratio`` times its trust.
    Seeds are hosts weighted by their pages with an allowing or blocking rule. A null url, or one without ``://``,
    has an empty host and path, fits no rule and is allowed; a null html has no links; repeated pages count as often
    as they stand; hosts that nothing reaches are allowed; an empty table gives an empty one; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    seeds = rows.filter("fit is not null").groupBy(F.col("fit.verdict").alias("kind"), "host").agg(F.count("*").cast("double").alias("weight"))
    links = host_links(rows)
    both = links.select(F.lit("allow").alias("kind"), "src", "dst", "n").union(links.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    scores = spread(seeds, both, tolerance).groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "allow", F.col("score"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == "block", F.col("score"))), F.lit(0.0)).alias("distrust")
    )
    out = rows.drop("html").join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > F.col("trust") * ratio, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "trust", "distrust")


def op7_url_trust(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    link = LINK.replace("'", "''")
    fits = "\n".join(f"    when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))))
    return f"""
with recursive u as (select page_id, html, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
f as (select *, case
{fits} end as fit from h),
w as (select split_part(fit, ' ', 1) as kind, host, cast(count(*) as double) as weight from f where fit is not null group by 1, 2),
seed as (select kind, host, weight / sum(weight) over (partition by kind) as score from w),
l0 as (select host as src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') as dst from f where host <> ''),
l as (select src, dst, cast(count(*) as double) as n from l0 where src <> dst group by 1, 2),
e as (select 'allow' as kind, src, dst, n from l union all select 'block', dst, src, n from l),
edge as (select kind, src, dst, n / sum(n) over (partition by kind, src) as share from e),
s(kind, host, score, gain) as (select kind, host, score * 0.15, score * 0.15 from seed
  union all
  select kind, host, sum(score) + sum(gain), sum(gain) from (
    select kind, host, score, 0.0::double as gain from s union all
    select s.kind, e.dst, 0.0::double, s.gain * e.share * 0.85 from s join edge e on s.kind = e.kind and s.host = e.src where s.gain > 0)
  where (select max(gain - score * 1e-9) from s) > 0 group by kind, host),
last as (select kind, host, max(score) as score from s group by kind, host),
t as (select host, coalesce(sum(score) filter (kind = 'allow'), 0) as trust, coalesce(sum(score) filter (kind = 'block'), 0) as distrust from last group by host)
select page_id, f.host, path, substr(fit, 7) as rule,
  coalesce(split_part(fit, ' ', 1), case when coalesce(distrust, 0) > coalesce(trust, 0) then 'block' else 'allow' end) as verdict
from f left join t on f.host = t.host"""


ORACLES = {"op7_url_trust": _oracle()}
QUERIES = {"op7_url_trust": op7_url_trust}
