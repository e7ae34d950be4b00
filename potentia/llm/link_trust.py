"""Op 6: URL verdicts from rules, and from trust and distrust that spread over host links, in DataFrame operations.

A rule allows or blocks a host with all its subdomains below a path prefix; the longest fitting rule decides.
Pages without a fitting rule get their host's verdict. Hosts are linked where a page of one links to the
other, and where one is the parent domain of the other. Trust starts at the hosts of allowed pages and follows
the links (personalised PageRank); distrust starts at the hosts of blocked pages and follows them backwards, since
linking to a blocked host is what makes a host suspect. Each is held against the host's own neutral rank: that of a walk in
the same direction that starts at all pages alike. A host is blocked if its distrust, as a multiple of its neutral rank, is
above 1 (it is more suspect than its pages and links alone would make it) and above its trust, as such a multiple: with
distrust d and trust t, d / (d + max(t, 1)) must be above `threshold`. Each rank sums up to 1; what reaches a host without
links onward goes back to where the walk started.

Links are counted by pair of hosts before they are shuffled, ranks have one row a host, and each step is written to the
checkpoint folder; steps end when the ranks move by less than `tolerance` in sum, which damping brings about in some 90 steps, or after
`steps` where that is given.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; null html has
no links; rows that repeat are each judged; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: The rules of the query, as (action, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host(url: Column) -> Column:
    """After the first "://" up to a slash, question mark, hash or the end; A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(own_host: Column, own_path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its action (null if none fits). Rules are a list that the caller writes, so a chain of conditions."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for does, text in sorted(rules, key=lambda r: len(r[1])):
        at, slash, rest = text.partition("/")
        fits = ((own_host == at) | F.endswith(own_host, F.lit("." + at))) & F.startswith(own_path, F.lit(slash + rest))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(does)).otherwise(action)
    return rule, action


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts: src, dst, weight (pages of src that link to dst, each link once a page)."""
    target = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""), 1)
    full = F.transform(target, lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))
    hosts = F.array_distinct(F.transform(full, host))
    linked = pages.where("html is not null").select(host(F.col("url")).alias("src"), F.explode(hosts).alias("dst"))
    return linked.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def family_links(hosts: DataFrame) -> DataFrame:
    """Both ways between a host and its parent domain, where both are hosts of pages."""
    parent = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst")).where("src <> dst")
    known = parent.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").withColumn("weight", F.lit(1.0))
    return known.select("src", "dst", "weight").unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


RANKS = ("trust", "distrust", "ahead", "behind")
DIGITS = 9


def host_ranks(judged: DataFrame, links: DataFrame, *, damping: float = 0.85, steps: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """host and its RANKS: ahead and behind are the neutral ranks along the links and against them. judged has host and action of every page."""
    seeds = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("trust"), F.count_if(F.col("action") == "block").alias("distrust"), F.count("*").alias("ahead")).withColumn("behind", F.col("ahead"))
    seeds = cut(seeds)
    total = seeds.agg(*[F.sum(x).alias(x) for x in RANKS]).first()
    sums = links.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = sums.groupBy("src").agg(F.sum("weight").alias("out"))
    into = sums.groupBy("dst").agg(F.sum("weight").alias("into"))
    edges = cut(sums.join(out, "src").join(into, "dst").select("src", "dst", (F.col("weight") / F.col("out")).alias("forth"), (F.col("weight") / F.col("into")).alias("back")))
    linked = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    start = seeds.select("host", *[(F.col(x) / max(1, total[x] or 0)).alias(f"{x}0") for x in RANKS]).join(linked, "host", "full_outer").na.fill(0.0)
    ranks = cut(start.withColumns({x: F.col(f"{x}0") for x in RANKS}))
    if edges.limit(1).count():
        for _ in itertools.count() if steps is None else range(steps):
            sent = lambda at, to, share, own: ranks.join(edges, ranks.host == edges[at]).select(edges[to].alias("host"), *[(F.col(x) * F.col(share) if x in own else F.lit(0.0)).alias(x) for x in RANKS])  # noqa: E731, B023
            came = sent("src", "dst", "forth", ("trust", "ahead")).unionByName(sent("dst", "src", "back", ("distrust", "behind"))).groupBy("host").agg(*[F.sum(x).alias(f"{x}1") for x in RANKS])
            moved = {x: F.lit(1 - damping) * F.col(f"{x}0") + F.lit(damping) * F.coalesce(f"{x}1", F.lit(0.0)) for x in RANKS}
            change = reduce(add, [F.abs(F.col(x) - moved[x]) for x in RANKS])
            ranks = cut(ranks.join(came, "host", "left").select("host", *[f"{x}0" for x in RANKS], *[moved[x].alias(x) for x in RANKS], change.alias("own_change")))
            done = ranks.agg(F.sum("own_change")).first()[0] < tolerance
            ranks = ranks.drop("own_change")
            if done:
                break
    # what a walk loses at hosts without links goes back to its start, which multiplies the rank of every host alike
    total = ranks.agg(*[F.sum(x).alias(x) for x in RANKS]).first()
    return ranks.select("host", *[(F.col(x) / (total[x] or 1.0)).alias(x) for x in RANKS])


def judge(pages: DataFrame, rules=RULES, *, threshold: float = 0.5, family: bool = True, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's distrust_share: d / (d + max(t, 1)), rounded before it is held against
    the threshold, so that the order in which sums were added decides nothing."""
    own = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    judged = own.withColumns({"rule": rule, "action": action})
    links = host_links(pages)
    if family:
        links = links.unionByName(family_links(judged.where("host <> ''").select("host").distinct()))
    lift = lambda x, neutral: F.coalesce(F.try_divide(x, neutral), F.lit(0.0))
    d, t = lift("distrust", "behind"), lift("trust", "ahead")
    ratio = F.round(d / (d + F.greatest(t, F.lit(1.0))), DIGITS)
    share = host_ranks(judged, links, **options).select(F.col("host").alias("own_host"), ratio.alias("distrust_share"))
    found = judged.join(share, F.col("host") == F.col("own_host"), "left").drop("own_host")
    verdict = F.coalesce("action", F.when(F.col("distrust_share") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("distrust_share", F.lit(0.0)).alias("distrust_share"))


def oracle(rules=RULES, *, threshold: float = 0.5, damping: float = 0.85, tolerance: float = 1e-6) -> str:
    """SQL of judge over the table pages."""
    cases = {"rule": "", "action": ""}
    for does, text in sorted(rules, key=lambda r: -len(r[1])):
        at, slash, rest = text.partition("/")
        fits = f"when (host = '{at}' or ends_with(host, '.{at}')) and starts_with(path, '{slash + rest}') then "
        cases = {"rule": f"{cases['rule']} {fits} '{text}'", "action": f"{cases['action']} {fits} '{does}'"}
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    named = lambda url: low(f"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '')")
    moved = lambda x, share: f"{1 - damping}::double * max(s.{x}) + {damping}::double * coalesce(sum(v.{x} * v.{share}), 0) as {x}"
    return rf"""
    with recursive own as (
        select page_id, html, {named('url')} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
    judged as (select *, case {cases['rule']} end as rule, case {cases['action']} end as action from own),
    hosts as (select distinct host from judged where host <> ''),
    targets as (
        select host as src, unnest(list_distinct(list_transform(
            regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*((?:https?:)?//[^\s"''<>]+)', 1),
            lambda x: {named("case when starts_with(x, '//') then 'http:' || x else x end")}))) as dst
        from own where html is not null),
    parents as (
        select h.host as src, p.host as dst from hosts h join hosts p on p.host = regexp_replace(h.host, '^[^.]*\.', '') where h.host <> p.host),
    links as (
        select src, dst from targets where src <> dst and src <> '' and dst <> ''
        union all select src, dst from parents union all select dst, src from parents),
    sums as (select src, dst, count(*)::double as weight from links group by src, dst),
    edges as (select src, dst, weight / sum(weight) over (partition by src) as forth, weight / sum(weight) over (partition by dst) as back from sums),
    seeds as (
        select host, count(*) filter (action = 'allow') as trust, count(*) filter (action = 'block') as distrust, count(*) as ahead
        from judged where host <> '' group by host),
    starts as (
        select host, coalesce(trust, 0)::double / greatest(1, sum(trust) over ()) as trust, coalesce(distrust, 0)::double / greatest(1, sum(distrust) over ()) as distrust,
            coalesce(ahead, 0)::double / greatest(1, sum(ahead) over ()) as ahead, coalesce(ahead, 0)::double / greatest(1, sum(ahead) over ()) as behind
        from seeds full join (select src as host from edges union select dst from edges) using (host)),
    steps as (
        select 0 as step, *, case when exists (from edges) then 1.0::double else 0.0::double end as change from starts
        union all
        select step + 1, host, trust, distrust, ahead, behind, abs(trust - trust_was) + abs(distrust - distrust_was) + abs(ahead - ahead_was) + abs(behind - behind_was)
        from (
            select max(r.step) as step, r.host, {moved('trust', 'forth')}, {moved('distrust', 'back')}, {moved('ahead', 'forth')}, {moved('behind', 'back')},
                max(r.trust) as trust_was, max(r.distrust) as distrust_was, max(r.ahead) as ahead_was, max(r.behind) as behind_was
            from steps r join starts s on s.host = r.host left join (
                select dst as host, trust, 0 as distrust, ahead, 0 as behind, forth, 0 as back from steps f join edges e on f.host = e.src
                union all select src, 0, distrust, 0, behind, 0, back from steps b join edges e on b.host = e.dst) v on v.host = r.host
            where (select sum(change) from steps) >= {tolerance!r}::double
            group by r.host)),
    ends as (select * from steps where step = (select max(step) from steps)),
    lifts as (
        select host, case when behind > 0 then (distrust / nullif(sum(distrust) over (), 0)) / (behind / sum(behind) over ()) end as d,
            case when ahead > 0 then (trust / nullif(sum(trust) over (), 0)) / (ahead / sum(ahead) over ()) end as t
        from ends),
    ratios as (select host, round(coalesce(d, 0) / (coalesce(d, 0) + greatest(coalesce(t, 0), 1)), {DIGITS}) as distrust_share from lifts)
    select page_id, host, path, rule, coalesce(action, case when distrust_share > {threshold} then 'block' else 'allow' end) as verdict,
        coalesce(distrust_share, 0) as distrust_share
    from judged left join ratios using (host)"""
