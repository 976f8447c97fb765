"""URL filters: explicit rules, and empirical-Bayes host reputation where no rule fits.

Labelled page outcomes (1 good, 0 bad) are counted by host. Three beta-binomial layers shrink them:
the rate of a suffix towards the overall rate, of a registered domain towards its suffix, of a host
towards its domain. The strength of each layer's prior comes from the data by moments: how much more
the layer's counts vary around their parents' rates than binomial counts would; in the bound, a prior is worth no more outcomes
than it was learned from. A page is blocked if
the upper bound of its host's posterior good rate lies below a limit, by default the overall good rate: a host is blocked
when it is credibly worse than the corpus. Little evidence blocks nothing, and neither do hosts that differ by chance.

All of it is DataFrame expressions. Only three numbers (the priors' strengths), the overall rate and the number of pages
come to the driver. A host with a third of all pages is counted by partial aggregates. Pages of hosts with more than one page in
HOT_SHARE, which can be at most HOT_SHARE - 1 hosts, get their reputation by a broadcast of those hosts; all others by an equi-join, in
which the pages that have it are spread evenly.

The suffix of a host is its last label, or its last two where the second-last is one of SECOND_LEVEL before a country's two
letters; that list is short, is a parameter, and stands for a public suffix table where one is at hand. Hosts that are addresses
are cut at dots like names.

Defined results: a null URL, or one without `://`, has an empty host and path, no rule, and the
verdict of the empty host. Outcomes that are null or belong to no page count nothing; repeated
labels and repeated pages each count. Without any outcome all that no rule blocks is allowed. Ties of a bound and the limit are
allowed. A URL of any length is read whole. Rows and repeated rows are
judged one by one; other columns of the inputs, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import common

#: (host and path prefix, verdict); the longest that fits wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second labels that, before a country's two letters, belong to the suffix (as in co.uk).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Standard deviations of the bound; limits of a prior's strength.
Z, STRENGTHS = 1.645, (1.0, 10_000.0)
HOT_SHARE = 64


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """The last label, or the last two where they look like co.uk."""
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), "[.]")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    return F.when((F.length(last) == 2) & second.isin(*second_level), F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The suffix and the label before it."""
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), "[.]")
    n = F.size(F.split(suffix_of(host), "[.]")) + 1
    return F.when(F.size(labels) <= n, F.array_join(labels, ".")).otherwise(F.array_join(F.slice(labels, -n, n), "."))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        owner, _, prefix = rule.partition("/")
        fits = ((host == owner) | host.endswith(f".{owner}")) & path.startswith(f"/{prefix}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def prior_strength(groups: DataFrame) -> float:
    """Of groups (n, good, parent): the beta prior's a + b around the parents' rates, by moments."""
    p = F.col("parent")
    row = groups.agg(
        F.sum((F.col("good") - F.col("n") * p) * (F.col("good") - F.col("n") * p) / (p * (1 - p))).alias("spread"),
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"),
    ).first()
    if not row.pairs:
        return STRENGTHS[1]
    rho = max((row.spread - row.n) / row.pairs, 1e-9)
    return min(max(1 / rho - 1, STRENGTHS[0]), STRENGTHS[1])


def reputations(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """host, n_outcomes, rate, bound, overall of every host of pages; pages (page_id, host), outcomes (page_id, good)."""
    counted = common.cut(
        outcomes.select("page_id", "good").where("good is not null").join(pages.select("page_id", "host"), "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"))
    ).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    overall = F.lit((total.good + 1) / (total.n + 2))  # between 0 and 1, with no outcome too

    def layer(key: str, parent: DataFrame | None, *above: str) -> tuple[DataFrame, float]:
        """Rates of key's groups, shrunk towards parent's (its groups are columns of above)."""
        groups = counted.groupBy(key, *above).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        groups = groups.withColumn("parent", overall) if parent is None else groups.join(parent.select(above[0], F.col("rate").alias("parent")), above[0])
        s = prior_strength(groups)
        return groups.withColumn("rate", (F.col("good") + s * F.col("parent")) / (F.col("n") + s)), s

    suffixes, _ = layer("suffix", None)
    domains, _ = layer("domain", suffixes, "suffix")
    hosts, s = layer("host", domains, "domain")
    rates = lambda groups, key: groups.select(key, F.col("rate").alias(f"{key}_rate"), F.col("n").alias(f"{key}_n"))
    seen = pages.select("host").distinct().withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    seen = seen.join(hosts.select("host", "n", "good"), "host", "left").join(rates(domains, "domain"), "domain", "left").join(rates(suffixes, "suffix"), "suffix", "left")
    n, good = F.coalesce("n", F.lit(0)), F.coalesce("good", F.lit(0))
    prior = F.coalesce("domain_rate", "suffix_rate", overall)
    rate = (good + s * prior) / (n + s)
    # a prior is worth no more outcomes than it was learned from
    worth = F.least(F.lit(s), F.coalesce("domain_n", "suffix_n", F.lit(total.n)).cast("double"))
    bound = rate + z * F.sqrt(rate * (1 - rate) / (n + worth + 1))
    return seen.select("host", n.alias("n_outcomes"), rate.alias("rate"), bound.alias("bound"), overall.alias("overall"))


def with_reputation(pages: DataFrame, known: DataFrame) -> DataFrame:
    """pages (host, ...) with the columns of known (host, ...); no task gets all pages of a host."""
    total = pages.count()
    frequent = pages.groupBy("host").agg(F.count("*").alias("k")).where(F.col("k") * HOT_SHARE > total).select("host")  # fewer than HOT_SHARE hosts
    columns = [c for c in known.columns if c != "host"]
    hot = known.join(F.broadcast(frequent), "host", "left_semi").select("host", F.struct(*columns).alias("hot"))
    rest = known.select(F.col("host").alias("rare_host"), F.struct(*columns).alias("rare"))
    # what has its reputation already is dealt by hashes that match nothing
    key = F.when(F.col("hot").isNull(), F.col("host")).otherwise(F.concat(F.lit("\u0000"), F.xxhash64("page_id", "path").cast("string")))
    out = pages.join(F.broadcast(hot), "host", "left").withColumn("key", key).join(rest, F.col("key") == F.col("rare_host"), "left")
    return out.select(*pages.columns, *[F.coalesce(F.col("hot")[c], F.col("rare")[c]).alias(c) for c in columns])


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, least_rate: float | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, n_outcomes, rate, bound: one row per row of pages (page_id, url). least_rate: the limit; None for the overall rate."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = reduce(lambda c, r: c.when(F.col("rule") == r[0], F.lit(r[1])), rules, F.when(F.lit(False), F.lit("")))
    by_host = F.when(F.col("bound") < (F.col("overall") if least_rate is None else least_rate), F.lit("block")).otherwise(F.lit("allow"))
    out = with_reputation(parsed, common.cut(reputations(parsed, outcomes, z)))
    return out.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_host).alias("verdict"), "n_outcomes", "rate", "bound")


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's doc_id names the page, and its quality is the page's outcome."""
    outcomes = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), outcomes).select("page_id", "host", "path", "rule", "verdict")


_HOST = f"coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"
_STRENGTH = f"case when sum(n * (n - 1)) > 0 then least(greatest(1 / greatest((sum((good - n * parent) * (good - n * parent) / (parent * (1 - parent))) - sum(n)) / sum(n * (n - 1)), 1e-9) - 1, {STRENGTHS[0]}), {STRENGTHS[1]}) else {STRENGTHS[1]} end"
_NAMED = f"""
    select *, case when length(l[-1]) = 2 and l[-2] in {SECOND_LEVEL} then l[-2] || '.' || l[-1] else l[-1] end as suffix,
      case when length(l[-1]) = 2 and l[-2] in {SECOND_LEVEL}
        then case when len(l) <= 3 then array_to_string(l, '.') else l[-3] || '.' || l[-2] || '.' || l[-1] end
        else case when len(l) <= 2 then array_to_string(l, '.') else l[-2] || '.' || l[-1] end end as domain
    from (select *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as l from {{}})
"""
ORACLE_SQL = f"""
with parsed as (select page_id, {_HOST} as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
counts as (select p.host, count(*) as n, sum(l.quality) as good from parsed p join labels l on l.doc_id = p.page_id where l.quality is not null group by p.host),
counted as ({_NAMED.format("counts")}),
overall as (select (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2.0) as rate from counted),
s1 as (select suffix, sum(n) as n, sum(good) as good, (select rate from overall) as parent from counted group by suffix),
k1 as (select {_STRENGTH} as s from s1),
suffixes as (select suffix, n, (good + (select s from k1) * parent) / (n + (select s from k1)) as rate from s1),
s2 as (select d.*, f.rate as parent from (select domain, suffix, sum(n) as n, sum(good) as good from counted group by domain, suffix) d join suffixes f on f.suffix = d.suffix),
k2 as (select {_STRENGTH} as s from s2),
domains as (select domain, n, (good + (select s from k2) * parent) / (n + (select s from k2)) as rate from s2),
s3 as (select c.host, c.n, c.good, d.rate as parent from counted c join domains d on d.domain = c.domain),
k3 as (select {_STRENGTH} as s from s3),
seen as ({_NAMED.format("(select distinct host from parsed)")}),
prior as (
  select h.host, coalesce(c.n, 0) as n, coalesce(c.good, 0) as good, coalesce(d.rate, f.rate, (select rate from overall)) as prior, (select s from k3) as s,
    least((select s from k3), coalesce(d.n, f.n, (select coalesce(sum(n), 0) from counted))) as worth
  from seen h left join counts c on c.host = h.host left join domains d on d.domain = h.domain left join suffixes f on f.suffix = h.suffix),
rated as (select host, n, worth, (good + s * prior) / (n + s) as rate from prior),
ruled as (
  select page_id, host, path, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule
  from parsed)
select u.page_id, u.host, u.path, u.rule,
  case when u.rule in ('org/', 'com/fr/') then 'allow' when u.rule is not null then 'block'
    when r.rate + {Z} * sqrt(r.rate * (1 - r.rate) / (r.n + r.worth + 1)) < (select rate from overall) then 'block' else 'allow' end as verdict
from ruled u join rated r on r.host = u.host
"""
