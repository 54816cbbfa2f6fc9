"""URL filters by empirical-Bayes host reputation.

A page whose url names a labelled document has an outcome: bad if that document
is toxic or of quality 0.  Bad shares are shrunk down a tree: each suffix towards
the overall share, each registered domain towards its suffix, each host towards
its domain.  A level's prior is beta-binomial, with the parent's posterior mean
and a strength that the spread of the level's shares gives by moments.  A host
whose bad share is above the threshold with the posterior's lower bound is blocked.
Given rules go first; the longest that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkjourney.llm.common import cut

#: Fixed rules of the registered query: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A host is blocked if mean - BOUND standard deviations of its bad share exceed THRESHOLD.
THRESHOLD, BOUND = 0.5, 1.645
#: Limits of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which names are registered (co.uk, com.br, ...), when the last label is a country's.
SECOND = "ac co com edu gov net org"
DOCUMENT = r"^/[^/]*/([0-9]+)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, whole, i), F.lit(""))
    return F.translate(part(1), _UP, _LOW), part(2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null.  The rules are a short literal list."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        text = F.when(fits, own + start).otherwise(text)
        verdict = F.when(fits, what).otherwise(verdict)
    return text, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without its port."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    label = F.split(name, r"\.")
    n = F.size(label)
    two = (n >= 3) & (F.length(F.element_at(label, -1)) == 2) & F.array_contains(F.split(F.lit(SECOND), " "), F.element_at(label, F.greatest(-n, F.lit(-2))))
    keep = F.when(two, 3).otherwise(2)
    tail = lambda k: F.array_join(F.slice(label, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return tail(keep), tail(keep - 1)


def _shrunk(level: DataFrame, parent: DataFrame | float, key: str, up: str = "") -> DataFrame:
    """Posterior mean of the bad share of each ``key``: counts (key, up, n, k) and
    parent means (up, m), or one mean for all.  With spread S = sum n (k / n - m)^2 / (m (1 - m)) over K
    members, the beta-binomial correlation is (S - K) / (N - sum n^2 / N)."""
    both = level.withColumn("m", F.lit(parent)) if isinstance(parent, float) else level.join(parent, up)
    share = F.col("k") / F.greatest(F.col("n"), F.lit(1))
    fit = both.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(share - F.col("m"), 2) / (F.col("m") * (1 - F.col("m")))).alias("s"),
        F.count("*").alias("members"), F.sum("n").alias("pages"), F.sum(F.col("n") * F.col("n")).alias("squares")).first()
    room = fit["pages"] - fit["squares"] / fit["pages"] if fit["pages"] else 0
    rho = min(1.0, max(0.0, (fit["s"] - fit["members"]) / room)) if room else 0.0
    strength = min(STRONGEST, max(WEAKEST, (1 - rho) / rho)) if rho > 0 else STRONGEST
    a, total = F.lit(strength) * F.col("m") + F.col("k"), F.lit(strength) + F.col("n")
    return both.select(key, "n", "k", (a / total).alias("m"), F.sqrt((a / total) * (1 - a / total) / (total + 1)).alias("deviation"))


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, k, m, deviation): labelled pages, bad ones, posterior mean and
    deviation of every host's bad share.  Counts are partial aggregates, so a host
    with a third of all pages sends one row a task; what the driver fetches is one
    row of moments a level."""
    host, path = url_parts(F.col("url"))
    own = pages.select(host.alias("host"), path.alias("path")).select(
        "host", F.expr(f"try_cast(nullif(regexp_extract(path, '{DOCUMENT}', 1), '') AS BIGINT)").alias("doc_id"))
    outcome = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    seen = own.groupBy("host", "doc_id").agg(F.count("*").alias("pages")).join(outcome, "doc_id", "left")
    domain, suffix = levels(F.col("host"))
    hosts = cut(seen.groupBy("host").agg(F.sum(F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(0)).alias("n"),
                                         F.sum(F.when(F.col("bad") == 1, F.col("pages")).otherwise(0)).alias("k"))
                .withColumn("domain", domain).withColumn("suffix", suffix))
    summed = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = summed(hosts, "domain", "suffix")
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    overall = (whole["k"] + 0.5) / (whole["n"] + 1.0)
    by_suffix = _shrunk(summed(domains, "suffix"), float(overall), "suffix").select("suffix", "m")
    by_domain = _shrunk(domains, by_suffix, "domain", "suffix").select("domain", "m")
    return _shrunk(hosts.drop("suffix"), by_domain, "host", "domain")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = THRESHOLD, bound: float = BOUND) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_pages, host_bad, host_share, host_bound) per
    row of pages(page_id, url): the verdict, and what the posterior of the page's host says:
    its labelled pages, the bad ones, the mean of the bad share and its lower bound (both
    rounded to six places); the host is blocked if the bound exceeds ``threshold``.

    A null url, or one without ://, has empty host and path (and the reputation of
    the empty host); labels with null doc_id or outcome count for nothing bad; a
    document labelled twice is bad if either label is; repeated pages repeat; empty
    tables give no rows or leave every host at the overall share; other columns are ignored."""
    host, path = url_parts(F.col("url"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    known = reputations(pages.select("url"), labels.select("doc_id", "quality", "toxic")).select(
        "host", F.when(F.col("m") - F.lit(bound) * F.col("deviation") > threshold, "block").otherwise("allow").alias("judged"),
        F.col("n").alias("host_pages"), F.col("k").alias("host_bad"), F.round("m", 6).alias("host_share"),
        F.round(F.col("m") - F.lit(bound) * F.col("deviation"), 6).alias("host_bound"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return (pages.select("page_id", host.alias("host"), path.alias("path")).join(known, "host", "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("judged"), F.lit("allow")).alias("verdict"),
                    "host_pages", "host_bad", "host_share", "host_bound"))


def judge_sql(rules=RULES, threshold: float = THRESHOLD, bound: float = BOUND) -> str:
    """``judge`` in SQL over the pages and labels tables."""
    def shrunk(level: str, parent: str, key: str, up: str) -> str:
        return f"""
{level}_b AS (SELECT c.*, p.m FROM {level} c JOIN {parent} p USING ({up})),
{level}_f AS (SELECT sum(n * pow(k / CAST(n AS DOUBLE) - m, 2) / (m * (1 - m))) AS s, count(*) AS members, CAST(sum(n) AS DOUBLE) AS pages,
    CAST(sum(n * n) AS DOUBLE) AS squares FROM {level}_b WHERE n > 0),
{level}_r AS (SELECT CASE WHEN pages IS NULL OR pages - squares / pages = 0 THEN 0.0
    ELSE least(1.0, greatest(0.0, (s - members) / (pages - squares / pages))) END AS rho FROM {level}_f),
{level}_g AS (SELECT CASE WHEN rho > 0 THEN least({STRONGEST}, greatest({WEAKEST}, (1 - rho) / rho)) ELSE {STRONGEST} END AS strength FROM {level}_r),
{level}_m AS (SELECT b.{key}, b.n, b.k, (g.strength * b.m + b.k) / (g.strength + b.n) AS m, g.strength + b.n AS total FROM {level}_b b, {level}_g g)"""

    fits = lambda own, start: f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{start}')"
    longest = sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest) + " END"
    part = lambda i: f"coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', {i}, 's'), '')"
    return f"""
WITH u AS (SELECT page_id, translate({part(1)}, '{_UP}', '{_LOW}') AS host, {part(2)} AS path FROM pages),
o AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
l AS (SELECT host, bad, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS label
      FROM u LEFT JOIN o ON o.doc_id = TRY_CAST(nullif(regexp_extract(path, '{DOCUMENT}', 1), '') AS BIGINT)),
k AS (SELECT *, CASE WHEN len(label) >= 3 AND len(label[-1]) = 2 AND list_contains(string_split('{SECOND}', ' '), label[-2]) THEN 3 ELSE 2 END AS keep FROM l),
hosts AS (SELECT host, array_to_string(label[greatest(len(label) - keep + 1, 1):], '.') AS domain,
    array_to_string(label[greatest(len(label) - keep + 2, 1):], '.') AS suffix, CAST(count(bad) AS BIGINT) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS k
    FROM k GROUP BY ALL),
domains AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, 1 AS every, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM domains GROUP BY ALL),
overall AS (SELECT 1 AS every, (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS m FROM suffixes),
{shrunk("suffixes", "overall", "suffix", "every")},
{shrunk("domains", "suffixes_m", "domain", "suffix").replace("p.m FROM domains c JOIN suffixes_m p", "p.m FROM domains c JOIN (SELECT suffix, m FROM suffixes_m) p")},
{shrunk("hosts", "domains_m", "host", "domain").replace("SELECT c.*, p.m FROM hosts c JOIN domains_m p", "SELECT c.host, c.domain, c.n, c.k, p.m FROM hosts c JOIN (SELECT domain, m FROM domains_m) p")},
judged AS (SELECT host, CASE WHEN m - {bound} * sqrt(m * (1 - m) / (total + 1)) > {threshold} THEN 'block' ELSE 'allow' END AS judged,
    n AS host_pages, k AS host_bad, round(m, 6) AS host_share, round(m - {bound} * sqrt(m * (1 - m) / (total + 1)), 6) AS host_bound FROM hosts_m)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, judged, 'allow') AS verdict, host_pages, host_bad, host_share, host_bound FROM u LEFT JOIN judged USING (host)"""
