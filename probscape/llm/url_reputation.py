"""URL filter: fixed rules first, then empirical-Bayes reputation of hosts, in DataFrame functions only.

Pages that a rule decides are the labelled outcomes. The share of blocked pages of a host is shrunk towards its
registered domain's, that towards its suffix's, and that towards all pages': each step is a beta-binomial prior
whose mean is the parent's posterior mean and whose precision is estimated from the spread of the children's
shares around it; where the parent's own mean is uncertain, the child's prior is wider by as much. A page without
a rule is blocked where the lower bound of its host's posterior lies above a half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probscape.llm.common import Stages

#: Standard deviations between a posterior's mean and its bound.
BOUND = 2.0
#: A host is blocked if the bound of its blocked share lies above.
WORST = 0.5
#: Hosts with at least this share of all rows are joined without a shuffle; there are at most 1 / HOT of them.
HOT = 0.001
#: Limits of the correlation of outcomes within a group, that is, of the prior's precision 1 / rho - 1.
LEAST_RHO, MOST_RHO = 0.001, 0.999

#: Suffixes of two names under which domains are registered; a fixed value, to be replaced by a fuller list.
TWO_NAMES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "co.in", "com.br", "com.cn", "com.mx", "co.za")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    whole = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.coalesce(F.substring_index(whole, "/", 1), F.lit(""))
    path = F.coalesce(F.substr(whole, F.length(host) + 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_hosts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``pages`` with the columns of ``hosts`` (one row a host, ``rows`` of them in ``pages``) added.

    Frequent hosts are sent to the pages, all others are joined by a shuffle, in which none of them weighs more
    than HOT of all rows.
    """
    total = hosts.agg(F.sum("rows").alias("total")).first()["total"] or 0
    hot = hosts.where(F.col("rows") >= HOT * total)
    marked = pages.join(F.broadcast(hot), "host", "left")
    known = marked.where("rows IS NOT NULL")
    rare = marked.where("rows IS NULL").select(*pages.columns)
    return known.unionByName(rare.join(hosts.where(F.col("rows") < HOT * total), "host"))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts`` with ``rules``: those of the host and of the domains above it, the longest first."""
    names = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    rule = F.concat("rule_host", "rule_path")
    each = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    one = F.struct((-F.length(rule)).alias("order"), rule.alias("rule"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"))
    found = hosts.select("host", F.explode(above).alias("rule_host")).join(each, "rule_host").groupBy("host").agg(F.sort_array(F.collect_set(one)).alias("rules"))
    return hosts.join(found, "host", "left")


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; port and user are left out, numbers stand for themselves."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    listed = two.isin(*TWO_NAMES)
    suffix = F.when(listed, two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(listed, F.substring_index(bare, ".", -3)).otherwise(two)
    number = bare.rlike(r"^[0-9.]+$")
    return F.when(number, bare).otherwise(domain), F.when(number, F.lit("")).otherwise(suffix)


def precision(groups: DataFrame) -> Column:
    """Precision of the prior of ``groups`` (``n, k`` and the parent's mean ``m``), from their spread (moments)."""
    noise = F.sum(F.expr("m * (1 - m)"))
    spread = F.sum(F.expr("(k - n * m) * (k - n * m) / n"))
    room = F.sum(F.expr("(n - 1) * m * (1 - m)"))
    rho = F.coalesce(F.try_divide(spread - noise, room), F.lit(MOST_RHO))
    row = groups.where("n > 0").agg(F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), rho)).alias("rho")).first()
    return F.lit(1.0 / (row["rho"] if row["rho"] is not None else MOST_RHO) - 1.0)


def posterior(groups: DataFrame) -> DataFrame:
    """``groups`` (``n, k``, the parent's mean ``m`` and variance ``v``) with their posterior's parameters ``a, b``.

    The prior is the beta distribution with mean ``m`` and the variance of a share drawn with the estimated
    precision around a parent's mean that itself varies by ``v``.
    """
    s = precision(groups)
    wide = groups.withColumn("s", (s + 1) * F.expr("m * (1 - m)") / (F.expr("m * (1 - m)") + F.col("v") * s) - 1)
    return wide.withColumn("a", F.expr("s * m + k")).withColumn("b", F.expr("s * (1 - m) + n - k")).drop("m", "v", "s")


#: Mean and variance of a beta distribution.
MEAN, VARIANCE = "a / (a + b)", "a * b / ((a + b) * (a + b) * (a + b + 1))"


def reputations(stages: Stages, outcomes: DataFrame) -> DataFrame:
    """``host, domain, suffix, n, k, a, b, bound`` from labelled outcomes (``host, n`` pages, ``k`` of them blocked)."""
    domain, suffix = registered(F.col("host"))
    hosts = stages.keep(outcomes.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"))
    domains = stages.keep(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = stages.keep(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    every = suffixes.agg((F.sum("k") + 0.5).alias("a"), (F.sum("n") - F.sum("k") + 0.5).alias("b"))
    top = every.selectExpr(MEAN, VARIANCE).first()
    level = posterior(suffixes.withColumn("m", F.lit(top[0]).cast("double")).withColumn("v", F.lit(top[1]).cast("double")))
    level = posterior(domains.join(level.selectExpr("suffix", f"{MEAN} AS m", f"{VARIANCE} AS v"), "suffix"))
    level = posterior(hosts.join(level.selectExpr("suffix", "domain", f"{MEAN} AS m", f"{VARIANCE} AS v"), ["suffix", "domain"]))
    return level.withColumn("bound", F.expr(f"{MEAN} - {BOUND} * sqrt({VARIANCE})"))


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url``; other columns are not read).

    ``rules`` has ``host, path, verdict`` (allow or block): a rule fits its host and all subdomains if the
    page's path starts with the rule's; the longest wins, of equally long ones the first in order. A null url,
    or one without ``://``, has an empty host and path, and is a page of the empty host. Repeated rows are
    judged alike and count as often as they occur. Where no page has a rule, all are allowed: an outcome that was
    never seen has no reputation. An empty table gives no rows.
    """
    stages = Stages(pages.sparkSession, "reputation")
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    hosts = stages.keep(rules_by_host(rows.groupBy("host").agg(F.count("*").alias("rows")), rules))
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    ruled = with_hosts(rows, hosts).select("page_id", "host", "path", F.try_element_at(fits, F.lit(1)).alias("first"))
    seen = ruled.groupBy("host").agg(F.count("first").alias("n"), F.count_if(F.col("first.verdict") == "block").alias("k"))
    known = reputations(stages, seen).select("host", F.when(F.col("bound") > WORST, F.lit("block")).otherwise(F.lit("allow")).alias("known"))
    told = with_hosts(rows, stages.keep(hosts.join(known, "host"))).withColumn("first", F.try_element_at(fits, F.lit(1)))
    return told.select("page_id", "host", "path", F.col("first.rule").alias("rule"), F.coalesce("first.verdict", "known").alias("verdict"))
