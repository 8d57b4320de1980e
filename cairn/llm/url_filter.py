"""Operator 7: URL filters by empirical-Bayes host reputation, in SQL functions only.

Labelled page outcomes are counted per host, registered domain and suffix.
Each level's beta prior takes its mean from the level above and its strength
from the spread of the rates at its own level (method of moments, held within 2
and 200 labels), so a host with few labels leans on its domain and a host with many
stands for itself.  A host is blocked when the lower bound of its posterior rate of
bad pages, by the normal approximation, is above a tolerance; an explicit rule that
fits the url overrides this.

Cases: null urls and urls without ``://`` have host and path ``''`` and share
one reputation; a page with several labels counts each; labels that are null
count nothing; without any label every host has the posterior of the uniform
prior.  Repeated pages give repeated rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize

#: Public suffixes of two labels; fixed values.
TWO_LABEL_SUFFIXES = [
    "ac.jp", "ac.uk", "blogspot.com", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph",
    "com.pk", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "github.io", "gitlab.io",
    "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "nhs.uk", "or.jp",
    "or.kr", "org.au", "org.br", "org.cn", "org.in", "org.nz", "org.uk", "org.za", "pages.dev", "sch.uk", "web.app",
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def without_port(host: Column) -> Column:
    """The host as reputation reads it: a port is no part of its names."""
    return F.regexp_replace(host, ":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _spread(level: DataFrame) -> tuple[float, float, float]:
    """(strength, labels, bad labels) of a level: the prior's strength from the spread of its rates, three numbers."""
    row = level.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("b"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("b") * F.col("b") / F.col("n"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)), F.lit(0))).first()
    n, b, q, k = row
    if n == 0:
        return 2.0, 0.0, 0.0
    noise = b / n * (1 - b / n)
    between = (q - b * b / n) / n - noise * (k - 1) / n
    return min(200.0, max(2.0, noise / max(1e-6, between) - 1)), n, b


def host_reputation(pages: DataFrame, outcomes: DataFrame, *, z: float = 1.645) -> DataFrame:
    """One row per host of ``pages(page_id, host)``: posterior mean and lower bound.

    ``outcomes(page_id, bad)`` holds one row per label, ``bad`` 0, 1 or null.  Counts
    are written once, a row for each host; the levels above are sums of them.
    """
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    labelled = pages.join(outcomes.where(F.col("bad").isNotNull()), "page_id").groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("b"))
    level = materialize(hosts.join(labelled, "host", "left").select("host", "pages", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("b", F.lit(0.0)).alias("b"), domain_of(without_port(F.col("host"))).alias("domain"), suffix_of(without_port(F.col("host"))).alias("suffix")), "hosts")
    domain = level.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    s_host, n_all, b_all = _spread(level)
    s_domain, s_suffix = _spread(domain)[0], _spread(suffix)[0]
    out = level.join(domain.select("domain", "suffix", F.col("n").alias("n_d"), F.col("b").alias("b_d")), ["domain", "suffix"]).join(suffix.select("suffix", F.col("n").alias("n_s"), F.col("b").alias("b_s")), "suffix")
    mu_s = (F.col("b_s") + s_suffix * ((b_all + 1) / (n_all + 2))) / (F.col("n_s") + s_suffix)
    mu_d = (F.col("b_d") + s_domain * mu_s) / (F.col("n_d") + s_domain)
    out = out.withColumn("_a", F.col("b") + s_host * mu_d).withColumn("_c", F.col("n") - F.col("b") + s_host * (1 - mu_d))
    total = F.col("_a") + F.col("_c")
    return out.select("host", "domain", "suffix", "pages", "n", "b", (F.col("_a") / total).alias("bad_mean"), (F.col("_a") / total - z * F.sqrt(F.col("_a") * F.col("_c") / (total * total * (total + 1)))).alias("bad_low"))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of the host and of every domain above it, as an array.

    Rules meet hosts by an equality join on the host's own suffixes; a rule with
    a null in any column is no rule.
    """
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = rules.dropna(subset=["rule_host", "rule_path", "action"])
    return (
        hosts.select("host", F.explode(above).alias("rule_host"))
        .join(fits.select("rule_host", "rule_path", "action"), "rule_host")
        .groupBy("host")
        .agg(F.collect_list(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("size"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_path").alias("path"), "action")).alias("rules"))
    )


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, *, tolerance: float = 0.3, z: float = 1.645) -> DataFrame:
    """Judge each page: page_id, host, path, rule, verdict, bad_mean, bad_low.

    ``verdict`` is the action of the longest rule that fits (equal lengths: the
    greater rule text, then ``block``), else ``block`` where ``bad_low`` is above
    ``tolerance``, else ``allow``.
    """
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    fame = host_reputation(rows.select("page_id", "host"), outcomes.select("page_id", "bad"), z=z)
    # written, so that its size is known when the pages are joined: small enough it is sent to all tasks, else hot hosts are split
    fame = materialize(fame.join(host_rules(fame.select("host"), rules), "host", "left").select("host", "bad_mean", "bad_low", "rules"), "fame")
    best = F.array_max(F.transform(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["action"].alias("action"))))
    return (
        rows.join(fame, "host")
        .withColumn("_best", best)
        .select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.action"), F.when(F.col("bad_low") > tolerance, "block").otherwise("allow")).alias("verdict"), "bad_mean", "bad_low")
    )
