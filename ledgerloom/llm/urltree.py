"""URL filters: rules by host and path, and a tree of path templates per host judged by labelled purity. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (rule, verdict) of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A node with more children than this has its rare ones (under this share of its URLs) generalised.
CHILDREN, RARE = 20, 0.05
#: A branch and its siblings have like tokens if the shares of what comes next (nothing, a wildcard, a word) differ by at most APART in total, of so many URLs each.
ENOUGH, APART = 10, 0.25
#: They have like labels if their rates of bad labels, each host counted once, are within so many standard errors.
ERRORS = 1.96
#: Labels that the rate of the next wider place counts as, the rate where nobody has a label, and the smoothed share of bad labels that rejects a template.
WEIGHT, PRIOR, PURITY = 4.0, 0.3, 0.7
WILD = "*"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path; both empty for null and where :// is missing."""
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Meant for lists of up to some hundred rules."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def masked(path: Column) -> Column:
    """The segments of a path, those with a digit as wildcards."""
    return F.transform(F.array_remove(F.split(path, "/"), ""), lambda x: F.when(x.rlike("[0-9]"), WILD).otherwise(x))


def domain(host: Column) -> Column:
    """The last two labels of a host, or all of it."""
    last = F.regexp_extract(host, "([^.]*[.][^.]*)$", 1)
    return F.when(last == "", host).otherwise(last)


def _rate() -> Column:
    """Thousandths of bad labels: whole numbers, so that sums don't depend on their order."""
    return F.round(1000.0 * F.col("bad") / F.col("labelled")).cast("long").alias("rate")


def _unlike(shares: list[tuple[Column, Column]]) -> Column:
    n, others = F.col("n"), F.col("all_n") - F.col("n")
    total = sum((F.abs(own / n - (every - own) / others) for own, every in shares), F.lit(0.0))
    return total > 2 * APART


def _alike(n: Column, bad: Column, all_n: Column, all_bad: Column) -> Column:
    """Whether a branch's rate of bad labels is that of its siblings, within ERRORS standard errors; null where either has no labels."""
    others, whole = all_n - n, (all_bad + 0.5) / (all_n + 1.0)
    error = ERRORS * F.sqrt(whole * (1.0 - whole) * (1.0 / n + 1.0 / others))
    return F.when((n > 0) & (others > 0), F.abs(bad / n - (all_bad - bad) / others) <= error)


def grow(paths: DataFrame) -> DataFrame:
    """paths (host, segs, n, labelled, bad; one row for each, digits masked) with column template: the path of tree nodes that each ends in.

    Level by level, a segment becomes a wildcard if it has a digit, if it is rare under a node with many children, or if its branch is like
    its siblings: in what comes below them, and in its labels, both the host's and those that all hosts with the same branch give together. Segments below the
    last level are kept, so no two paths are taken for one because they are deep. All sums are of tables with a row per branch, never of
    URLs; joins on what many hosts share are sort-merge joins, which adaptive execution splits where a key is hot.
    """
    deepest = paths.agg(F.max(F.size("segs"))).first()[0] or 0
    at = paths.withColumn("template", F.lit(""))
    level = 0
    while level < deepest and not at.where(F.size("segs") > level).groupBy("host", "template").count().where("count > 1").isEmpty():
        at = at.withColumns({"seg": F.get("segs", F.lit(level)), "below": F.get("segs", F.lit(level + 1))})
        below = {"ends": F.col("below").isNull(), "wild": F.col("below") == WILD}
        child = at.where(F.col("seg") != WILD).groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")), *(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in below.items()))
        child = materialize(child)
        pooled = child.where("labelled > 0").select("template", "seg", _rate()).groupBy("template", "seg").agg(F.count("*").alias("hosts"), F.sum("rate").alias("rate"))
        around = pooled.groupBy("template").agg(F.sum("hosts").alias("all_hosts"), F.sum("rate").alias("all_rate"))
        shares = child.groupBy("host", "template").agg(F.count("*").alias("children"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "ends", "wild", "labelled", "bad")))
        each = child.join(shares, ["host", "template"]).join(pooled.join(around, "template").hint("merge"), ["template", "seg"], "left").join(around.select("template", F.col("all_hosts").alias("any_hosts")).hint("merge"), "template", "left")
        rest = lambda p: F.col(f"{p}n") - F.col(f"{p}ends") - F.col(f"{p}wild")
        tokens = (F.col("n") >= ENOUGH) & (F.col("all_n") - F.col("n") >= ENOUGH) & ~_unlike([(F.col("ends"), F.col("all_ends")), (F.col("wild"), F.col("all_wild")), (rest(""), rest("all_"))])
        here = _alike(F.col("labelled"), F.col("bad"), F.col("all_labelled"), F.col("all_bad"))
        elsewhere = _alike(F.col("hosts"), F.col("rate") / 1000.0, F.col("all_hosts"), F.col("all_rate") / 1000.0)
        labels = (F.col("any_hosts").isNull() | F.coalesce(elsewhere, F.lit(False))) & F.coalesce(here, F.lit(True))
        rare = (F.col("children") > CHILDREN) & (F.col("n") < RARE * F.col("all_n"))
        kept = each.where(~(rare | (tokens & labels))).select("host", "template", "seg", F.lit(True).alias("own"))
        at = at.join(kept.hint("merge"), ["host", "template", "seg"], "left")
        at = at.withColumn("template", F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("own"), F.col("seg")).otherwise(WILD)))).drop("seg", "below", "own")
        at, level = materialize(at), level + 1
    if deepest > level:
        left = F.transform(F.slice("segs", level + 1, deepest), lambda x: F.concat(F.lit("/"), x))
        at = at.withColumn("template", F.concat("template", F.array_join(left, "")))
    return at


def purities(tree: DataFrame) -> DataFrame:
    """host, template, purity for each template of a host: its share of bad labels, smoothed by that of the same template in the hosts of its
    domain, that by all hosts', and that by PRIOR. Beyond the host itself each host counts as one label, so a hot one can't decide for others."""
    own = materialize(tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).withColumn("domain", domain(F.col("host"))))
    rates = own.where("labelled > 0").select("domain", "template", _rate())
    near = rates.groupBy("domain", "template").agg(F.count("*").alias("near_n"), F.sum("rate").alias("near_rate"))
    wide = rates.groupBy("template").agg(F.count("*").alias("wide_n"), F.sum("rate").alias("wide_rate"))
    smooth = lambda bad, n, prior: (bad + WEIGHT * prior) / (n + WEIGHT)
    part = lambda name: (F.coalesce(f"{name}_rate", F.lit(0)) / 1000.0, F.coalesce(f"{name}_n", F.lit(0)))
    purity = smooth(F.col("bad"), F.col("labelled"), smooth(*part("near"), smooth(*part("wide"), F.lit(PRIOR))))
    return own.join(near.hint("merge"), ["domain", "template"], "left").join(wide.hint("merge"), "template", "left").select("host", "template", purity.alias("purity"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of pages.

    URLs that a rule fits get its verdict and are the labels. All others are blocked if their template has at least this smoothed purity of
    bad labels: where a host has few labels of its own, the same template of other hosts speaks for it. A null URL has an empty host
    and path. URLs are counted by host and masked path before anything else; the only step that deals out single pages is the last join, a
    sort-merge join, which splits for a hot host. Repeated rows stay repeated, a null id stays null, an empty table gives no
    rows, other columns are ignored.
    """
    host, path = parts(F.col("url"))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "said": verdict, "segs": masked(F.col("path"))}).withColumn("label", (F.col("said") == "block").cast("int"))
    paths = materialize(own.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")))
    tree = materialize(grow(paths))
    known = tree.join(purities(tree).hint("merge"), ["host", "template"]).select("host", "segs", "template", "purity")
    told = F.coalesce("said", F.when(F.col("purity") >= purity, "block").otherwise("allow"))
    return own.join(known.hint("merge"), ["host", "segs"], "left").select("page_id", "host", "path", "rule", told.alias("verdict"), "template", F.round("purity", 9).alias("purity"))
