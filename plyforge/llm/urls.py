"""URL filters: explicit rules first, then a path-template tree judged by smoothed labelled purity.

Segments that are numbers, hexadecimal strings or dates are generalised by their form. Then, level by level and host by
host, a segment stays literal only if it has pages enough; the others become a wildcard. From the deepest level up,
sibling branches that differ in one literal only and whose labelled rates of bad pages don't differ significantly are
merged: a sibling is compared with all of the branch so far and with its first. A template whose smoothed share of good
pages is too low is rejected. The tree is as deep as pages share paths. Everything runs on counts by generalised path;
pages themselves are joined to their template once. Wildcards and merged segments begin with #, which no path holds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import materialize, read, sized

#: Fixed values: (host, path, verdict); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: A literal segment needs this many pages.
MIN_PAGES = 5
#: Siblings merge while their bad rates lie within this many standard errors.
SIMILAR = 1.96
#: Templates with a smoothed purity below MIN_PURITY are rejected; STRENGTH labelled pages' worth of prior.
MIN_PURITY, STRENGTH = 0.6, 10.0
#: A merged segment lists this many siblings; more are named by the least, their number and a hash of all.
LISTED = 50


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int) -> Column:
    """The longest fitting rule (what 0) or its verdict (what 1); null where none fits."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.lit([h + p, verdict][what])).otherwise(out)
    return out


def generalised(path: Column) -> Column:
    """A path's segments, variable ones by form: #date, #num, #hex with what follows a dot."""
    form = lambda s: (
        F.when(s.rlike(r"^\d{4}-\d\d?-\d\d?$"), F.lit("#date"))
        .when(s.rlike(r"^\d+(\.[A-Za-z]+)?$"), F.regexp_replace(s, r"^\d+", "#num"))
        .when(s.rlike(r"^(?=.*\d)[0-9A-Fa-f-]{8,}(\.[A-Za-z]+)?$"), F.regexp_replace(s, r"^[0-9A-Fa-f-]+", "#hex"))
        .otherwise(s)
    )
    return F.transform(F.split(F.regexp_replace(path, r"^/", ""), "/"), form)


def shown(segments: Column) -> Column:
    """A template as text: <num>, <hex>, <date>, * and (a|b) where generalised segments stand."""
    plain = F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, r"^#(num|hex|date)", "<$1>"), "^#|#(?=[|])", ""))
    return F.concat(F.lit("/"), F.array_join(plain, "/"))


def differ(m: int, b: int, other_m: int, other_b: int) -> bool:
    p = (b + other_b + 1) / (m + other_m + 2)
    return abs((b + 0.5) / (m + 1) - (other_b + 0.5) / (other_m + 1)) > SIMILAR * (p * (1 - p) * (1 / (m + 1) + 1 / (other_m + 1))) ** 0.5


def pooled_branches(counts: pd.DataFrame) -> pd.DataFrame:
    """The branch of each (m, b), with c siblings, of one place: in order of rates, a new one where a sibling differs
    from the pooled counts of the branch so far or from its first. Siblings without labels are branch -1."""
    counts = counts.assign(rate=(counts.b + 0.5) / (counts.m + 1)).sort_values(["rate", "m"], ignore_index=True)
    out, branch, pool, first = [], 0, (0, 0), (0, 0)
    for m, b, c in zip(counts.m.tolist(), counts.b.tolist(), counts.c.tolist()):
        if m and pool[0] and (differ(m, b, *pool) or differ(m, b, *first)):
            branch, pool = branch + 1, (0, 0)
        if m and not pool[0]:
            first = m, b
        pool = pool[0] + c * m, pool[1] + c * b
        out.append(branch if m else -1)
    return counts.assign(branch=out)[["host", "hole", "m", "b", "branch"]]


FORMS = ("#num", "#hex", "#date")


def with_literals(known: DataFrame) -> tuple[DataFrame, int]:
    """known with rare segments of cur as #*, and the number of levels that have literals; see template_tree."""
    forms = F.col("seg").isin(*FORMS)
    closed = lambda level: F.transform("cur", lambda s, i: F.when((i >= level - 1) & ~s.isin(*FORMS), F.lit("#*")).otherwise(s))
    done, level = [], 1
    while True:
        done.append(known.where(F.size("cur") < level).select("host", "pre", "n", "m", "b", "cur"))
        at = known.where(F.size("cur") >= level).withColumn("seg", F.get("cur", F.lit(level - 1))).withColumn("prefix", F.array_join(F.slice("cur", 1, level - 1), "/"))
        children = materialize(at.groupBy("host", "prefix", "seg").agg(F.sum("n").alias("c")), "children")
        nodes = children.groupBy("host", "prefix").agg(F.sum("c").alias("total")).where(F.col("total") >= MIN_PAGES)
        # Branches with enough pages go on, and of their children those with enough are literals.
        went = children.join(nodes, ["host", "prefix"]).select("host", "prefix", "seg", (forms | (F.col("c") >= MIN_PAGES)).alias("stays"))
        went = materialize(went, "literals")
        told = materialize(at.join(sized(went), ["host", "prefix", "seg"], "left"), "paths")
        done.append(told.where("stays is null").select("host", "pre", "n", "m", "b", closed(level).alias("cur")))
        replaced = F.transform("cur", lambda s, i: F.when((i == level - 1) & ~F.col("stays"), F.lit("#*")).otherwise(s))
        known = told.where("stays is not null").select("host", "pre", "n", "m", "b", replaced.alias("cur"))
        if known.isEmpty():
            break
        known, level = materialize(known, "paths"), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return materialize(out, "paths"), level - 1


def template_tree(pages: DataFrame) -> DataFrame:
    """(host, pre, cur, n, m, b) of each host and generalised path pre of pages (host, pre, labelled, bad).

    cur, the template, is pre with rare segments as #* and merged ones as #(a|b). n, m and b are the whole template's
    pages, labelled pages and bad pages. Where labels are few, branches look alike and merge. A path leaves the loop over
    levels where its branch has fewer than MIN_PAGES pages, as nothing below can be a literal: a long path costs levels
    only as far as others share it.
    """
    known = pages.groupBy("host", "pre").agg(F.count("*").alias("n"), F.sum("labelled").alias("m"), F.sum("bad").alias("b"))
    known, depth = with_literals(materialize(known.withColumn("cur", F.col("pre")), "paths"))
    for level in range(depth, 0, -1):
        stats = known.groupBy("host", "cur").agg(F.sum("m").alias("m"), F.sum("b").alias("b")).where(F.size("cur") >= level)
        seg = F.get("cur", F.lit(level - 1))
        hole = F.array_join(F.transform("cur", lambda s, i: F.when(i == level - 1, F.lit("#")).otherwise(s)), "/")
        stats = materialize(stats.withColumn("seg", seg).withColumn("hole", hole).where("not startswith(seg, '#')"), "siblings")
        counts = stats.groupBy("host", "hole", "m", "b").agg(F.count("*").alias("c"))
        branches = counts.groupBy("host", "hole").applyInPandas(pooled_branches, "host string, hole string, m long, b long, branch long")
        stats = materialize(stats.join(sized(materialize(branches, "branches")), ["host", "hole", "m", "b"]), "siblings")
        named = stats.groupBy("host", "hole", "branch").agg(F.count("*").alias("k"), F.min("seg").alias("least"), F.bit_xor(F.xxhash64("seg")).alias("all")).where("k > 1")
        of = stats.join(named, ["host", "hole", "branch"])
        few = of.where(F.col("k") <= LISTED).groupBy("host", "hole", "branch").agg(F.array_sort(F.collect_set("seg")).alias("segs"))
        union = F.concat(F.lit("#("), F.array_join(F.transform("segs", lambda s: F.replace(s, F.lit("|"), F.lit("#|"))), "|"), F.lit(")"))
        few = few.select("host", "hole", F.explode("segs").alias("seg"), union.alias("union"))
        many = of.where(F.col("k") > LISTED).select("host", "hole", "seg", F.format_string("#(%s|+%d:%x)", "least", F.col("k") - 1, "all").alias("union"))
        to = materialize(few.unionAll(many), "merges")
        here = known.withColumn("seg", seg).withColumn("hole", hole)
        replaced = F.transform("cur", lambda s, i: F.when((i == level - 1) & F.col("union").isNotNull(), F.col("union")).otherwise(s))
        known = materialize(here.join(sized(to), ["host", "hole", "seg"], "left").select("host", "pre", "n", "m", "b", replaced.alias("cur")), "paths")
    totals = known.groupBy("host", "cur").agg(*(F.sum(x).alias(x) for x in "nmb"))
    return known.select("host", "pre", "cur").join(totals, ["host", "cur"])


def judge_urls(pages: DataFrame, labels: DataFrame, label_key: Column, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of each row of pages (page_id, url).

    labels (doc_id, quality, toxic): a page is bad if its label has quality 0 or toxic 1; label_key gives its doc_id
    from the column path. Several labels of one doc_id: bad if one is. purity is the template's share of good labelled
    pages, smoothed towards its host's, and that towards the whole table's; a template without a labelled page isn't
    rejected, whatever its purity. A null url, or one
    without ://, has empty host and path, and the template / of the empty host. Repeated rows stay; extra columns are
    ignored. An empty table gives no rows.
    """
    url = F.col("url").cast("string")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    slim = slim.withColumn("key", label_key.cast("long")).withColumn("pre", generalised(F.col("path")))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    judged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(bad).alias("bad"), F.lit(1).alias("labelled"))
    seen = slim.select("host", "pre", "key").join(judged, "key", "left").select("host", "pre", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"))
    tree = materialize(template_tree(seen), "tree")
    by_host = tree.select("host", "cur", "m", "b").distinct().groupBy("host").agg(F.sum("m").alias("host_m"), F.sum("b").alias("host_b"))
    all_m, all_b = by_host.agg(F.sum("host_m"), F.sum("host_b")).first()
    base = (all_b or 0) / all_m if all_m else 0.0
    host_rate = (F.col("host_b") + STRENGTH * base) / (F.col("host_m") + STRENGTH)
    rate = (F.col("b") + STRENGTH * host_rate) / (F.col("m") + STRENGTH)
    tree = materialize(tree.join(by_host, "host").select("host", "pre", shown(F.col("cur")).alias("template"), F.round(1 - rate, 9).alias("purity"), (F.col("m") > 0).alias("known")), "judged")
    found = slim.join(sized(tree), ["host", "pre"])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules, 0), rule_of(F.col("host"), F.col("path"), rules, 1)
    by_method = F.when(F.col("known") & (F.col("purity") < MIN_PURITY), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "template", "purity")


def last_number(path: Column) -> Column:
    """The last run of digits in a path, 18 at most: the document that a page of this corpus renders."""
    return F.nullif(F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1), F.lit("")).try_cast("long")


def op5_path_template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge_urls on all pages; nulls, repeated rows and an empty table as there."""
    return judge_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), last_number(F.col("path")))
