"""URL filters: explicit rules, and a tree of path templates for what no rule decides.

Labels (1 bad, 0 good) come from a table or, without one, from the rules' verdicts and, where no rule fits, from a
list of words: a url with one of them in its host or path is labelled bad, any other is presumed good. They
are only evidence: what decides an unruled page is its template.

The tree of a host: path segments that look like values (with a digit, or of over LONG characters) become wildcards at
once; a position becomes one where a branch has many different children for its rows. From the last position to the
first, siblings that differ there alone and whose shares of bad labels don't differ from their fellows' by a
two-proportion test are merged into one branch, named ``(*)`` there, whose labels are those of all of them. A template is
rejected if its purity, (bad + STRENGTH x overall share) / (labels + STRENGTH), reaches ``purity`` and it has
``least`` labels. A branch without a label isn't merged and stays allowed. Only counts by host and template are
shuffled, so a host with very many pages is a few rows; the verdicts return by a join on them.

Null url or one without ``://``: host and path are empty, no rule fits; they form a template of their own.
Repeated rows are judged each and count each. Only page_id and url are read (and page_id and label of a
table of labels; the largest of several labels counts); other columns are left out. Paths may have any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlab.storage import drop_table, write_table

#: The rules (host and path, verdict).
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Words that label a url as bad where no rule fits.
WORDS = ("casino", "poker", "bets", "betting", "lottery", "pills", "viagra", "porn", "xxx", "escort", "payday", "replica")
LONG, MANY_CHILDREN, VARIETY = 40, 20, 0.5
PURITY, LEAST, STRENGTH, Z = 0.9, 5, 2.0, 1.96
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, pattern, 1), *_AZ), F.regexp_extract(whole, pattern, 2)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _template(path: Column) -> Column:
    """Segments, with a wildcard for each that looks like a value."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike(r"\d") | (F.char_length(s) > LONG), "*").otherwise(s))


def _put(level: int, sign: str) -> Column:
    return F.transform("template", lambda s, i: F.when(i == level, sign).otherwise(s))


def _kept(shapes: DataFrame, level: int) -> DataFrame:
    """The table, written after some levels, so that a plan never holds more of them."""
    return write_table(shapes, "shapes") if level % 4 == 3 else shapes


def generalise(shapes: DataFrame, depth: int) -> DataFrame:
    """shapes (host, template, n, ...) with wildcards at the positions where a branch's children vary."""
    for level in range(depth):
        branch, child = F.slice("template", 1, level) if level else F.array().cast("array<string>"), F.get("template", F.lit(level))
        keys = shapes.select("host", branch.alias("branch"), child.alias("child"), "n").filter("child IS NOT NULL AND child <> '*'")
        children = keys.groupBy("host", "branch", "child").agg(F.sum("n").alias("n"))
        varied = children.groupBy(F.col("host").alias("_h"), F.col("branch").alias("_b")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).filter((F.col("kinds") > MANY_CHILDREN) & (F.col("kinds") >= VARIETY * F.col("n"))).select("_h", "_b")
        joined = shapes.join(varied, (F.col("host") == F.col("_h")) & (branch == F.col("_b")), "left")
        shapes = _kept(joined.withColumn("template", F.when(F.col("_h").isNotNull() & child.isNotNull(), _put(level, "*")).otherwise(F.col("template"))).drop("_h", "_b"), level)
    return shapes


def merge(shapes: DataFrame, depth: int) -> DataFrame:
    """shapes (host, template, seen, bad, ...) with (*) for the siblings whose shares of bad labels are alike."""
    for level in reversed(range(depth)):
        own = shapes.groupBy("host", "template").agg(F.sum("seen").alias("n"), F.sum("bad").alias("b")).filter(f"n > 0 AND size(template) > {level}").withColumn("pool", _put(level, "(*)"))
        pools = own.groupBy(F.col("host").alias("_h"), F.col("pool").alias("_p")).agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"), F.count("*").alias("k")).filter("k > 1")
        others, p = F.col("pn") - F.col("n"), F.col("pb") / F.col("pn")
        far = F.abs(F.col("b") / F.col("n") - (F.col("pb") - F.col("b")) / others) > Z * F.sqrt(p * (1 - p) * (1 / F.col("n") + 1 / others))
        alike = own.join(pools, (F.col("host") == F.col("_h")) & (F.col("pool") == F.col("_p"))).filter(~far).select(F.col("host").alias("_oh"), F.col("template").alias("_ot"), "pool")
        joined = shapes.join(alike, (F.col("host") == F.col("_oh")) & (F.col("template") == F.col("_ot")), "left")
        shapes = _kept(joined.withColumn("template", F.coalesce("pool", "template")).drop("_oh", "_ot", "pool"), level)
    return shapes


def judge_templates(rows: DataFrame, purity: float = PURITY, least: int = LEAST) -> DataFrame:
    """host, shape, template, labels, purity and rejected of every distinct (host, shape) of rows (host, path, label 0/1/null)."""
    shapes = rows.groupBy("host", _template(F.col("path")).alias("shape")).agg(F.count("*").alias("n"), F.count("label").alias("seen"), F.sum(F.coalesce("label", F.lit(0))).alias("bad"))
    shapes = write_table(shapes.withColumn("template", F.col("shape")), "shapes")
    whole = shapes.agg(F.max(F.size("shape")).alias("depth"), F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).first()
    prior = (whole["bad"] or 0) / whole["seen"] if whole["seen"] else 0.0
    tree = write_table(merge(generalise(shapes, whole["depth"] or 0), whole["depth"] or 0), "tree")
    drop_table(shapes)
    sums = tree.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(F.sum("seen").alias("labels"), F.sum("bad").alias("bad_labels"))
    share = (F.col("bad_labels") + STRENGTH * prior) / (F.col("labels") + STRENGTH)
    judged = tree.join(sums, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
    return judged.select("host", "shape", F.array_join("template", "/").alias("template"), "labels", share.alias("purity"), ((share >= purity) & (F.col("labels") >= least)).alias("rejected"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, labels: DataFrame | None = None, words: tuple[str, ...] = WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict, template, labels and purity of every page. labels: page_id and label (1: bad), in place of the rules' and words'."""
    host, path = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    rows = rows.withColumn("by_rule", by_rule)
    if labels is None:
        named = F.lower(F.concat("host", "path")).rlike(rf"(^|[^a-z])({'|'.join(words)})([^a-z]|$)") if words else F.lit(False)
        rows = rows.withColumn("label", F.when(F.col("by_rule").isNotNull(), F.col("by_rule") == "block").otherwise(named).cast("int"))
    else:
        known = labels.filter("page_id IS NOT NULL").groupBy(F.col("page_id").alias("_page")).agg(F.max("label").cast("int").alias("label"))
        rows = rows.join(known, F.col("page_id") == F.col("_page"), "left").drop("_page")
    found = judge_templates(rows).withColumnsRenamed({"host": "_h", "shape": "_s"})
    rows = rows.join(found, (F.col("host") == F.col("_h")) & (_template(F.col("path")) == F.col("_s")))
    verdict = F.coalesce("by_rule", F.when(F.col("rejected"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "labels", "purity")
