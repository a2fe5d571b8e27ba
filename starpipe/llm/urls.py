"""URL filters: host and path rules, and boosted trees on lexical features (operator 2).

Rules judge the URLs they fit; those URLs are the labels from which the trees learn, and the
trees judge the rest. Features are cut into bins and equal rows are summed once, so every level
of a tree is one small aggregate of gradients by node, feature and bin. A tree is emitted as a
nested conditional expression. Everything is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starpipe.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The given rules. Fixed values.
RULES = (
    Rule(ALLOW, "com", "/"),
    Rule(BLOCK, "example.com", "/en/"),
    Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"),
    Rule(BLOCK, "net", "/fr/"),
)

#: Lexical features of url, host and path; `suffix` is the share of blocked labels of its slot.
FEATURES = {
    "length": "CAST(length(url) AS DOUBLE)",
    "host_length": "CAST(length(host) AS DOUBLE)",
    "labels": "CAST(size(split(host, '[.]')) AS DOUBLE)",
    "depth": "CAST(regexp_count(path, '/') AS DOUBLE)",
    "digit_ratio": "length(regexp_replace(url, '[^0-9]', '')) / greatest(length(url), 1)",
    "parameters": "CAST(IF(url LIKE '%?%', 1 + regexp_count(url, '&'), 0) AS DOUBLE)",
    "entropy": "entropy",
    "suffix": "suffix_rate",
}


@dataclass(frozen=True)
class Boosting:
    """`slots` bounds the suffix table; bins, trees and depth bound what reaches the driver."""

    bins: int = 16
    trees: int = 10
    depth: int = 3
    rate: float = 0.4
    ridge: float = 1.0
    slots: int = 1024
    prior: float = 8.0


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url (null as empty), host in lower case (A to Z), path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_replace(url, "(?s)^.*?://", ""), "#", 1)).otherwise(F.lit(""))
    bare = F.substring_index(rest, "?", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
        F.translate(F.substring_index(bare, "/", 1), UPPER, LOWER).alias("host"),
        F.when(F.instr(bare, "/") > 0, F.substr(bare, F.instr(bare, "/"))).otherwise(F.lit("")).alias("path"))


def fitting_rule(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits host (or a parent of it) and path."""
    text, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits = host & F.col("path").startswith(rule.path)
        text, verdict = text.when(fits, F.lit(rule.text)), verdict.when(fits, F.lit(rule.verdict))
    return text, verdict


def _entropy(value: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty string."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    size = F.greatest(F.size(chars), F.lit(1))

    def bits(total, c):
        share = F.size(F.filter(chars, lambda x: x == c)) / size
        return total - share * F.log2(share)

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), bits)


def described(pages: DataFrame, rules: tuple[Rule, ...], boosting: Boosting) -> DataFrame:
    """Stored URLs with rule, verdict, the slot of their last two host labels and entropy."""
    rule, verdict = fitting_rule(rules)
    url = parsed(pages)
    return stored(url.select(
        "*", rule.alias("rule"), verdict.alias("judged"), _entropy(F.col("url")).alias("entropy"),
        F.pmod(F.xxhash64(F.substring_index("host", ".", -2)), F.lit(boosting.slots)).alias("slot")), "url-features")


def with_suffix_rate(rows: DataFrame, boosting: Boosting) -> DataFrame:
    """Adds the smoothed share of blocked labels of each suffix slot; at most `slots` rows are broadcast."""
    labelled = rows.where("judged IS NOT NULL")
    blocked = F.count(F.when(F.col("judged") == BLOCK, 1))
    whole = labelled.agg((blocked / F.greatest(F.count("judged"), F.lit(1))).alias("share")).first()["share"]
    rates = labelled.groupBy("slot").agg(((blocked + boosting.prior * whole) / (
        F.count("judged") + boosting.prior)).alias("suffix_rate"))
    joined = rows.join(F.broadcast(rates), "slot", "left")
    return joined.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(whole)))


# --- Trees --------------------------------------------------------------------------------

#: A node is a leaf value, or (feature, bin, left, right): left up to the bin, right above.
Tree = float | tuple


def emit(tree: Tree, bins: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    feature, cut, left, right = tree
    return F.when(bins[feature] <= cut, emit(left, bins)).otherwise(emit(right, bins))


def _place(tree: Tree, bins: dict[str, Column], paths: list[str], path: str = "") -> Column:
    """The path of the leaf that a row falls to."""
    if not isinstance(tree, tuple):
        return F.lit(path)
    feature, cut, left, right = tree
    return F.when(bins[feature] <= cut, _place(left, bins, paths, path + "l")).otherwise(
        _place(right, bins, paths, path + "r"))


SCALE = 1_000_000_000


def _level(rows: DataFrame, score: Column, tree: Tree, bins: dict[str, Column]) -> dict:
    """Gradient and curvature by leaf, feature and bin, summed as integers so that runs agree."""
    p = 1 / (1 + F.exp(-score))
    g = F.round((F.col("y") - p) * SCALE).cast("long") * F.col("n")
    h = F.round(p * (1 - p) * SCALE).cast("long") * F.col("n")
    stack = ", ".join(f"'{f}', bin_{f}" for f in FEATURES)
    out: dict = {}
    for r in rows.select("*", g.alias("g"), h.alias("h"), _place(tree, bins, []).alias("leaf")).selectExpr(
            "leaf", "g", "h", f"stack({len(FEATURES)}, {stack}) AS (feature, bin)").groupBy(
            "leaf", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out.setdefault(r["leaf"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"], r["h"])
    return out


def _split(held: dict, boosting: Boosting) -> tuple[float, tuple[str, int] | None]:
    """The value of a leaf and its best split."""
    first = next(iter(held.values()))
    g, h = (sum(v[k] for v in first.values()) / SCALE for k in (0, 1))
    value, best, cut = g / (h + boosting.ridge), 1e-9, None
    for feature in FEATURES:
        left_g = left_h = 0.0
        for b in sorted(held[feature])[:-1]:
            left_g, left_h = left_g + held[feature][b][0] / SCALE, left_h + held[feature][b][1] / SCALE
            gain = left_g ** 2 / (left_h + boosting.ridge) + (g - left_g) ** 2 / (h - left_h + boosting.ridge) \
                - g * g / (h + boosting.ridge)
            if gain > best + 1e-9:
                best, cut = gain, (feature, b)
    return value, cut


def _grown(tree: Tree, cuts: dict[str, tuple[float, tuple[str, int] | None]], last: bool, rate: float, path: str = "") -> Tree:
    if isinstance(tree, tuple):
        feature, cut, left, right = tree
        return feature, cut, _grown(left, cuts, last, rate, path + "l"), _grown(right, cuts, last, rate, path + "r")
    value, cut = cuts.get(path, (0.0, None))
    if last or cut is None:
        return value * rate
    return cut[0], cut[1], value * rate, value * rate


def boost(rows: DataFrame, boosting: Boosting) -> list[Tree]:
    """Trees for P(block) of stored rows with y, n and the bins of FEATURES."""
    bins = {f: F.col(f"bin_{f}") for f in FEATURES}
    trees: list[Tree] = []
    for _ in range(boosting.trees):
        score = reduce(lambda a, b: a + b, [emit(t, bins) for t in trees], F.lit(0.0))
        tree: Tree = 0.0
        for level in range(boosting.depth + 1):
            held = _level(rows, score, tree, bins)
            if not held:
                return trees
            cuts = {leaf: _split(h, boosting) for leaf, h in held.items()}
            last = level == boosting.depth or all(c is None for _, c in cuts.values())
            tree = _grown(tree, cuts, last, boosting.rate)
            if last:
                break
        trees.append(tree)
    return trees


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, boosting: Boosting = Boosting()) -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row of `pages` (page_id, url).

    A null url and one without `://` have empty host and path, fit no rule and are judged by the
    trees. Without labels, or with one kind only, the score is that kind's rate and the verdict
    `allow` below 0.5. Repeated rows are judged each for itself; no pages give no rows.
    """
    described_ = described(pages, rules, boosting)
    if described_.where("judged IS NOT NULL").isEmpty():
        return described_.select("page_id", "host", "path", "rule", F.lit(ALLOW).alias("verdict"), F.lit(0.5).alias("score"))
    rows = with_suffix_rate(described_, boosting).select(
        "page_id", "host", "path", "rule", "judged", *(F.expr(e).alias(f) for f, e in FEATURES.items()))
    labelled = rows.where("judged IS NOT NULL")
    steps = [(k + 1) / boosting.bins for k in range(boosting.bins - 1)]
    cuts = {f: sorted(set(q)) for f, q in zip(FEATURES, labelled.approxQuantile(list(FEATURES), steps, 0.01))}
    bins = {f: _bin(f, cuts[f]) for f in FEATURES}
    summed = stored(labelled.select(
        (F.col("judged") == BLOCK).cast("double").alias("y"), *(bins[f].alias(f"bin_{f}") for f in FEATURES)).groupBy(
        "y", *(f"bin_{f}" for f in FEATURES)).agg(F.count("y").alias("n")), "url-bins")
    score = reduce(lambda a, b: a + b, [emit(t, {f: F.col(f"bin_{f}") for f in FEATURES}) for t in boost(summed, boosting)], F.lit(0.0))
    binned = rows.select("*", *(bins[f].alias(f"bin_{f}") for f in FEATURES)).withColumn("score", 1 / (1 + F.exp(-score)))
    return binned.select("page_id", "host", "path", "rule", F.coalesce(
        F.col("judged"), F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "score")


def _bin(feature: str, cuts: list[float]) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(feature) > c))
