"""Verdicts on URLs: rules first, gradient-boosted trees on lexical features for the rest.

Everything runs as DataFrame expressions.  A URL's features (length, depth of its path, share of digits, entropy of its
characters, number of parameters, and how often labelled URLs of the same host suffix and path suffix are to be blocked)
fall into bins of a fixed number.  Labelled URLs with equal bins are merged into one row with counts, so training works
on far fewer rows than there are URLs, and partial sums are made before every shuffle.  A level of a tree is one grouped
sum of gradients and curvatures by (node, feature, bin), a table of fixed size, from which the driver takes the best
splits.  Gradients, curvatures, leaves and scores are whole numbers of fixed point, so sums have the same
result in any order, and the same trees come out at any number of partitions.  Trees are applied as one expression.

Defined cases: a null URL, or one without `://`, has an empty host and path and is judged by its features; texts are read
whole, however long (characters beyond ASCII are one character to the entropy, so its work is linear).  Repeated rows count as often as they stand.
Labels other than 0 and 1, null labels and null URLs are not learned from; without any label all is allowed.  Of rules of equal length the one with the
longer host wins.  An empty table gives no rows; columns of the result that the table has already are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import ascii_lower, cut_lineage, free_name

ALLOW, BLOCK = "allow", "block"
#: Fixed point of probabilities and of scores.
ONE, UNIT = 1 << 20, 1 << 16
#: Labelled URLs that the overall share weighs as much as, in the share of a suffix.
PRIOR = 10
#: Bytes of suffix counts up to which they are broadcast; beyond it, they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


@dataclass(frozen=True)
class Rule:
    """Holds for a host and all its subdomains where the path begins with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Trees:
    """Boosted trees: of each, the splits (feature, last bin that goes left) by node and the leaves' values by node; node k has the children 2k and 2k + 1."""

    start: int
    splits: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    leaves: list[dict[int, int]] = field(default_factory=list)

    def score(self, bins: Column) -> Column:
        """Log-odds of a block, in units of 1 / UNIT."""

        def below(tree: int, node: int) -> Column:
            if node in self.leaves[tree]:
                return F.lit(self.leaves[tree][node])
            feature, last = self.splits[tree][node]
            return F.when(F.get(bins, F.lit(feature)) <= last, below(tree, 2 * node)).otherwise(below(tree, 2 * node + 1))

        return reduce(lambda a, b: a + b, [below(t, 1) for t in range(len(self.leaves))], F.lit(self.start)).cast("long")


def host_of(url: Column) -> Column:
    """What is between the first :// and the next /, ? or #, with A-Z in lower case; empty without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What is between the host and the next ? or #."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; the rules become one expression, so they are meant to be some hundreds at most."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    fits = [((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)) for r in ordered]
    return F.coalesce(*[F.when(f, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for f, r in zip(fits, ordered, strict=True)])


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits, those beyond ASCII taken as one."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", "ÿ")
    size = F.length(plain)

    def of(s: Column) -> Column:
        times = F.transform(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")), lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"))
        return F.aggregate(times, F.lit(0.0), lambda total, n: total + n * F.log2(n))

    # the text stands once in an array, so that it is not worked out again for every character
    summed = F.get(F.transform(F.array(plain), of), 0)
    return F.when(size > 0, F.log2(size.cast("double")) - summed / size).otherwise(F.lit(0.0))


def _bin(value: Column, most: int = 63) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), F.floor(value).cast("int")))


FEATURES = ("length", "depth", "digits", "entropy", "parameters", "top_share", "top_count", "site_share", "site_count", "ending_share")
_SUFFIXES = ("top", "site", "ending")


def _with_parts(urls: DataFrame, url_col: str) -> DataFrame:
    """urls with _host, _path, _own (bins of what the URL alone tells) and the suffixes of the host and the path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = urls.withColumns({"_host": host_of(url), "_path": path_of(url)})
    size = F.length(url)
    digits = size - F.length(F.translate(url, "0123456789", ""))
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    own = [
        _bin(F.log2(size + 1.0) * 4),
        _bin(F.size(F.filter(F.split("_path", "/"), lambda s: s != ""))),
        _bin(F.when(size > 0, 32 * digits / size).otherwise(0.0)),
        _bin(8 * entropy(url)),
        _bin(F.size(F.filter(F.split(asked, "&"), lambda s: s != ""))),
    ]
    labels = F.substring_index("_host", ".", -1), F.substring_index("_host", ".", -2)
    ending = F.when(F.endswith("_path", F.lit("/")), "/").otherwise(F.regexp_extract("_path", r"\.[A-Za-z0-9]{1,8}$", 0))
    return rows.withColumns({"_own": F.array(*own), "_top": labels[0], "_site": labels[1], "_ending": ending})


def _suffix_counts(parts: DataFrame) -> DataFrame:
    """(kind, suffix, n, blocked) over labelled rows."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("suffix")) for k in _SUFFIXES]))
    return cut_lineage(parts.select(each.alias("e"), "_label").groupBy("e.kind", "e.suffix").agg(F.count("*").alias("n"), F.sum("_label").alias("blocked")))


def _with_bins(parts: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    size = counts.agg(F.coalesce(F.sum(F.octet_length("suffix") + 48), F.lit(0))).first()[0]
    for kind in _SUFFIXES:
        own = counts.filter(F.col("kind") == kind).select(F.col("suffix").alias(f"_{kind}"), F.col("n").alias(f"_{kind}_n"), F.col("blocked").alias(f"_{kind}_blocked"))
        parts = parts.join(F.broadcast(own) if size <= BROADCAST_BYTES else own, f"_{kind}", "left")
    seen = lambda kind: F.coalesce(f"_{kind}_n", F.lit(0))
    shares = {k: _bin(32 * (F.coalesce(f"_{k}_blocked", F.lit(0)) + PRIOR * share) / (seen(k) + PRIOR)) for k in _SUFFIXES}
    more = [shares["top"], _bin(F.log2(seen("top") + 1.0)), shares["site"], _bin(F.log2(seen("site") + 1.0)), shares["ending"]]
    return parts.withColumn("_bins", F.concat("_own", F.array(*more)))


def boosted(merged: DataFrame, trees: int, depth: int, rate: float, l2: float, least: float) -> Trees:
    """Trees from (bins, n, blocked): Newton steps on the logistic loss, each tree grown level by level."""
    total = merged.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    found = Trees(round(UNIT * math.log((total[1] + 1) / (total[0] - total[1] + 1))))
    ridge, floor = l2 * ONE, least * ONE
    for _ in range(trees if total[0] else 0):
        p = F.round(ONE / (1 + F.exp(-found.score(F.col("bins")) / UNIT))).cast("long")
        state = merged.select("bins", (F.col("n") * p - F.col("blocked") * ONE).alias("g"), F.floor(F.col("n") * p * (ONE - p) / ONE).cast("long").alias("h"))
        splits: dict[int, tuple[int, int]] = {}
        leaves: dict[int, int] = {}
        open_nodes = [1]
        for level in range(depth + 1):
            node = F.lit(1)
            for parent, (feature, last) in sorted(splits.items()):
                node = F.when(node == parent, F.when(F.get("bins", F.lit(feature)) <= last, 2 * parent).otherwise(2 * parent + 1)).otherwise(node)
            held = state.withColumn("node", node).filter(F.col("node").isin(*open_nodes))
            sums = held.select("node", "g", "h", F.posexplode("bins").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            by_node: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
            # at most (nodes of a level) x (features) x 64 rows
            for r in sums.collect():
                by_node.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["bin"], r["g"], r["h"]))
            following = []
            for k in open_nodes:
                features = by_node.get(k, {})
                g, h = (sum(x[i] for x in features.get(0, ())) for i in (1, 2))
                split = best_split(features, g, h, ridge, floor) if level < depth else None
                if split:
                    splits[k] = split
                    following += [2 * k, 2 * k + 1]
                else:
                    leaves[k] = round(-rate * UNIT * g / (h + ridge))
            open_nodes = following
            if not open_nodes:
                break
        found.splits.append(splits)
        found.leaves.append(leaves)
    return found


def best_split(features: dict[int, list[tuple[int, int, int]]], g: int, h: int, ridge: float, floor: float) -> tuple[int, int] | None:
    """The (feature, last bin to the left) with the greatest gain, of equals the first; None where none gains."""
    worth = lambda g, h: g * g / (h + ridge)
    best, most = None, worth(g, h) * (1 + 1e-9) + 1e-9
    for feature in sorted(features):
        left_g = left_h = 0
        for last, own_g, own_h in sorted(features[feature])[:-1]:
            left_g, left_h = left_g + own_g, left_h + own_h
            if left_h >= floor and h - left_h >= floor and (gain := worth(left_g, left_h) + worth(g - left_g, h - left_h)) > most:
                best, most = (feature, last), gain
    return best


@dataclass
class Filter:
    """A fitted filter: what suffixes tell, and the trees."""

    counts: DataFrame
    share: float
    trees: Trees

    def scored(self, urls: DataFrame, url_col: str = "url", score_col: str = "score") -> DataFrame:
        """urls with their host and path, and with the log-odds of a block, in units of 1 / UNIT."""
        binned = _with_bins(_with_parts(urls, url_col), self.counts, self.share)
        return binned.select(*[F.col(c) for c in urls.columns], "_host", "_path", self.trees.score(F.col("_bins")).alias(score_col))


def learn(labelled: DataFrame, url_col: str = "url", label_col: str = "label", trees: int = 12, depth: int = 3, rate: float = 0.4, l2: float = 1.0, least: float = 1.0) -> Filter:
    """A filter from URLs with label 1 (to be blocked) or 0."""
    rows = labelled.select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("int").alias("_label")).filter("url IS NOT NULL AND _label IN (0, 1)")
    parts = _with_parts(rows, "url")
    counts = _suffix_counts(parts)
    total = counts.filter("kind = 'top'").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    share = (total[1] + 1) / (total[0] + 2)
    merged = _with_bins(parts, counts, share).groupBy(F.col("_bins").alias("bins")).agg(F.count("*").alias("n"), F.sum("_label").alias("blocked"))
    return Filter(counts, share, boosted(cut_lineage(merged), trees, depth, rate, l2, least))


def verdicts(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url", **how) -> DataFrame:
    """urls with host, path, rule, verdict and p_block: the verdict is the rule's, else by whether the trees, learned from the URLs that a rule judges, give a block more than even odds."""
    base = urls.drop("host", "path", "rule", "verdict", "p_block")
    url = F.col(url_col).cast("string")
    judged = F.col(rule_col := free_name(base, "ruled"))
    with_rule = base.withColumn(rule_col, ruled(host_of(url), path_of(url), rules))
    labelled = with_rule.filter(judged.isNotNull()).select(url.alias("url"), (judged["verdict"] == BLOCK).cast("int").alias("label"))
    score = free_name(with_rule, "score")
    scored = learn(labelled, **how).scored(with_rule, url_col, score)
    told = F.when(F.col(score) > 0, BLOCK).otherwise(ALLOW)
    return scored.select(
        *base.columns, F.col("_host").alias("host"), F.col("_path").alias("path"), judged["rule"].alias("rule"), F.coalesce(judged["verdict"], told).alias("verdict"), F.round(1 / (1 + F.exp(-F.col(score) / UNIT)), 6).alias("p_block")
    )
