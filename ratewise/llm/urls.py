"""URL filter: fixed rules first, then gradient-boosted trees on lexical features.

The trees are fitted on different labelled URLs (the ``sample`` smallest hashes, the one bound here)
and then written as a column expression. Suffix statistics count all labelled rows; a training row
gets those without its own fold of the URLs, so that a suffix does not vouch for itself. Few suffixes
are broadcast, so judging a table is a scan; many are joined by shuffle.

Cases: a null URL, or one without ``://``, has empty host and path, follows no rule and is judged by
the trees on the features of an empty URL; repeated URLs are judged alike; without labelled URLs of
both kinds the verdict is the only kind there is, or allow. Columns pass through ``keep``; one with
the name of an output column gets ``_source`` behind it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .names import columns, renamed

SAMPLE = 20_000
TREES, DEPTH = 12, 4
FOLDS = 8
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "params",
    "query_length", "entropy", "suffix_seen", "suffix_blocked",
]


@dataclass(frozen=True)
class Rule:
    """``rule`` is host and path prefix, such as ``example.net/en/``."""

    verdict: str
    rule: str

    @property
    def parts(self) -> tuple[str, str]:
        host, slash, path = self.rule.partition("/")
        return host, slash + path


RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lowered; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        of, start = r.parts
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, F.lit(r.rule)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def suffix_of(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def lexical(rows: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, suffix key and the features that need nothing but the URL itself."""
    text, query = F.coalesce(F.col(url), F.lit("")), F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\?([^#]*)", 1)
    size = F.length(text)
    drop = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    share = lambda c: (size - F.length(F.replace(text, c))) / size
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return rows.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumns({
        "suffix_key": F.xxhash64(suffix_of(F.col("host"))),
        "url_length": size.cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": drop(F.col("path"), "/").cast("double"),
        "labels": drop(F.col("host"), r"\.").cast("double"),
        "digit_ratio": F.when(size > 0, drop(text, "[0-9]") / size).otherwise(0.0),
        "hyphens": drop(F.col("host"), "-").cast("double"),
        "params": F.when(query == "", 0).otherwise(drop(query, "&") + 1).cast("double"),
        "query_length": F.length(query).cast("double"),
        "entropy": F.when(size > 0, bits).otherwise(0.0),
    })


@dataclass
class Model:
    """Trees as an expression, and suffix statistics.

    ``suffixes`` has those of the training rows, without their fold; ``counts`` those of all labelled
    rows, by which URLs are judged.
    """

    suffixes: DataFrame
    prior: float
    trees: list
    weights: list
    counts: DataFrame | None = None

    def with_suffix(self, rows: DataFrame, stats: DataFrame | None = None, on: tuple[str, ...] = ("suffix_key",)) -> DataFrame:
        stats = self.counts if stats is None else stats
        seen, blocked = F.coalesce("_seen", F.lit(0)), F.coalesce("_blocked", F.lit(0))
        return rows.join(broadcast_if_small(stats, stats.count(), 32), list(on), "left").withColumns({
            "suffix_seen": F.log1p(seen), "suffix_blocked": (blocked + 5 * self.prior) / (seen + 5)
        }).drop("_seen", "_blocked")

    def score(self) -> Column:
        """Above 0: block."""
        if not self.trees:
            return F.lit(1.0 if self.prior > 0.5 else -1.0)
        return reduce(Column.__add__, [as_column(t) * w for t, w in zip(self.trees, self.weights)])


def as_column(node) -> Column:
    """A fitted tree as nested conditions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    low = F.col(FEATURES[split.featureIndex()]) <= float(split.threshold())
    return F.when(low, as_column(node.leftChild())).otherwise(as_column(node.rightChild()))


def fit(labelled: DataFrame, url: str = "url", label: str = "blocked", sample: int = SAMPLE, seed: int = 7) -> Model:
    """Fit on labelled URLs (``label``: boolean); the trees on the ``sample`` different ones of smallest hash."""
    known = labelled.filter(F.col(label).isNotNull()).select(url, F.col(label).alias(label))
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(url)), F.lit(FOLDS)).alias("_fold")
    each = known.select(F.xxhash64(suffix_of(host_of(F.col(url)))).alias("suffix_key"), fold, F.col(label).cast("long").alias("_bad"))
    by_fold = cut_lineage(each.groupBy("suffix_key", "_fold").agg(F.count(F.lit(1)).alias("_n"), F.sum("_bad").alias("_b")))
    counts = cut_lineage(by_fold.groupBy("suffix_key").agg(F.sum("_n").alias("_seen"), F.sum("_b").alias("_blocked")))
    count, bad = counts.agg(F.sum("_seen"), F.sum("_blocked")).first()
    prior = bad / count if count else 0.0
    rows = cut_lineage(lexical(training(known, url, label, sample, seed).withColumn("_fold", fold), url))
    keys = rows.select("suffix_key", "_fold").distinct()
    less = by_fold.join(F.broadcast(keys), ["suffix_key", "_fold"], "left_semi")
    some = keys.join(less, ["suffix_key", "_fold"]).join(counts, "suffix_key")
    suffixes = cut_lineage(some.select("suffix_key", "_fold", (F.col("_seen") - F.col("_n")).alias("_seen"), (F.col("_blocked") - F.col("_b")).alias("_blocked")))
    model = Model(suffixes, prior, [], [], counts)
    if 0 < prior < 1:
        train = model.with_suffix(rows, suffixes, ("suffix_key", "_fold")).select(*FEATURES, F.col(label).cast("double").alias("label"))
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train).select("features", "label")
        if vectors.select("label").distinct().count() == 2:
            fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, cacheNodeIds=False).fit(vectors)
            model.trees, model.weights = [t._java_obj.rootNode() for t in fitted.trees], list(fitted.treeWeights)
    return model


def training(known: DataFrame, url: str, label: str, sample: int, seed: int) -> DataFrame:
    """The ``sample`` different labelled URLs of smallest hash; one with both labels is a row of each.

    Hashes above a share that leaves too many are dropped before the sort, which then is small."""
    different = known.distinct()
    total, hashed = different.count(), F.xxhash64(F.lit(seed), F.col(url))
    if total <= sample:
        return different
    share = min(1.0, (sample + 10 * sample**0.5) / total)
    few = different.filter(F.pmod(hashed, F.lit(1 << 40)) < int((1 << 40) * share))
    return few.orderBy(F.pmod(hashed, F.lit(1 << 40)), url, label).limit(sample)


def judge(pages: DataFrame, model: Model, rules: list[Rule], keep: list[str], url: str = "url") -> DataFrame:
    """``keep`` columns with ``host, path, rule, verdict``."""
    names = renamed(keep, ["host", "path", "rule", "verdict"])
    packed = F.struct(*(c.alias(n) for c, n in zip(columns(pages, keep), names))) if keep else F.struct(F.lit(1))
    rows = model.with_suffix(lexical(pages.select(packed.alias("_kept"), F.col(url).alias("url"))))
    name, said = match_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("_score") > 0, "block").otherwise("allow")
    return rows.withColumn("_score", model.score()).select(
        *(F.col("_kept").getField(n).alias(n) for n in names), "host", "path", name.alias("rule"), F.coalesce(said, method).alias("verdict")
    )


def label_by_rules(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``url, blocked``: the URLs that a rule decides, as training labels."""
    _, said = match_rule(host_of(F.col(url)), path_of(F.col(url)), rules)
    return pages.select(url, (said == "block").alias("blocked")).filter("blocked is not null")
