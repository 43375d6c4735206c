"""URL filtering: rules first, gradient-boosted trees for the rest.

Rules allow or block hosts with their subdomains below a path; the longest
rule that fits decides. Other URLs are judged by gradient-boosted trees over
lexical features (lengths, depth, digit ratio, entropy, parameter counts,
statistics of the host's suffix), trained from labelled URLs. A share of the
sites is held out of training whole, so that the trees can be measured on
sites they have never seen.

Everything is DataFrame functions and Spark's own tree learner.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvtide.llm.common import stored

ALLOW, BLOCK = "allow", "block"
# Distinct labelled URLs of each class that training takes at most, on average (chosen by hash).
MAX_TRAINING_ROWS = 20_000
# One site of this many is held out of training.
HELD_OUT_ONE_OF = 4
# Suffix statistics are broadcast up to this many rows (about 50 bytes each).
BROADCAST_ROWS = 500_000
TREES = 16
DEPTH = 4
SEED = 7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = ("url_length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio",
            "host_digit_ratio", "hyphens", "host_entropy", "path_entropy", "params", "fragment", "secure",
            "longest_label", "extension", "vowel_ratio", "suffix_share", "suffix_hyphen_share", "suffix_length")


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; empty for a null or a URL without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """``struct<length, rule, action>`` of the longest fitting rule, or null.

    ``rules``: pairs (action, "host/path"). A rule fits its host and all
    subdomains where the URL's path starts with the rule's path. Equally
    long rules: the later one by name.
    """
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,action:string>")
    fits = []
    for action, name in rules:
        rule_host, slash, rest = name.partition("/")
        same = (host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))
        fits.append(F.when(same & F.startswith(path, F.lit(slash + rest)), F.struct(
            F.lit(len(name)).alias("length"), F.lit(name).alias("rule"), F.lit(action).alias("action"))))
    return F.array_max(F.array(*fits))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    n = F.length(text).cast("double")
    distinct = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    total = F.aggregate(distinct, F.lit(0.0), lambda a, c: F.transform(
        F.array(n - F.length(F.replace(text, c, F.lit("")))), lambda k: a + k * F.log2(k))[0])
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def with_features(pages: DataFrame) -> DataFrame:
    """``pages`` (url, host, path) with the lexical features.

    Suffix statistics are counts over all given URLs: the share of URLs
    under the host's last two labels, and the share of hyphenated hosts there.
    """
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    df = pages.withColumn("suffix", F.when(host == "", "").otherwise(
        F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".")))
    df = df.withColumns({
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "query_length": F.length(query), "depth": _count(path, "/"), "labels": F.size(labels),
        "digit_ratio": _count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)),
        "host_digit_ratio": _count(host, "0123456789") / F.greatest(F.length(host), F.lit(1)),
        "hyphens": _count(host, "-"), "host_entropy": _entropy(host), "path_entropy": _entropy(path),
        "params": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "fragment": F.contains(url, F.lit("#")).cast("int"), "secure": F.startswith(url, F.lit("https://")).cast("int"),
        "longest_label": F.array_max(F.transform(labels, F.length)),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
        "vowel_ratio": _count(host, "aeiou") / F.greatest(F.length(host), F.lit(1)),
        "suffix_length": F.length("suffix")})
    # Partial aggregation first; a suffix with most of the URLs is then one row per task.
    stats = stored(df.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("suffix_n"),
        F.avg((F.col("hyphens") > 0).cast("double")).alias("suffix_hyphen_share")), "url-suffixes")
    total = stats.agg(F.sum("suffix_n")).first()[0] or 1
    if stats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        stats = F.broadcast(stats)
    return df.join(stats, "suffix").withColumn("suffix_share", F.col("suffix_n") / F.lit(total)).drop("suffix_n")


def site_of(host: Column) -> Column:
    """The last three labels of a host, without a leading ``www``: what is
    held out together, so that no subdomain of a site betrays another."""
    labels = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")
    return F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(3)), 3), ".")


def held_out(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), site_of(host)), F.lit(HELD_OUT_ONE_OF)) == 0


def train(labelled: DataFrame) -> GBTClassificationModel | None:
    """Boosted trees from rows with the features and ``label`` (1: block).

    Learns from distinct URLs, at most about MAX_TRAINING_ROWS of each class,
    chosen by the URL's hash; a URL on a third of all rows counts once.
    Returns None if a class has no rows: nothing can be learnt.
    """
    counts = {int(r["label"]): r["n"] for r in
              labelled.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("label") == 1, F.lit(min(1.0, MAX_TRAINING_ROWS / max(counts[1], 1)))).otherwise(
        F.lit(min(1.0, MAX_TRAINING_ROWS / max(counts[0], 1))))
    chosen = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < share * F.lit(float(1 << 20)))
    # Written once: every pass of the learner reads the same rows in the same order.
    rows = stored(chosen.select("url", F.col("label").cast("double").alias("label"), *FEATURES)
                  .dropDuplicates(["url", "label"]).orderBy("url", "label"), "url-training")
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.2).fit(
        _assembled(rows).select("label", "features"))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def seed_label(host: Column, seed_words) -> Column:
    """1 (block) where a seed word is a part of the host between dots and hyphens, else 0."""
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*[F.lit(w) for w in seed_words])).cast("int")


def judge_urls(pages: DataFrame, rules, seed_words=(), id_col: str = "page_id", url_col: str = "url",
               threshold: float = 0.5, label_col: str | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score, label, held_out`` for every page.

    Labels are a column of ``pages`` (``label_col``: 1 block, 0 allow, null
    unknown), as joined from a table of labelled URLs. Without one they come
    from ``seed_words``: a host that has one of them blocks, any other that a
    rule allows allows. A URL that a rule decides never trains the other way.
    The trees learn from labelled URLs of sites that are not held out
    (``held_out``). ``verdict`` is the rule's, else ``block`` where the
    trees' probability reaches ``threshold``, else ``allow`` (always, where
    either label is missing).

    Defined cases: a null URL or one without ``://`` has empty host and path
    and is judged by the trees like any other; a null URL trains nothing;
    repeated rows are judged alike; an empty table gives an empty result;
    other columns are ignored.
    """
    url = F.col(f"`{url_col}`")
    given = F.col(f"`{label_col}`").cast("int") if label_col else F.lit(None).cast("int")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), given.alias("given"),
                        host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    label = F.col("given")
    if not label_col:
        seeded = seed_label(F.col("host"), seed_words) if seed_words else F.lit(0)
        label = F.when(seeded == 1, 1).when(F.col("fit.action") == ALLOW, 0)
    against = ((F.col("fit.action") == ALLOW) & (label == 1)) | ((F.col("fit.action") == BLOCK) & (label == 0))
    featured = with_features(rows).withColumns({
        "label": F.when(~F.coalesce(against, F.lit(False)), label), "held_out": held_out(F.col("host"))})
    model = train(featured.filter("label is not null and url is not null and not held_out"))
    if model is None:
        judged = featured.withColumn("block_score", F.lit(0.0))
    else:
        judged = model.transform(_assembled(featured)).withColumn(
            "block_score", vector_to_array("probability")[1])
    verdict = F.coalesce("fit.action", F.when(F.col("block_score") >= threshold, BLOCK).otherwise(ALLOW))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"),
                         "block_score", "label", "held_out")


def accuracy(judged: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``held_out, label, urls, sites, right`` of labelled URLs: what share of
    each class the trees alone judge as labelled, with training sites apart."""
    right = (F.col("block_score") >= threshold).cast("int") == F.col("label")
    return judged.filter("label is not null").groupBy("held_out", "label").agg(
        F.count(F.lit(1)).alias("urls"), F.countDistinct(site_of(F.col("host"))).alias("sites"),
        F.avg(right.cast("double")).alias("right"))
