"""Quality classifier: evidence of the text, fused with what hierarchical empirical Bayes makes of the
document's host and path.

A logistic regression over a text's shape and words gives each document a log Bayes factor. Hosts
and paths have a share of good documents; a host's is shrunk towards the corpus's, a path's towards
its host's, the more the fewer documents it has. Both strengths are estimated from the spread between
groups. A document's posterior adds its evidence to the log odds of its path, the document itself
left out.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, spread_join, staged, text_key
from .ngrams import let

#: Labelled documents that the text model is fitted on, at most.
TRAINING_ROWS = 20_000
#: Words that the text model knows, at most, and documents of the sample that a word must be in.
VOCABULARY, MIN_DOCS = 20_000, 8
THRESHOLD = 0.5
#: Log Bayes factors beyond this are cut: no text outweighs everything.
MOST = 20.0
#: Shrinkage is worth between this many documents.
LEAST_SHRINK, MOST_SHRINK = 1.0, 1e6


def shape(text: Column) -> Column:
    """Twelve numbers of a text that don't depend on its language."""
    n = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")

    def of(w: Column) -> Column:
        size = F.greatest(F.size(w), F.lit(1)).cast("double")
        chars = F.greatest(F.length(text), F.lit(1)).cast("double")
        again = F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1))) / size
        return F.array(
            F.log1p(F.size(w).cast("double")),
            chars / size,
            n(r"[#*$%&<>]") / size,
            n(r"[|]") / size,
            n(r"[!]") / size,
            n(r"[.,]") / size,
            n(r"[0-9]") / chars,
            n(r"[A-Z]") / chars,
            n(r"\n") / size,
            again,
            F.when(again > 0.2, 1.0).otherwise(0.0),
            F.when(n(r"[!#*$%&|<>]") > 0.2 * size, 1.0).otherwise(0.0),
        )

    return let(F.filter(F.split(text, SPACE), lambda x: x != ""), of)


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {"shape": array_to_vector(shape(text)), "terms": F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))}
    )


class TextModel:
    """Vocabulary and logistic regression of the text evidence."""

    def __init__(self, docs: DataFrame, labels: DataFrame) -> None:
        good = F.max(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1.0).otherwise(0.0))
        known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(good.alias("label"))
        key = F.md5(F.col("doc_id").cast("string").cast("binary"))
        known = known.orderBy(key, "doc_id").limit(TRAINING_ROWS).select(F.col("doc_id").alias("_id"), "label")
        rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
        rows = staged(_measured(rows).select("label", "shape", "terms"), "labelled")
        n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        self.model: LogisticRegressionModel | None = None
        if 0 < positive < n:
            self.words: CountVectorizerModel = CountVectorizer(
                inputCol="terms", outputCol="counts", vocabSize=VOCABULARY, minDF=min(MIN_DOCS, max(1, n // 20)), binary=True
            ).fit(rows)
            self.prior = float(positive) / float(n)
            fit = LogisticRegression(maxIter=60, regParam=0.002, elasticNetParam=0.5, featuresCol="features", labelCol="label")
            self.model = fit.fit(self._features(rows).select("features", "label"))

    def _features(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=["shape", "counts"], outputCol="features").transform(self.words.transform(rows))

    def evidence(self, docs: DataFrame) -> DataFrame:
        """docs with evidence: the log odds of the text less those of the training sample."""
        if self.model is None:  # labels of one kind say nothing
            return docs.withColumn("evidence", F.lit(0.0))
        scored = self.model.transform(self._features(_measured(docs)))
        odds = vector_to_array("rawPrediction")[1] - F.lit(float(_logit(self.prior)))
        return scored.select(*docs.columns, F.greatest(F.least(odds, F.lit(MOST)), F.lit(-MOST)).alias("evidence"))


def _logit(p: float) -> float:
    return math.log(p) - math.log1p(-p)


def shrinkage(groups: DataFrame) -> float:
    """Worth, in documents, of the prior of groups (n, s, parent): by the method of moments, how far
    groups' shares spread about their parents' beyond what their sizes explain."""
    p = F.least(F.greatest(F.col("parent"), F.lit(1e-6)), F.lit(1 - 1e-6))
    spread, noise, scale = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - p, 2)), F.sum(p * (1 - p)), F.sum(F.col("n") * p * (1 - p))
    ).first()
    if scale is None or spread <= noise or scale <= noise:
        return MOST_SHRINK
    return min(max((scale - noise) / (spread - noise) - 1, LEAST_SHRINK), MOST_SHRINK)


def shrunk(groups: DataFrame, name: str) -> tuple[DataFrame, float]:
    """groups with their posterior share, and what their prior is worth."""
    worth = shrinkage(groups)
    return groups.withColumn(name, (F.col("s") + F.lit(worth) * F.col("parent")) / (F.col("n") + F.lit(worth))), worth


def site_priors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, n, s, parent) of each path: its documents, the sum of their probabilities and its
    host's posterior share; and what that is worth. A hot host or path is pre-aggregated."""
    paths = staged(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    hosts, _ = shrunk(hosts.withColumn("parent", F.lit(0.5 if whole is None else float(whole))), "share")
    hosts = hosts.select(F.col("host").alias("_h"), F.col("share").alias("parent"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    return paths, shrinkage(paths)


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, text_key, host, path, evidence, prior, probability, kept) of each row of docs.

    A document is good with quality 1 and without toxic 1. A NULL text counts as empty; a NULL host
    or path is a site of its own; a NULL doc_id is judged but never labelled; a repeated row is judged
    like the first and counts for its site again; with labels of one kind only, or none, evidence is 0
    and everything is kept at the prior 0.5 or more; a very long text is read whole; no rows give none;
    other columns are ignored, whatever their names. Rows meet their site in a join that deals hot ones
    over salts.
    """
    model = TextModel(docs, labels)
    rows = docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path"))
    scored = model.evidence(rows).select("doc_id", text_key(F.col("text")).alias("text_key"), "host", "path", "evidence")
    base = _logit(model.prior) if model.model is not None else 0.0
    site = F.to_json(F.struct("host", "path")).alias("_site")  # names what is there, so NULL and empty differ
    scored = staged(scored.select("*", (1 / (1 + F.exp(-(F.col("evidence") + F.lit(base))))).alias("p"), site), "evidence")
    priors, worth = site_priors(scored)
    joined = spread_join(scored, priors.select(site, "n", "s", "parent"), "_site")
    prior = (F.col("s") - F.col("p") + F.lit(worth) * F.col("parent")) / (F.col("n") - 1 + F.lit(worth))
    prior = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = joined.withColumn("prior", prior).withColumn(
        "probability", 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("prior")) - F.log1p(-F.col("prior")))))
    )
    return joined.select(
        "doc_id", "text_key", "host", "path", "evidence", "prior", "probability", (F.col("probability") >= THRESHOLD).alias("kept")
    )
