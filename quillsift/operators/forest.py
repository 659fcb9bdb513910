"""Classification on features: 15 pattern features, 9 motif features, and an embedding, by a random forest."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions import embed, motifs, patterns
from quillsift.functions.binding import let, settle
from quillsift.functions.normalize import normalize
from quillsift.operators import metrics, spans, windowing
from quillsift.operators.detector import DetectionMethod, Heuristic, register_method
from quillsift.sources import fixed
from quillsift.sources.config import Bank

#: Positions of the categories that older models do not know, which are left out for them.
NEWER = tuple(k for k, c in enumerate(fixed.PATTERNS) if c not in fixed.WEIGHTS)


def features(text: Column, bank: Bank) -> Column:
    """24 features of a normalized text, without embedding."""
    default = Bank.default()
    found = motifs.matches(text, default)
    return F.concat(patterns.feature_array(text, bank), motifs.features(text, found, fixed.MOTIF_CATEGORIES))


def adapted(values: Column, given: int, wanted: int) -> Column:
    """``values`` of length ``given`` for a model of ``wanted`` features; ValueError if that cannot be."""
    if given == wanted:
        return values
    if given - wanted == len(NEWER):
        return F.filter(values, lambda x, k: ~k.isin(list(NEWER)))
    raise ValueError(f"The model has {wanted} features, the input {given}")


def training_table(df: DataFrame, text: str, label: str, bank: Bank, embedder: embed.Embedder | None = None) -> DataFrame:
    """(features, label, weight): both classes weigh the same in sum. Null texts and labels are left out."""
    rows = df.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(normalize(F.col(text)).alias("t"), F.col(label).cast("double").alias("label"))
    values = features(F.col("t"), bank)
    if embedder:
        values = F.concat(values, embed.embed_parts(embed.chunks(F.col("t")), embedder, True).cast("array<double>"))
    made = rows.select(array_to_vector(values).alias("features"), "label")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two classes
    total, weight = sum(counts.values()), F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col("label") == value, total / (len(counts) * n)).otherwise(weight)
    return made.withColumn("weight", weight)


def train(table: DataFrame, trees: int = 100, depth: int = 20, least: int = 2, folds: int = 0, seed: int = 42) -> RandomForestClassificationModel:
    """A forest; with ``folds`` the depth is chosen from two by cross-validation."""
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed)
    if not folds:
        return forest.fit(table)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, sorted({depth, max(1, depth // 2)})).build()
    return CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed).fit(table).bestModel


def trained_with_report(table: DataFrame, share: float = 0.2, threshold: float = 0.5, seed: int = 42, **options) -> tuple[RandomForestClassificationModel, DataFrame]:
    """A forest fitted without a random ``share`` of the table, and its metrics over that share (one row)."""
    fitted, held = table.randomSplit([1 - share, share], seed)
    model = train(fitted, seed=seed, **options)
    scored = model.transform(held).select("label", vector_to_array(F.col(model.getProbabilityCol()))[1].alias("score"))
    return model, metrics.benchmark(scored, threshold)


def probability(df: DataFrame, values: str, model: RandomForestClassificationModel, out: str = "score") -> DataFrame:
    """``df`` with the probability of class 1 from the feature array ``values``."""
    scored = model.transform(df.withColumn(model.getFeaturesCol(), array_to_vector(values)))
    return scored.withColumn(out, vector_to_array(F.col(model.getProbabilityCol()))[1]).drop(model.getFeaturesCol(), model.getProbabilityCol(), model.getRawPredictionCol(), model.getPredictionCol())


def regions(text: Column, found: Column, size: int = 512, gap: int = 256, least: int = 20) -> Column:
    """Texts around the centres of merged spans (joined if closer than ``gap``); the head of the text where there are none."""
    n = F.length(text)
    around = F.transform(found, lambda s: F.struct(F.greatest(F.lit(0), F.floor((s["start"] + s["end"]) / 2).cast("int") - size // 2).alias("start"), F.least(n, F.floor((s["start"] + s["end"]) / 2).cast("int") + size // 2).alias("end")))

    near = lambda last, w: w["start"] - last["end"] < gap
    merged = spans.joined(around, near, lambda last, w: F.struct(last["start"].alias("start"), w["end"].alias("end")), "struct<start:int,end:int>")
    texts = F.transform(F.filter(merged, lambda r: r["end"] - r["start"] > least), lambda r: F.substring(text, r["start"] + 1, r["end"] - r["start"]))
    long = F.when(F.size(texts) > 0, texts).otherwise(F.array(F.substring(text, F.lit(1), F.lit(1024))))
    return F.when((F.size(found) > 0) & (n > 1024), long).otherwise(F.array(F.substring(text, F.lit(1), F.lit(2048))))


def embedded_parts(text: Column, normalized: Column, found: Column) -> Column:
    """What is embedded: regions around the spans ``found``, or else the motif hotspots of texts of more than 4096 characters, or the head."""
    around = (F.size(found) > 0) & (F.length(normalized) > 1024)
    hot = F.when(~around & (F.length(text) > 4096), windowing.hot_regions(normalized, Bank.default()))
    texts = F.transform(hot, lambda r: F.substring(normalized, r["start"] + 1, r["end"] - r["start"]))
    return let(texts, lambda t: F.when(F.coalesce(F.size(t), F.lit(0)) > 0, t).otherwise(regions(normalized, found)))


@register_method("forest")
class ForestMethod(DetectionMethod):
    """The heuristic with a forest over patterns, motifs and the embeddings of suspicious regions as its score."""

    mode = "ml"

    def __init__(self, model: RandomForestClassificationModel | None = None, embedder: embed.Embedder | None = None, **options) -> None:
        if model is None:
            raise ValueError("The forest needs a trained model; see quillsift.operators.forest.train")
        self.model, self.embedder, self.base = model, embedder, Heuristic(**options)
        self.bank = self.base.bank

    def transform(self, df: DataFrame, text: str, normalized: str, include_matches: bool = False, least: float = 0.0) -> DataFrame:
        base = self.base.transform(df, text, normalized, include_matches)
        values, given = features(F.col(normalized), self.bank), 24
        if self.embedder:
            base = base.withColumn("__patterns", patterns.categorized_spans(self.bank)(F.col(normalized)))
            base = settle(base, {"__around": spans.merge(F.col("__patterns"))})
            base = settle(base, {"__parts": F.when(F.col(normalized).isNotNull(), embedded_parts(F.col(text), F.col(normalized), F.col("__around")))})
            values, given = F.concat(values, embed.embed_parts(F.col("__parts"), self.embedder).cast("array<double>")), given + embed.DIMENSION
        values = F.when(F.col(normalized).isNotNull(), adapted(values, given, self.model.numFeatures)).otherwise(F.array_repeat(F.lit(0.0), self.model.numFeatures))
        scored = probability(base.withColumnRenamed("score", "__base").withColumn("__values", values), "__values", self.model)
        return scored.withColumn("score", F.when((F.size("matched_spans") == 0) & (F.col("__base") < 0.1), F.col("__base")).otherwise(F.col("score"))).drop("__base", "__values", "__patterns", "__around", "__parts")
