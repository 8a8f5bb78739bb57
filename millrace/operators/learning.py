"""Classifiers by name over feature vectors, with held-out and leave-one-project-out evaluation (MLlib)."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegression, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from . import forest as deep
from . import vectors, words
from .boosting import Boosted
from .kernel import KernelMachine
from .perceptron import Perceptron

#: Fits that run at a time; each is a chain of jobs of its own.
PARALLEL = 4
#: How a classifier is built: (train, width of the features, rows, seed, other settings) to an estimator on label4, features and weight.
BUILDERS: dict[str, Callable[..., Estimator]] = {}


def classifier(name: str) -> Callable:
    """Registers a builder of estimators under a name, which every command and function here then knows."""

    def add(build: Callable[..., Estimator]) -> Callable[..., Estimator]:
        BUILDERS[name] = build
        return build

    return add


def together(run: Callable, items: list, most: int = PARALLEL) -> list:
    """``run`` of each item, several at a time."""
    if len(items) < 2:
        return [run(x) for x in items]
    with ThreadPool(min(most, len(items))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.getActiveSession())(run), items, 1)


@classifier("forest")
def _forest(train: DataFrame, width: int, rows: int, seed: int, trees: int = 300, depth: int = 30) -> Estimator:
    """Balanced trees. 30 is the library's greatest depth; with the rows' nodes kept, deep trees needn't be sent to the rows at each level."""
    return RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed, weightCol="weight", labelCol="label4", cacheNodeIds=True)


@classifier("logistic")
def _logistic(train: DataFrame, width: int, rows: int, seed: int) -> Estimator:
    """C = 1."""
    return LogisticRegression(regParam=1.0 / max(rows, 1), maxIter=1000, labelCol="label4", family="multinomial")


@classifier("mlp")
def _mlp(train: DataFrame, width: int, rows: int, seed: int) -> Estimator:
    """Hidden layers of 512 and 256."""
    return Perceptron(layers=[width, 512, 256, 4], maxIter=200, seed=seed)


@classifier("boosted")
def _boosted(train: DataFrame, width: int, rows: int, seed: int, rounds: int = 100) -> Estimator:
    """Boosted trees of depth 6, for each label one model against the rest."""
    return Boosted(rounds=rounds, depth=6, step=0.3)


@classifier("kernel")
def _kernel(train: DataFrame, width: int, rows: int, seed: int, size: int = 1024, rounds: int = 100) -> Estimator:
    """A support vector machine with a Gaussian kernel by random features, C = 1, for each label one against the rest. The kernel's width is 1 / (width *
    variance of all features)."""
    x = train.select(F.explode("features").alias("x")).agg(F.var_pop("x")).first()[0]
    return KernelMachine(size=size, gamma=1.0 / (max(width, 1) * (x or 1.0)), regParam=1.0 / max(rows, 1), maxIter=rounds, seed=seed)


def estimator(name: str, width: int, rows: int, train: DataFrame | None = None, seed: int = 42, **how) -> Estimator:
    """The estimator of a registered name; a kernel machine asks for the rows that it will be fitted to."""
    if name not in BUILDERS:
        raise ValueError(f"no classifier {name}; known are {sorted(BUILDERS)}")
    return BUILDERS[name](train, width, rows, seed, **how)


def balanced(train: DataFrame) -> DataFrame:
    """A weight n / (classes * n_class) for each row, so that classes count alike; the counts are a row a class."""
    counts = {r["label4"]: r["n"] for r in train.groupBy("label4").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    return train.withColumn("weight", F.coalesce(*[F.when(F.col("label4") == k, total / (len(counts) * n)) for k, n in counts.items()], F.lit(1.0)))


#: Rows that a further part of a fit is worth, where a row is much work also, and rows of a part at most.
FEW_ROWS, WORK_ROWS, PART_ROWS = 16_384, {"mlp": 2048, "kernel": 2048}, 65_536


def fit(name: str, train: DataFrame, seed: int = 42, **how) -> PipelineModel:
    """A model of vec_id, label4, features (array); rows of other labels than 0 to 3 are left out.

    Each round of a fit sends what it adds up, as large as the model, from every part, so that parts are as many as threads and not as the input's."""
    train = balanced(train.filter(F.col("label4").between(0, 3)))
    rows, width = train.agg(F.count("*"), F.max(F.size("features"))).first()
    stage = estimator(name, width or 0, rows, train, seed, **how)
    parts = max(1, min(train.sparkSession.sparkContext.defaultParallelism, -(-rows // WORK_ROWS.get(name, FEW_ROWS))), -(-rows // PART_ROWS))
    dealt = train.withColumn("features", array_to_vector("features")).repartition(parts).persist()
    try:
        return Pipeline(stages=[stage]).fit(dealt)
    finally:
        dealt.unpersist()


def save(model: PipelineModel, path: str) -> None:
    """Writes a model in the library's own format; what is at the path is replaced."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _last(model):
    return _last(model.stages[-1]) if isinstance(model, PipelineModel) else model


def apply(model: PipelineModel, rows: DataFrame, tau: float = vectors.TAU) -> DataFrame:
    """rows with probability (array of four) and predicted: class by threshold. Models of one label against the rest give margins; their
    logistic values, scaled to a sum of 1, count as probabilities. A boosted model's margin is half a log odds, a machine's is taken for one."""
    last = _last(model)
    out = model.transform(rows.withColumn("features", array_to_vector("features")).withColumn("weight", F.lit(1.0)))
    if isinstance(last, OneVsRestModel):
        slope = 2.0 if isinstance(last.models[0], GBTClassificationModel) else 1.0
        each = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-slope * x)))
        total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        p = F.transform(each, lambda x: x / F.greatest(total, F.lit(1e-12)))
    else:
        p = vector_to_array("probability")
    # a class that training lacks has no column: pad to four
    padded = F.concat(p, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), 4 - F.size(p))))
    return out.select(*[c for c in rows.columns if c != "features"], padded.alias("probability")).withColumn("predicted", vectors.threshold("probability", tau))


def predict(name: str, train: DataFrame, test: DataFrame, tau: float = vectors.TAU, **how) -> DataFrame:
    """vec_id, label4, probability (array), predicted: class by threshold. Columns: vec_id, label4, features (array). A forest that is only asked is
    never whole in one place (``forest.shares``)."""
    if name == "forest":
        train = balanced(train.filter(F.col("label4").between(0, 3))).select("vec_id", "label4", "features", "weight")
        told = deep.shares(train, test.select("vec_id", "label4", "features"), **how)
        return told.select("vec_id", "label4", "probability", vectors.threshold("probability", tau).alias("predicted"))
    return apply(fit(name, train, **how), test, tau).select("vec_id", "label4", "probability", "predicted")


#: Of several classifiers those of most rounds begin first, since their fits are long chains of small jobs.
LONGEST = ("kernel", "mlp", "boosted", "logistic")
METRICS = "tp long, fp long, fn long, precision double, recall double, f1 double"


def compare(train: DataFrame, test: DataFrame, names=None, **how) -> DataFrame:
    """Metrics of several classifiers, all if none is named, on one split, best f1 first; the features are computed once, all are fitted at a time."""
    train, test = train.persist(), test.persist()
    try:
        train.count()

        def one(name: str) -> tuple:
            return (*vectors.detection_metrics(predict(name, train, test, **how), "label4", "predicted").first(), name)

        names = sorted(names or BUILDERS, key=lambda x: LONGEST.index(x) if x in LONGEST else len(LONGEST))
        rows = together(one, names, len(names))
    finally:
        train.unpersist()
        test.unpersist()
    return train.sparkSession.createDataFrame(rows, f"{METRICS}, classifier string").orderBy(F.coalesce("f1", F.lit(0.0)).desc(), "classifier")


#: Rows that one task learns word vectors from; more rows are learnt from in more parts at a time. Beyond the second number counts of pairs are learnt from.
WORD_ROWS, COUNTED_ROWS = 20_000, 60_000


def word_vectors(code: DataFrame, size: int = 200, rounds: int = 40, parts: int = 1, seed: int = 42, tokens: str = "tokens") -> DataFrame:
    """code with features: the mean of its words' vectors, learnt by skip-gram from the rows that ``in_train`` names. Rows without words, or
    without known ones, have zeros. The rows are learnt from in ``parts`` at a time, or in as many as keep a part within ``WORD_ROWS``; more of
    them are faster and less exact. All rows are learnt from in each round. Of more than ``COUNTED_ROWS`` the pairs of all rows are counted, which
    is all that the likelihood asks of them, and a round goes over the different pairs (``words.learn``)."""
    said = code.filter("in_train").select(tokens)
    n = said.count()
    if n > COUNTED_ROWS:
        equal = said.groupBy(tokens).agg(F.count("*").alias("n")).persist()
        try:
            known, vectors_ = words.learn(equal, size, rounds, seed=seed, tokens=tokens)
        finally:
            equal.unpersist()
        return words.means(code, known, vectors_, tokens)
    parts = max(parts, -(-n // WORD_ROWS))
    learner = Word2Vec(vectorSize=size, windowSize=5, minCount=1, maxIter=rounds, numPartitions=parts, seed=seed, inputCol=tokens, outputCol="_v")
    model = learner.fit(said)
    return model.transform(code).withColumn("features", vector_to_array("_v")).drop("_v")


def leave_one_out(vecs: DataFrame, k: int = vectors.K) -> DataFrame:
    """Retrieval alone, all folds in one plan: each vector votes among neighbours of other projects; metrics by project."""
    near = vectors.top_k(vecs, vecs, k, apart=True)
    votes = vectors.majority(near, "vec_id", "neighbour_label", "rank")
    return vectors.detection_metrics(vecs.join(votes, "vec_id"), "label4", "predicted", ["project"])


def leave_one_project_out(vecs: DataFrame, name: str = "forest", k: int = vectors.K, tau: float = vectors.TAU, **how) -> DataFrame:
    """project, metrics, macro_auc, n_train, n_test: for each project a model of the others, whose neighbours are
    among the others too. The neighbours in each project are found once, lie beside their vector and serve all folds, which shuffle nothing
    for them; several folds are fitted at a time, and what comes back is a row for each."""
    vecs = vecs.persist()
    sizes = {r["project"]: r["n"] for r in vecs.groupBy("project").agg(F.count("*").alias("n")).collect()}  # a row for each project
    beside = vecs.join(vectors.near_lists(vectors.top_k(vecs, vecs, k, by_project=True)), "vec_id", "left")
    beside = vectors.few_parts(beside.withColumn("near", F.coalesce("near", F.array())), sum(sizes.values())).persist()
    try:
        beside.count()

        def fold(project: int) -> tuple:
            other = F.filter("near", lambda x: x["p_"] != project)
            rows = beside.select("vec_id", "label4", "project", "in_train", F.concat("embedding", vectors.list_features(other, k)).alias("features")).persist()
            try:
                told = predict(name, rows.filter(F.col("project") != project), rows.filter(F.col("project") == project), tau, **how)
                done = vectors.few_parts(told, sizes[project]).persist()
                long = done.select(F.col("label4").alias("label"), F.posexplode("probability").alias("klass", "score"))
                auc = stats.macro_auc(long).first()["macro_auc"]
                m = vectors.detection_metrics(done, "label4", "predicted").first()
                done.unpersist()
            finally:
                rows.unpersist()
            return (project, *m, auc, sum(sizes.values()) - sizes[project], sizes[project])

        found = together(fold, sorted(sizes))
    finally:
        beside.unpersist()
        vecs.unpersist()
    return vecs.sparkSession.createDataFrame(found, f"project int, {METRICS}, macro_auc double, n_train long, n_test long")


def average(folds: DataFrame) -> DataFrame:
    """One row: mean f1 and mean area under the curve (folds without one aside) to three decimals, and the bootstrap interval of the first."""
    folds = folds.select("project", "f1", "macro_auc")
    ci = vectors.bootstrap_mean(folds.withColumn("ordinal", F.row_number().over(W.orderBy("project")) - 1), "f1", "ordinal")
    return folds.agg(F.round(F.avg("f1"), 3).alias("f1"), F.round(F.avg("macro_auc"), 3).alias("auc")).join(ci.select(F.round("lo", 3).alias("f1_lo"), F.round("hi", 3).alias("f1_hi")))
