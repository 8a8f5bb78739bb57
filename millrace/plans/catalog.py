"""The registered queries of the engine, and DuckDB SQL for those that SQL can express.

Arrays are rendered as joined strings and doubles rounded, so that both engines give the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flow, stats
from ..functions import rules as R
from ..functions import text as T
from ..operators import extraction, fusion, learning, mining, rule_data, screening, validation, vectors
from ..sources import readers
from ..sources.readers import flat, table
from ..streaming.screen import event_windows
from . import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A synthetic view over the tables of ``sf_dir``. Parts are a few bytes each but much work, so they are spread first."""
    tables = {t: readers.spread(table(spark, sf_dir, t)) if t == "part" else table(spark, sf_dir, t) for t in ("part", "documents", "events", "lineitem") if f" {t}" in corpus.VIEWS[name]}
    text = corpus.VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **tables)


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({corpus.VIEWS[n]})" for n in names) + " "


def _join(c, sep: str = "|"):
    return F.array_join(c, sep)


# ---- vectors -------------------------------------------------------------------------------------------------------

UNIT = "('0x' || substr(sha256({0}), 1, 8))::BIGINT / 4294967296.0"
VEC = f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, (label % 4)::INT AS label4, (vec_id % 6)::INT AS project,
  {UNIT.format("'42:' || vec_id::VARCHAR")} < 0.9 AS in_train FROM embeddings)"""
NEAR = """s AS (SELECT q.vec_id, n.vec_id AS neighbour, n.label4 AS neighbour_label, list_reduce(list_transform(list_zip(q.e, n.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS sim
  FROM v q JOIN v n ON NOT q.in_train AND n.in_train),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) AS rank FROM s QUALIFY rank <= 5)"""
FEAT = """f AS (SELECT vec_id, count_if(neighbour_label = 0) / greatest(count(*), 1) AS p0, count_if(neighbour_label = 1) / greatest(count(*), 1) AS p1,
  count_if(neighbour_label = 2) / greatest(count(*), 1) AS p2, count_if(neighbour_label = 3) / greatest(count(*), 1) AS p3, avg(sim) AS mean_sim, max(sim) AS max_sim FROM k GROUP BY vec_id)"""
VOTE = """o AS (SELECT vec_id, neighbour_label AS predicted, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, min(rank)) AS rn FROM k GROUP BY vec_id, neighbour_label),
vote AS (SELECT o.vec_id, label4, predicted FROM o JOIN v USING (vec_id) WHERE rn = 1)"""
METRICS = """tp, fp, fn, round(tp / greatest(tp + fp, 1), 3) AS precision, round(tp / greatest(tp + fn, 1), 3) AS recall,
  round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-9), 3) AS f1"""
COUNTS = "count_if(label4 < 3 AND predicted = label4)::BIGINT AS tp, count_if(label4 = 3 AND predicted < 3)::BIGINT AS fp, count_if(label4 < 3 AND predicted = 3)::BIGINT AS fn"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.labelled(table(spark, sf_dir, "embeddings"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vectors.top_k(v.filter("NOT in_train"), v.filter("in_train"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = vectors.majority(_near(spark, sf_dir), "vec_id", "neighbour_label", "rank")
    return _vectors(spark, sf_dir).select("vec_id", "label4").join(votes, "vec_id")


@query(f"WITH {VEC}, {NEAR}, {FEAT} SELECT vec_id, p0, p1, p2, p3, round(mean_sim, 6) AS mean_sim, round(max_sim, 6) AS max_sim FROM f")
def knn_label_features(spark, sf_dir):
    f = vectors.retrieval_features(_near(spark, sf_dir))
    return f.select("vec_id", "p0", "p1", "p2", "p3", F.round("mean_sim", 6).alias("mean_sim"), F.round("max_sim", 6).alias("max_sim"))


@query(f"WITH {VEC}, {NEAR} SELECT vec_id, rank::INT AS rank, neighbour, round(sim, 6) AS sim FROM k")
def knn_top5(spark, sf_dir):
    return _near(spark, sf_dir).select("vec_id", "rank", "neighbour", F.round("sim", 6).alias("sim"))


@query(f"WITH {VEC}, {NEAR} SELECT vec_id, rank::INT AS rank, neighbour, round(sim, 6) AS sim FROM k")
def knn_top5_blocks(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    near = vectors.top_k(v.filter("NOT in_train"), v.filter("in_train"), block_bytes=1 << 14)  # many blocks on both sides
    return near.select("vec_id", "rank", "neighbour", F.round("sim", 6).alias("sim"))


@query(f"WITH {VEC}, {NEAR} SELECT vec_id, rank::INT AS rank, neighbour, round(sim, 6) AS sim FROM k")
def knn_top5_index(spark, sf_dir):
    """From an index with pivots; groups that can't hold a neighbour are passed over."""
    v, path = _vectors(spark, sf_dir), readers.scratch(spark, "index")
    vectors.write_index(v.filter("in_train"), path, block_bytes=1 << 14)
    near, _ = vectors.search(v.filter("NOT in_train"), path, block_bytes=1 << 14)
    return near.select("vec_id", "rank", "neighbour", F.round("sim", 6).alias("sim"))


@query(f"WITH {VEC}, {NEAR}, {VOTE} SELECT vec_id, label4, predicted FROM vote")
def knn_majority_vote(spark, sf_dir):
    return _votes(spark, sf_dir)


@query(f"WITH {VEC}, {NEAR}, {FEAT} SELECT vec_id, label4, 70::INT AS width, round(list_sum(e) + p0 + p1 + p2 + p3 + mean_sim + max_sim, 5) AS total FROM v JOIN f USING (vec_id)")
def feature_matrix(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    m = vectors.feature_vector(v.filter("NOT in_train"), vectors.retrieval_features(_near(spark, sf_dir)))
    return m.select("vec_id", "label4", F.size("features").alias("width"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"WITH {VEC}, {NEAR}, {FEAT} SELECT vec_id, CASE WHEN greatest(p0, p1, p2, p3) < 0.45 THEN 3 WHEN p0 = greatest(p0, p1, p2, p3) THEN 0 WHEN p1 = greatest(p0, p1, p2, p3) THEN 1 WHEN p2 = greatest(p0, p1, p2, p3) THEN 2 ELSE 3 END AS predicted FROM f")
def threshold_labels(spark, sf_dir):
    f = vectors.retrieval_features(_near(spark, sf_dir))
    return f.select("vec_id", vectors.threshold(F.array("p0", "p1", "p2", "p3"), 0.45).alias("predicted"))


@query(f"WITH {VEC}, {NEAR}, {VOTE}, c AS (SELECT {COUNTS} FROM vote) SELECT {METRICS} FROM c")
def detection_metrics(spark, sf_dir):
    return vectors.detection_metrics(_votes(spark, sf_dir), "label4", "predicted")


@query(f"WITH {VEC}, {NEAR}, {VOTE} SELECT l::INT AS label, count_if(label4 = l AND predicted = l)::BIGINT AS correct, count_if(label4 = l)::BIGINT AS total, round(100.0::DOUBLE * count_if(label4 = l AND predicted = l) / greatest(count_if(label4 = l), 1), 1) AS pct FROM vote, range(4) t(l) GROUP BY l")
def per_category(spark, sf_dir):
    return vectors.per_category(_votes(spark, sf_dir), "label4", "predicted")


@query(f"""WITH {VEC}, {NEAR}, {FEAT}, x AS (SELECT label4, klass, CASE klass WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS score FROM f JOIN v USING (vec_id), range(4) t(klass)),
r AS (SELECT *, rank() OVER (PARTITION BY klass ORDER BY score) + (count(*) OVER (PARTITION BY klass, score) - 1) / 2 AS rank FROM x),
g AS (SELECT klass, sum(CASE WHEN label4 = klass THEN rank END) AS s, count_if(label4 = klass)::DOUBLE AS np, count_if(label4 <> klass)::DOUBLE AS nn FROM r GROUP BY klass)
SELECT round(avg((s - np * (np + 1) / 2) / (np * nn)), 6) AS macro_auc, count(*)::BIGINT AS classes FROM g WHERE np > 0 AND nn > 0""")
def macro_auc(spark, sf_dir):
    f = vectors.retrieval_features(_near(spark, sf_dir)).join(_vectors(spark, sf_dir).select("vec_id", F.col("label4").alias("label")), "vec_id")
    long = f.select("label", F.posexplode(F.array("p0", "p1", "p2", "p3")).alias("klass", "score"))
    return stats.macro_auc(long)


LOPO = f"""WITH {VEC}, s AS (SELECT q.vec_id, n.vec_id AS neighbour, n.label4 AS neighbour_label, list_reduce(list_transform(list_zip(q.e, n.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS sim FROM v q JOIN v n ON q.project <> n.project),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) AS rank FROM s QUALIFY rank <= 5),
o AS (SELECT vec_id, neighbour_label AS predicted, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, min(rank)) AS rn FROM k GROUP BY vec_id, neighbour_label),
c AS (SELECT project, {COUNTS} FROM o JOIN v USING (vec_id) WHERE rn = 1 GROUP BY project), m AS (SELECT project, {METRICS} FROM c) """


@query(LOPO + "SELECT * FROM m")
def lopo_knn_metrics(spark, sf_dir):
    return learning.leave_one_out(_vectors(spark, sf_dir))


@query(LOPO + f""", n AS (SELECT count(*) AS n FROM m), d AS (SELECT b, f1 FROM range(1000) t(b), range((SELECT n FROM n)) u(j), n, m WHERE m.project = floor({UNIT.format("'42:' || b::VARCHAR || ':' || j::VARCHAR")} * n)),
g AS (SELECT b, avg(f1) AS x FROM d GROUP BY b) SELECT (SELECT round(avg(f1), 6) FROM m) AS mean, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi FROM g""")
def bootstrap_f1_ci(spark, sf_dir):
    return vectors.bootstrap_mean(lopo_knn_metrics(spark, sf_dir), "f1", "project")


@query(LOPO + "SELECT project, f1, row_number() OVER (ORDER BY coalesce(f1, 0) DESC, project)::INT AS place FROM m")
def results_ranked(spark, sf_dir):
    from pyspark.sql import Window as W

    return lopo_knn_metrics(spark, sf_dir).select("project", "f1", F.row_number().over(W.orderBy(F.coalesce("f1", F.lit(0.0)).desc(), "project")).alias("place"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings")
def vector_norms(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", F.round(vectors.norm("embedding"), 5).alias("norm"), F.round(vectors.norm(vectors.normalised("embedding")), 5).alias("unit_norm"))


@query("SELECT a.vec_id, (len(a.embedding) + len(b.embedding))::INT AS width, round(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE)) + list_sum(list_transform(b.embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0")
def vector_pair_concat(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    both = v.filter("vec_id % 2 = 0").join(after, "vec_id").withColumn("pair", F.concat("embedding", "e2"))
    return both.select("vec_id", F.size("pair").alias("width"), F.round(F.aggregate("pair", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"WITH {VEC} SELECT project, count_if(in_train)::BIGINT AS n_train, count_if(NOT in_train)::BIGINT AS n_test FROM v GROUP BY project")
def train_split_counts(spark, sf_dir):
    return _vectors(spark, sf_dir).groupBy("project").agg(F.count_if("in_train").alias("n_train"), F.count_if(~F.col("in_train")).alias("n_test"))


@query("SELECT vec_id, row_number() OVER (ORDER BY sha256('42:' || vec_id::VARCHAR), vec_id) <= floor(count(*) OVER () * 0.9) AS in_train FROM embeddings")
def exact_split(spark, sf_dir):
    return vectors.labelled(table(spark, sf_dir, "embeddings"), exact=True).select("vec_id", "in_train")


def _features(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir)
    near = vectors.top_k(v, v.filter("in_train"))  # a training vector finds itself, as the flag of the engine's default says
    return vectors.few_parts(vectors.feature_vector(v, vectors.retrieval_features(near)), v.count()).persist()


def _evaluate(name: str, **how) -> Query:
    def run(spark, sf_dir):
        m = _features(spark, sf_dir)
        return vectors.detection_metrics(learning.predict(name, m.filter("in_train"), m.filter("NOT in_train"), **how), "label4", "predicted")

    return run


QUERIES["forest_eval"] = _evaluate("forest")
QUERIES["logreg_eval"] = _evaluate("logistic")
QUERIES["mlp_eval"] = _evaluate("mlp")
QUERIES["boosted_eval"] = _evaluate("boosted")
QUERIES["kernel_eval"] = _evaluate("kernel")


@query()
def forest_raw_eval(spark, sf_dir):
    """A forest on the vectors alone, without retrieval."""
    v = _vectors(spark, sf_dir).withColumnRenamed("embedding", "features").persist()
    return vectors.detection_metrics(learning.predict("forest", v.filter("in_train"), v.filter("NOT in_train")), "label4", "predicted")


@query()
def classifier_comparison(spark, sf_dir):
    m = _features(spark, sf_dir)
    return learning.compare(m.filter("in_train"), m.filter("NOT in_train"))


@query()
def lopo_refit_metrics(spark, sf_dir):
    return learning.leave_one_project_out(_vectors(spark, sf_dir), "logistic")


@query()
def lopo_forest_metrics(spark, sf_dir):
    return learning.leave_one_project_out(_vectors(spark, sf_dir), "forest")


@query()
def word_vectors_eval(spark, sf_dir):
    """A forest on means of word vectors of methods; a fault is what the patterns say of them."""
    c = view(spark, sf_dir, "v_code").select(F.col("pair_key").alias("vec_id"), T.code_tokens(F.col("before_source")).alias("tokens"), fusion.baseline_label(F.col("before_source")).alias("label4"))
    c = learning.word_vectors(vectors.exact_split(c)).drop("tokens").persist()
    return vectors.detection_metrics(learning.predict("forest", c.filter("in_train"), c.filter("NOT in_train")), "label4", "predicted")


@query(f"WITH {VEC} SELECT vec_id, label4, project, in_train FROM v")
def vector_meta(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", "label4", "project", "in_train")


@query("""WITH w AS (SELECT vec_id, list_transform(range(1, 33), lambda i: (embedding[i]::DOUBLE + embedding[i + 8]::DOUBLE + embedding[i + 16]::DOUBLE + embedding[i + 24]::DOUBLE + embedding[i + 32]::DOUBLE) / 5) AS m FROM embeddings)
SELECT vec_id, len(m)::INT AS width, round(list_sum(m), 5) AS total, round(sqrt(list_sum(list_transform(m, lambda x: x * x))), 5) AS norm FROM w""")
def window_mean_pool(spark, sf_dir):
    """Windows of 32 numbers, 8 apart, and their element-wise mean."""
    v = _vectors(spark, sf_dir).select("vec_id", T.mean_of(T.windows(F.col("embedding"), 32, 8), 32).alias("m"))
    return v.select("vec_id", F.size("m").alias("width"), F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(vectors.norm("m"), 5).alias("norm"))


# ---- agreement and intervals ---------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT quality AS x, toxic AS y, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS total, sum(CASE WHEN x = y THEN n ELSE 0 END) / sum(n) AS po FROM b),
c AS (SELECT coalesce(sum(na * nb), 0) AS crossed FROM (SELECT x AS c, sum(n)::DOUBLE AS na FROM b GROUP BY x) JOIN (SELECT y AS c, sum(n)::DOUBLE AS nb FROM b GROUP BY y) USING (c))
SELECT total::BIGINT AS n, round((po - crossed / (total * total)) / greatest(1 - crossed / (total * total), 1e-9), 6) AS kappa FROM t, c""")
def kappa_annotators(spark, sf_dir):
    return stats.kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1")
def agreed_positives(spark, sf_dir):
    return table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 1").select("doc_id")


# ---- text ----------------------------------------------------------------------------------------------------------

TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}]"
NTOK = f"coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0)::INT"


@query(f"SELECT doc_id, {NTOK} AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query(f"SELECT count_if({NTOK} > 512)::BIGINT AS n_long, round(avg(({NTOK} > 512)::INT), 6) AS share FROM documents")
def long_text_share(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((T.token_count(F.col("text")) > 512).cast("int").alias("x"))
    return d.agg(F.count_if(F.col("x") == 1).alias("n_long"), F.round(F.avg("x"), 6).alias("share"))


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS tok FROM documents), w AS (SELECT doc_id, tok, unnest(range(0, ((greatest(len(tok) - 512, 0) + 127) // 128)::BIGINT + 1)) AS i FROM t)
SELECT doc_id, i::INT AS number, len(tok[i * 128 + 1:i * 128 + 512])::INT AS size, tok[i * 128 + 1] AS head FROM w""")
def token_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", F.posexplode(T.window_heads(F.col("t"))).alias("number", "w")).select("doc_id", "number", "w.size", "w.head")


LOWERED = "lower(subject || ' ' || body)"
STAGE1 = "CASE " + " ".join(f"WHEN {' OR '.join(R.sql_has(LOWERED, p, 'i') for p in ps)} THEN '{c}'" for c, ps in R.STAGE1.items()) + " END"
REJECTED = "(" + " OR ".join(R.sql_has(LOWERED, p, "i") for p in R.REJECT) + ")"


def _messages(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "v_msg").select("doc_id", "commit_hash", mining.message().alias("text"))


@query(_with("v_msg") + f"SELECT doc_id, {STAGE1} AS category FROM v_msg")
def stage1_category(spark, sf_dir):
    return _messages(spark, sf_dir).select("doc_id", mining.stage1_category(F.col("text")).alias("category"))


@query(_with("v_msg") + f"SELECT doc_id, {REJECTED} AS rejected FROM v_msg")
def stage2_reject(spark, sf_dir):
    return _messages(spark, sf_dir).select("doc_id", mining.rejected(F.col("text")).alias("rejected"))


def _plausible_sql(c: str) -> str:
    return "(" + " OR ".join(f"contains(before_source || after_source, '{w}')" for w in R.PLAUSIBLE[c]) + ")"


@query(_with("v_code") + "SELECT pair_key, " + ", ".join(f"{_plausible_sql(c)} AS {c}" for c in R.PLAUSIBLE) + " FROM v_code")
def stage2_plausible(spark, sf_dir):
    both = F.concat("before_source", "after_source")
    return view(spark, sf_dir, "v_code").select("pair_key", *[mining.plausible(both, F.lit(c)).alias(c) for c in R.PLAUSIBLE])


@query(_with("v_msg", "v_code") + f"""SELECT pair_key, category, file_path FROM (SELECT commit_hash, {STAGE1} AS category FROM v_msg WHERE NOT {REJECTED}) m JOIN v_code USING (commit_hash)
WHERE trim(before_source) <> '' AND trim(after_source) <> '' AND before_source <> after_source AND CASE category {' '.join(f"WHEN '{c}' THEN {_plausible_sql(c)}" for c in R.PLAUSIBLE)} ELSE false END""")
def mined_pairs(spark, sf_dir):
    text = F.col("text")
    m = _messages(spark, sf_dir).select("commit_hash", mining.rejected(text).alias("rejected"), mining.stage1_category(text).alias("category")).filter("NOT rejected AND category IS NOT NULL")
    c = view(spark, sf_dir, "v_code").filter("trim(before_source) != '' AND trim(after_source) != '' AND before_source != after_source")
    return c.join(m, "commit_hash").filter(mining.plausible(F.concat("before_source", "after_source"), F.col("category"))).select("pair_key", "category", "file_path")


IDS = "list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(subject, '#(\\d+)', 1), regexp_extract_all(subject, '([A-Z]+-\\d+)', 1)), regexp_extract_all(subject, '(?i)(?:fixes|resolves|closes)\\s+#?(\\d+)', 1))))"


@query(_with("v_msg") + f"SELECT doc_id, array_to_string({IDS}, '|') AS ids FROM v_msg")
def issue_ids(spark, sf_dir):
    return view(spark, sf_dir, "v_msg").select("doc_id", _join(T.issue_ids(F.col("subject"))).alias("ids"))


ISSUES = "SELECT (n_nationkey * 4 + 1)::VARCHAR AS issue_id, [n_name, r_name] AS labels FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(_with("v_msg") + f", i AS ({ISSUES}), x AS (SELECT doc_id, unnest({IDS}) AS issue_id FROM v_msg), j AS (SELECT doc_id, count(issue_id)::INT AS n_ids, list_sort(flatten(list(labels) FILTER (labels IS NOT NULL))) AS labels FROM x LEFT JOIN i USING (issue_id) GROUP BY doc_id) SELECT v_msg.doc_id, coalesce(n_ids, 0)::INT AS n_ids, coalesce(array_to_string(labels, '|'), '') AS labels FROM v_msg LEFT JOIN j USING (doc_id)")
def issue_labels(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    issues = n.join(r, n.n_regionkey == r.r_regionkey).select((F.col("n_nationkey") * 4 + 1).cast("string").alias("issue_id"), F.array("n_name", "r_name").alias("labels"))
    return mining.with_issues(view(spark, sf_dir, "v_msg"), "doc_id", F.col("subject"), issues).select("doc_id", "n_ids", _join("labels").alias("labels"))


PRS = "SELECT 'c' || (o_orderkey * 3)::VARCHAR AS commit_hash, o_orderkey AS pr_number, 'https://example.org/pull/' || o_orderkey::VARCHAR AS pr_url, 'Change ' || o_orderpriority AS pr_title, o_orderstatus = 'F' AS merged FROM orders"


def _prs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("c"), (F.col("o_orderkey") * 3).cast("string")).alias("commit_hash"), F.col("o_orderkey").alias("pr_number"), F.concat(F.lit("https://example.org/pull/"), F.col("o_orderkey").cast("string")).alias("pr_url"), F.concat(F.lit("Change "), F.col("o_orderpriority")).alias("pr_title"), (F.col("o_orderstatus") == "F").alias("merged"))


@query(_with("v_msg") + f"SELECT doc_id, pr_number, coalesce(pr_url, '') AS pr_url, coalesce(pr_title, '') AS pr_title FROM v_msg LEFT JOIN ({PRS}) p USING (commit_hash)")
def pr_lookup(spark, sf_dir):
    return mining.with_pull_request(view(spark, sf_dir, "v_msg"), _prs(spark, sf_dir)).select("doc_id", "pr_number", "pr_url", "pr_title")


@query(_with("v_msg") + f"SELECT doc_id FROM v_msg SEMI JOIN (SELECT * FROM ({PRS}) WHERE merged) p USING (commit_hash)")
def merged_only(spark, sf_dir):
    return mining.merged_only(view(spark, sf_dir, "v_msg"), _prs(spark, sf_dir)).select("doc_id")


@query(_with("v_msg") + f"""SELECT doc_id, CASE WHEN pr_number % 7 <> 0 THEN 'PR #' || pr_number::VARCHAR || CASE WHEN pr_number % 5 = 0 THEN '' ELSE ' · ' || substr(pr_title, 1, 80) END || ' | PR: ' || pr_url || ' | Commit: ' ELSE 'Commit: ' END
  || CASE WHEN doc_id % 4 = 1 THEN 'https://example.org/c/' || commit_hash ELSE 'https://github.com/' || repo || '/commit/' || commit_hash END AS details
FROM v_msg LEFT JOIN ({PRS}) p USING (commit_hash)""")
def pr_details(spark, sf_dir):
    """Some requests have no title, some no address, and some commits a link of their own."""
    prs = _prs(spark, sf_dir)
    prs = prs.withColumns({"pr_title": F.when(F.col("pr_number") % 5 != 0, F.col("pr_title")), "pr_url": F.when(F.col("pr_number") % 7 != 0, F.col("pr_url"))})
    d = mining.with_pull_request(view(spark, sf_dir, "v_msg"), prs)
    link = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("https://example.org/c/"), "commit_hash")).otherwise("")
    return d.select("doc_id", mining.traceability(F.col("repo"), F.col("commit_hash"), given=link).alias("details"))


# ---- signals and candidates ----------------------------------------------------------------------------------------


def _groups(rows, at: int) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(r[at:])
    return out


KW = _with("v_msg", "v_diff") + ", kw AS (" + " UNION ALL ".join(f"SELECT commit_hash, '{c}' AS category, 'keyword' AS source, 1::INT AS layer, array_to_string({R.sql_fired([(p[0].replace(chr(39), ''), R.sql_has(LOWERED, p[0], 'i')) for p in ps])}, '|') AS evidence FROM v_msg WHERE {' OR '.join(R.sql_has(LOWERED, p[0], 'i') for p in ps)}" for c, ps in _groups(R.KEYWORDS, 2).items()) + ")"
HEAD = "lower(substr(diff, 1, 5000))"
KD = ", kd AS (" + " UNION ALL ".join(f"SELECT commit_hash, '{c}' AS category, 'keyword' AS source, 2::INT AS layer, array_to_string({R.sql_fired([(p[0], R.sql_has(HEAD, p[0], 'i')) for p in ps])}, '|') AS evidence FROM v_diff WHERE {' OR '.join(R.sql_has(HEAD, p[0], 'i') for p in ps)}" for c, ps in _groups(R.KEYWORDS, 2).items()) + ")"
SIDES = """, sd AS (SELECT commit_hash, array_to_string(list_transform(list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')), lambda x: substr(x, 2)), chr(10)) AS gone,
  array_to_string(list_transform(list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), lambda x: substr(x, 2)), chr(10)) AS come FROM v_diff)"""


def _side_sql(p) -> str:
    return R.sql_has("gone" if p[0] == "before" else "come", p[1], "ms")


ST = SIDES + ", st0 AS (" + " UNION ALL ".join(f"SELECT commit_hash, '{c}' AS category, {R.sql_fired([(f'{p[0]}:{p[1]}', _side_sql(p)) for p in ps])} AS ev FROM sd" for c, ps in _groups(R.DIFF_PATTERNS, 2).items()) + """), st AS (SELECT commit_hash, category, CASE WHEN len(list_filter(ev, lambda e: starts_with(e, 'before:'))) > 0 AND len(list_filter(ev, lambda e: starts_with(e, 'after:'))) > 0 THEN 'structural' WHEN len(ev) >= 2 THEN 'structural_partial' END AS source,
  3::INT AS layer, array_to_string(ev, '|') AS evidence FROM st0)"""
BEST = """, al AS (SELECT * FROM kw UNION ALL SELECT * FROM kd UNION ALL SELECT * FROM st WHERE source IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY commit_hash, category ORDER BY CASE source WHEN 'structural' THEN 3 WHEN 'keyword' THEN 2 ELSE 1 END DESC, layer) AS rn FROM al QUALIFY rn = 1)"""
CAND = """, g AS (SELECT commit_hash, list_sort(list_distinct(list(category))) AS categories, list_sort(list_distinct(list(string_split(category, '.')[1]))) AS parents, count(*)::INT AS signal_count, bool_or(source = 'structural') AS st, bool_or(source = 'keyword') AS kw FROM best GROUP BY commit_hash),
cand AS (SELECT commit_hash, categories, parents, len(parents) >= 2 AS is_multi_fault, len(categories)::INT AS fault_count, signal_count, CASE WHEN st AND kw AND signal_count >= 4 THEN 'high' WHEN st AND kw THEN 'medium' ELSE 'low' END AS confidence FROM g)"""


def _signals(spark, sf_dir):
    m, d = view(spark, sf_dir, "v_msg"), view(spark, sf_dir, "v_diff")
    a = mining.keyword_signals(m, "commit_hash", mining.message(), 1)
    b = mining.keyword_signals(d, "commit_hash", F.lower(F.substring("diff", 1, 5000)), 2)
    return a, b, mining.diff_signals(d, "commit_hash")


def _candidates(spark, sf_dir):
    a, b, c = _signals(spark, sf_dir)
    return mining.candidates(mining.strongest(a.unionByName(b).unionByName(c), "commit_hash"), "commit_hash")


@query(KW + " SELECT commit_hash, category, source, layer, evidence FROM kw")
def keyword_signals(spark, sf_dir):
    return _signals(spark, sf_dir)[0]


@query(KW + KD + " SELECT commit_hash, category, source, layer, evidence FROM kd")
def diff_keyword_signals(spark, sf_dir):
    return _signals(spark, sf_dir)[1]


@query(KW + ST + " SELECT commit_hash, category, source, layer, evidence FROM st WHERE source IS NOT NULL")
def diff_signals(spark, sf_dir):
    return _signals(spark, sf_dir)[2]


RULE_ROWS = r"""SELECT 'b.' || CAST(item_id % 7 AS STRING) AS category, 'keyword' AS kind, '' AS side, CAST(item_id AS INT) AS ordinal, regexp_extract(text, '[A-Za-z]{{3,}} [A-Za-z]{{3,}}', 0) || '[a-z]*( |$)' AS pattern
  FROM {b} WHERE regexp_extract(text, '[A-Za-z]{{3,}} [A-Za-z]{{3,}}', 0) <> ''"""


@query("WITH rules AS (" + RULE_ROWS.replace("{b}", "benchmark").replace("{{", "{").replace("}}", "}") + " UNION ALL SELECT category, 'keyword', '', ordinal, pattern FROM (VALUES " + ", ".join(f"('{c}', {i}, '{p}')" for c, i, p in R.KEYWORDS) + """) t(category, ordinal, pattern))
SELECT doc_id, category, 'keyword' AS source, 1::INT AS layer, string_agg(pattern, '|' ORDER BY ordinal, pattern) AS evidence FROM documents, rules WHERE regexp_matches(text, '(?i)' || pattern) GROUP BY doc_id, category""")
def rule_table_signals(spark, sf_dir):
    """Rules that are rows: the built-in keywords and a phrase of every benchmark item."""
    own = spark.createDataFrame(list(R.KEYWORDS), "category string, ordinal int, pattern string").selectExpr("category", "'keyword' AS kind", "'' AS side", "ordinal", "pattern")
    rules = rule_data.numbered(own.unionByName(spark.sql(RULE_ROWS, b=table(spark, sf_dir, "benchmark"))))
    return rule_data.keyword_signals(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 1, rules)


@query(KW + KD + ST + BEST + " SELECT commit_hash, category, source, layer FROM best")
def signal_dedupe(spark, sf_dir):
    a, b, c = _signals(spark, sf_dir)
    return mining.strongest(a.unionByName(b).unionByName(c), "commit_hash").select("commit_hash", "category", "source", "layer")


@query(KW + KD + ST + BEST + CAND + " SELECT commit_hash, array_to_string(categories, '|') AS categories, array_to_string(parents, '|') AS parents, is_multi_fault, fault_count, signal_count, confidence FROM cand")
def candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).withColumns({"categories": _join("categories"), "parents": _join("parents")})


@query(KW + KD + ST + BEST + CAND + " SELECT commit_hash FROM cand WHERE list_contains(parents, 'memory') AND list_contains(parents, 'resource')")
def class_filter(spark, sf_dir):
    return mining.class_filter(_candidates(spark, sf_dir), "ML+RL").select("commit_hash")


@query(KW + KD + ST + BEST + CAND + " SELECT commit_hash, confidence FROM cand WHERE confidence IN ('medium', 'high')")
def confidence_filter(spark, sf_dir):
    return mining.at_least(_candidates(spark, sf_dir), "medium").select("commit_hash", "confidence")


CLS = "array_to_string(list_filter([CASE WHEN list_contains(parents, 'synchronization') THEN 'LC' END, CASE WHEN list_contains(parents, 'memory') THEN 'ML' END, CASE WHEN list_contains(parents, 'resource') THEN 'RL' END], lambda x: x IS NOT NULL), '+')"


@query(KW + KD + ST + BEST + CAND + f", x AS (SELECT {CLS} AS c FROM cand) SELECT label, CASE WHEN label LIKE '%total' THEN count_if(contains(c, label[1:2])) ELSE count_if(c = replace(label, ' only', '')) END::BIGINT AS n FROM x, (VALUES ('LC only'), ('ML only'), ('RL only'), ('LC+ML'), ('LC+RL'), ('ML+RL'), ('LC+ML+RL'), ('LC total'), ('ML total'), ('RL total')) t(label) GROUP BY label")
def class_breakdown(spark, sf_dir):
    return mining.class_breakdown(_candidates(spark, sf_dir))


@query(KW + KD + ST + BEST + CAND + " SELECT repo, count(*)::BIGINT AS total, count_if(is_multi_fault)::BIGINT AS multi, count_if(confidence = 'low')::BIGINT AS low, count_if(confidence = 'medium')::BIGINT AS medium, count_if(confidence = 'high')::BIGINT AS high FROM cand JOIN v_msg USING (commit_hash) GROUP BY repo")
def repo_summary(spark, sf_dir):
    return mining.repo_summary(_candidates(spark, sf_dir).join(view(spark, sf_dir, "v_msg").select("commit_hash", "repo"), "commit_hash"))


@query(KW + KD + ST + BEST + CAND + ", x AS (SELECT unnest(categories) AS category FROM cand) SELECT category, string_split(category, '.')[1] AS parent, count(*)::BIGINT AS n FROM x GROUP BY ALL")
def category_counts(spark, sf_dir):
    d = _candidates(spark, sf_dir).select(F.explode("categories").alias("category"))
    return d.groupBy("category").agg(F.count("*").alias("n")).select("category", F.substring_index("category", ".", 1).alias("parent"), "n")


@query(KW + KD + ST + BEST + CAND + " SELECT array_to_string(parents, '+') AS combo, count(*)::BIGINT AS n FROM cand WHERE is_multi_fault GROUP BY ALL")
def combo_counts(spark, sf_dir):
    return _candidates(spark, sf_dir).filter("is_multi_fault").groupBy(_join("parents", "+").alias("combo")).agg(F.count("*").alias("n"))


# ---- diffs and methods ---------------------------------------------------------------------------------------------

LINES = "string_split(diff, chr(10))"


@query(_with("v_diff") + f"SELECT pair_key, len(list_filter({LINES}, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')))::INT AS removed, len(list_filter({LINES}, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')))::INT AS added FROM v_diff")
def diff_lines(spark, sf_dir):
    return view(spark, sf_dir, "v_diff").select("pair_key", F.size(T.side(F.col("diff"), "-")).alias("removed"), F.size(T.side(F.col("diff"), "+")).alias("added"))


def _hunk_sql(p: str) -> str:
    return f"coalesce(nullif(regexp_extract(h, '{p}', 1), ''), '1')::INT"


HUNKS = f"hk AS (SELECT pair_key, commit_hash, file_path, unnest(list_filter({LINES}, lambda x: regexp_matches(x, '^@@ -\\d+(,\\d+)? \\+\\d+(,\\d+)? @@'))) AS h FROM v_diff), hunk AS (SELECT pair_key, commit_hash, file_path, {_hunk_sql('^@@ -(' + chr(92) + 'd+)')} AS old_start, {_hunk_sql('^@@ -' + chr(92) + 'd+,(' + chr(92) + 'd+)')} AS old_count, {_hunk_sql('^@@ -' + chr(92) + 'd+(?:,' + chr(92) + 'd+)? ' + chr(92) + '+(' + chr(92) + 'd+)')} AS new_start, {_hunk_sql('^@@ -' + chr(92) + 'd+(?:,' + chr(92) + 'd+)? ' + chr(92) + '+' + chr(92) + 'd+,(' + chr(92) + 'd+)')} AS new_count FROM hk)"


def _hunks(spark, sf_dir):
    return view(spark, sf_dir, "v_diff").select("pair_key", "commit_hash", "file_path", F.explode(T.hunks(F.col("diff"))).alias("h")).select("pair_key", "commit_hash", "file_path", "h.*")


@query(_with("v_diff") + f", {HUNKS} SELECT pair_key, old_start, old_count, new_start, new_count FROM hunk")
def hunks(spark, sf_dir):
    return _hunks(spark, sf_dir).drop("commit_hash", "file_path")


@query(_with("v_diff") + f"SELECT pair_key, array_to_string(list_transform(list_filter({LINES}, lambda x: starts_with(x, '+++ b/') AND suffix(x, '.java')), lambda x: substr(x, 7)), '|') AS files FROM v_diff")
def changed_files(spark, sf_dir):
    return view(spark, sf_dir, "v_diff").select("pair_key", _join(T.changed_files(F.col("diff"))).alias("files"))


def _names_sql(x: str, most: str) -> str:
    """Names before brackets in ``x``; ``most``: what r, the text before the blank and the name, has to satisfy."""
    found = f"list_transform(regexp_extract_all({x}, '{T.BEFORE_BRACKET}', 1), lambda b: {{'n': regexp_extract(b, '{T.LAST_NAME}', 1), 'r': regexp_replace(b, '{T.LAST_NAME}', '')}})"
    return f"list_transform(list_filter({found}, lambda y: y.n <> '' AND {most}), lambda y: y.n)"


CHANGED = rf"""list_sort(list_distinct(list_filter(list_concat(list_transform(list_filter({LINES}, lambda x: starts_with(x, '@@')), lambda x: regexp_extract_all(x, '{T.NAMED_BRACKET}', 1)[-1]),
  list_filter(list_transform(list_filter({LINES}, lambda x: (starts_with(x, '+') AND NOT starts_with(x, '+++')) OR (starts_with(x, '-') AND NOT starts_with(x, '---'))), lambda x: {_names_sql('x', f"regexp_matches(y.r, '{T.MODIFIED}')")}[1]), lambda n: n NOT IN ('if', 'for', 'while', 'switch', 'catch'))), lambda n: n IS NOT NULL)))"""


@query(_with("v_diff") + f"SELECT pair_key, array_to_string({CHANGED}, '|') AS methods FROM v_diff")
def changed_methods(spark, sf_dir):
    return view(spark, sf_dir, "v_diff").select("pair_key", _join(T.changed_methods(F.col("diff"))).alias("methods"))


METHOD = T.METHOD


def _methods_sql(side: str, name: str) -> str:
    return f"""{name}0 AS (SELECT pair_key, commit_hash, file_path, unnest(string_split({side}, chr(10))) AS l, generate_subscripts(string_split({side}, chr(10)), 1) AS i FROM v_code),
{name}1 AS (SELECT *, length(l) - length(replace(l, '{{', '')) - length(l) + length(replace(l, '}}', '')) AS d FROM {name}0),
{name}2 AS (SELECT s.pair_key, s.i AS si, j.i AS ji, sum(j.d) OVER (PARTITION BY s.pair_key, s.i ORDER BY j.i) AS depth FROM {name}1 s JOIN {name}1 j ON s.pair_key = j.pair_key AND j.i >= s.i WHERE regexp_matches(s.l, '{METHOD}')),
{name} AS (SELECT m.pair_key, m.commit_hash, m.file_path, regexp_extract(m.l, '{METHOD}', 1) AS name, 'Unknown.' || regexp_extract(m.l, '{METHOD}', 1) || '(' || regexp_extract(m.l, '{METHOD}', 2) || ')' AS signature, m.i::INT AS start_line,
  coalesce(e.e, m.i)::INT AS end_line FROM {name}1 m LEFT JOIN (SELECT pair_key, si, min(ji) AS e FROM {name}2 WHERE depth = 0 AND ji > si GROUP BY ALL) e ON e.pair_key = m.pair_key AND e.si = m.i WHERE regexp_matches(m.l, '{METHOD}'))"""


def _methods(spark, sf_dir, side):
    d = view(spark, sf_dir, "v_code").select("pair_key", "commit_hash", "file_path", F.explode(T.methods(F.col(side))).alias("m"))
    return d.select("pair_key", "commit_hash", "file_path", "m.*")


@query(_with("v_code") + ", " + _methods_sql("before_source", "mb") + " SELECT pair_key, name, signature, start_line, end_line FROM mb")
def method_split(spark, sf_dir):
    return _methods(spark, sf_dir, "before_source").select("pair_key", "name", "signature", "start_line", "end_line")


_LEX = r"""(?s)"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|@[\p{L}\p{N}_$.]+\s*\((?:[^()"'']|"(?:[^"\\\n]|\\.)*"|\([^()]*\))*\)|[^"''/@]+|."""
_RE2 = {n: getattr(T, n).replace("*+", "*").replace("++", "+") for n in ("CLASS_HEAD", "OBJECT_HEAD", "CONSTANT_HEAD", "METHOD_HEAD", "TYPED_NAME")}
_NOT_TYPES, _NOT_NAMES = (", ".join(f"'{w}'" for w in ws) for ws in (T.NO_TYPE, T.NO_NAME))
#: The same by joins: pieces with their depth, the pieces that they stand in, kinds from outside in, and the brace that closes each.
SCOPES = (
    "WITH RECURSIVE v_file AS ("
    + corpus.VIEWS["v_file"]
    + rf"""), bare AS (SELECT pair_key, source, array_to_string(list_transform(regexp_extract_all(source, '{_LEX}'), lambda x: CASE WHEN regexp_matches(x, '^(?:"|''|//|/\*)') THEN regexp_replace(x, '[^\n]', ' ', 'g')
  WHEN starts_with(x, '@') AND length(x) > 1 THEN regexp_extract(x, '^@[\p{{L}}\p{{N}}_$.]+') || repeat(' ', length(x) - length(regexp_extract(x, '^@[\p{{L}}\p{{N}}_$.]+'))) ELSE x END), '') AS b FROM v_file),
p0 AS (SELECT pair_key, unnest(regexp_extract_all(b, '[^{{}};]*[{{}};]')) AS x, generate_subscripts(regexp_extract_all(b, '[^{{}};]*[{{}};]'), 1) AS i FROM bare),
p1 AS (SELECT *, x[-1] AS t, x[:-2] AS h, sum(length(x)) OVER w AS upto, sum(CASE x[-1] WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS after FROM p0 WINDOW w AS (PARTITION BY pair_key ORDER BY i)),
p2 AS (SELECT *, upto - length(x) AS pos, after - CASE t WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END AS depth, regexp_extract(h, '{_RE2["METHOD_HEAD"]}', 1) AS head FROM p1),
p3 AS (SELECT *, CASE WHEN regexp_extract(head, '{_RE2["TYPED_NAME"]}', 1) NOT IN ({_NOT_TYPES}) AND regexp_extract(head, '{_RE2["TYPED_NAME"]}', 2) NOT IN ({_NOT_NAMES}) THEN regexp_extract(head, '{_RE2["TYPED_NAME"]}', 2) ELSE '' END AS name,
  regexp_extract(h, '{_RE2["CLASS_HEAD"]}', 1) AS ck, regexp_extract(h, '{_RE2["CLASS_HEAD"]}', 2) AS cn FROM p2),
p4 AS (SELECT s.*, (SELECT max(o.i) FROM p3 o WHERE o.pair_key = s.pair_key AND o.i < s.i AND o.t = '{{' AND o.depth = s.depth - 1) AS up FROM p3 s),
k AS (SELECT p4.*, CASE WHEN ck <> '' THEN ck WHEN regexp_matches(h, '{_RE2["OBJECT_HEAD"]}') THEN 'object' ELSE 'block' END AS kind, CASE WHEN ck IN ('class', 'interface', 'enum') THEN cn ELSE 'Unknown' END AS owner, false AS member, 'Unknown' AS around FROM p4 WHERE up IS NULL
  UNION ALL SELECT p4.*, CASE WHEN p4.ck <> '' THEN p4.ck WHEN p4.name <> '' AND k.kind IN ('class', 'interface', 'enum', 'record', 'object') THEN 'method'
    WHEN regexp_matches(p4.h, '{_RE2["OBJECT_HEAD"]}') OR k.kind = 'enum' AND regexp_matches(p4.h, '{_RE2["CONSTANT_HEAD"]}') THEN 'object' ELSE 'block' END,
    CASE WHEN p4.ck IN ('class', 'interface', 'enum') THEN p4.cn ELSE k.owner END, k.kind IN ('class', 'interface', 'enum', 'record', 'object'), k.owner FROM p4 JOIN k ON k.pair_key = p4.pair_key AND k.i = p4.up AND k.t = '{{'),
e AS (SELECT *, CASE t WHEN ';' THEN upto ELSE (SELECT min(c.upto) FROM p3 c WHERE c.pair_key = k.pair_key AND c.i > k.i AND c.t = '}}' AND c.after = k.depth) END AS stop, pos + length(regexp_extract(h, '^\s*')) AS start FROM k WHERE (t = '{{' AND kind = 'method') OR (t = ';' AND member AND name <> '')),
sm AS (SELECT pair_key, name, around AS class_name, around || '.' || name || substr(source, (pos + length(head) + 1)::BIGINT, length(regexp_extract(h, '{_RE2["METHOD_HEAD"]}', 2))) AS signature,
  (length(source[:start]) - length(replace(source[:start], chr(10), '')) + 1)::INT AS start_line, (length(source[:stop]) - length(replace(source[:stop], chr(10), '')) + 1)::INT AS end_line, substr(source, (start + 1)::BIGINT, (stop - start)::BIGINT) AS body FROM e JOIN v_file USING (pair_key) WHERE stop IS NOT NULL)"""
)


@query(SCOPES + " SELECT pair_key, name, class_name, signature, start_line, end_line, sha256(body) AS body FROM sm")
def scoped_methods(spark, sf_dir):
    d = view(spark, sf_dir, "v_file").select("pair_key", F.explode(T.scoped_methods(F.col("source"))).alias("m"))
    return d.select("pair_key", "m.name", "m.class_name", "m.signature", "m.start_line", "m.end_line", F.sha2("m.source", 256).alias("body"))


MATCH = _with("v_code") + ", " + _methods_sql("before_source", "mb") + ", " + _methods_sql("after_source", "ma") + """, h AS (SELECT pair_key AS k, pair_key % 3 + 1 AS s, 2 AS n FROM v_code), x AS (SELECT mb.pair_key, signature, mb.start_line AS before_start, ma.start_line AS after_start FROM mb JOIN ma USING (pair_key, signature) JOIN v_code USING (pair_key)
  WHERE trim(before_source) <> trim(after_source) AND EXISTS (SELECT 1 FROM h WHERE k = mb.pair_key AND ((mb.start_line <= s + n - 1 AND mb.end_line >= s) OR (ma.start_line <= s + n - 1 AND ma.end_line >= s))))"""


@query(MATCH + " SELECT 'c' || pair_key::VARCHAR AS commit_hash, signature, before_start::INT AS before_start, after_start::INT AS after_start FROM x")
def method_match_overlap(spark, sf_dir):
    c = view(spark, sf_dir, "v_code")
    start = (F.col("pair_key") % 3 + 1).cast("int")
    h = c.select("commit_hash", "file_path", start.alias("old_start"), F.lit(2).alias("old_count"), start.alias("new_start"), F.lit(2).alias("new_count"))
    m = fusion.matched_methods(_methods(spark, sf_dir, "before_source"), _methods(spark, sf_dir, "after_source"), h, ("commit_hash", "file_path"))
    return m.select("commit_hash", "signature", F.col("start_line").alias("before_start"), "after_start")


@query(_with("v_code") + "SELECT pair_key, substr(sha256(repo || ':' || commit_hash || ':' || file_path || ':' || signature), 1, 16) AS pair_id FROM v_code")
def pair_ids(spark, sf_dir):
    return view(spark, sf_dir, "v_code").select("pair_key", T.pair_id(F.col("repo"), F.col("commit_hash"), F.col("file_path"), F.col("signature")).alias("pair_id"))


RULED = _with("v_code") + f", hit AS (SELECT *, {R.sql_fired(R.sql_change_rules('before_source', 'after_source'))} AS sc, {R.sql_fired(R.sql_combined_rules('before_source', 'after_source'))} AS mf FROM v_code), det AS (SELECT *, list_sort(list_distinct(list_concat(list_transform(sc, lambda i: CASE i {' '.join(f'WHEN {chr(39)}{r.id}{chr(39)} THEN {chr(39)}{r.category}{chr(39)}' for r in R.CHANGES)} END), flatten(list_transform(mf, lambda i: CASE i {' '.join(f'WHEN {chr(39)}{r.id}{chr(39)} THEN {list(r.categories)}' for r in R.COMBINED)} END))))) AS detected FROM hit)"


def _hits(spark, sf_dir):
    return fusion.rule_hits(view(spark, sf_dir, "v_code"))


@query(RULED + " SELECT pair_key, array_to_string(sc, '|') AS changes FROM det")
def structural_changes(spark, sf_dir):
    return _hits(spark, sf_dir).select("pair_key", _join("structural_changes").alias("changes"))


@query(RULED + " SELECT pair_key, array_to_string(mf, '|') AS signals FROM det")
def multi_fault_signals(spark, sf_dir):
    return _hits(spark, sf_dir).select("pair_key", _join("multi_fault_signals").alias("signals"))


PAPER = f"list_filter(list_transform(flatten(list_transform(detected, lambda c: [{', '.join(f'CASE WHEN starts_with(c, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{v}{chr(39)} END' for p, v in R.PAPER.items())}])), lambda x: x), lambda x: x IS NOT NULL)"


@query(RULED + f", pl AS (SELECT pair_key, detected, {PAPER} AS l FROM det) SELECT pair_key, CASE WHEN len(l) > 0 THEN array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '+') ELSE coalesce(detected[1], 'UNKNOWN') END AS label FROM pl")
def paper_label(spark, sf_dir):
    return _hits(spark, sf_dir).select("pair_key", fusion.paper_label("detected").alias("label"))


@query(RULED + ", x AS (SELECT unnest(detected) AS category FROM det) SELECT category, string_split(category, '.')[1] AS parent, count(*)::BIGINT AS n FROM x GROUP BY ALL")
def pair_totals(spark, sf_dir):
    d = _hits(spark, sf_dir).select(F.explode("detected").alias("category"))
    return d.groupBy("category", F.substring_index("category", ".", 1).alias("parent")).agg(F.count("*").alias("n"))


PROFILE = "resource_allocations resource_deallocations collection_adds collection_removes collection_types loop_count has_try_with_resources has_finally has_eviction has_bounding has_lock_ordering has_trylock has_readwrite_lock has_atomic autoboxing full_collection_load polling_pattern busy_wait thread_sleep_in_loop raw_thread_creation unbounded_pool unclosed_resources lock_acquires lock_depth sync_scope_chars io_in_lock loop_in_lock heavy_compute_in_lock nested_loop_count loop_has_allocation loop_has_io string_concat_in_loop".split()


@query(_with("v_code") + f", p AS (SELECT pair_key, {flow.sql_profile('before_source')} AS b FROM v_code) SELECT pair_key, {', '.join(f'b.{c} AS {c}' for c in PROFILE)} FROM p")
def flow_profile(spark, sf_dir):
    return view(spark, sf_dir, "v_code").select("pair_key", flow.profile(F.col("before_source")).alias("b")).select("pair_key", *[f"b.{c}" for c in PROFILE])


FLOWED = RULED + f", pro AS (SELECT *, {flow.sql_profile('before_source')} AS b, {flow.sql_profile('after_source')} AS a FROM det), fnd AS (SELECT *, {flow.sql_findings()} AS findings FROM pro)"


@query(FLOWED + " SELECT pair_key, array_to_string(findings, '|') AS findings FROM fnd")
def flow_rules(spark, sf_dir):
    return fusion.fuse(_hits(spark, sf_dir)).select("pair_key", _join("findings").alias("findings"))


def _case(x: str, table: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in table.items()) + " ELSE [] END"


FUSED = (
    FLOWED
    + f""", prt AS (SELECT *, flatten(list_transform(mf, lambda s: string_split(string_split(s, ':')[1], '+'))) AS ab FROM fnd),
cats AS (SELECT *, list_sort(list_distinct(list_concat(list_concat(detected, flatten(list_transform(ab, lambda z: {_case('z', {k: (c,) for k, (_, c) in R.ABBREVIATIONS.items()})}))), flatten(list_transform(findings, lambda z: {_case('z', {k: c for k, (_, _, c) in flow.FINDINGS.items()})}))))) AS cs,
  list_sort(list_distinct(list_concat(list_concat(list_transform(detected, lambda c: string_split(c, '.')[1]), flatten(list_transform(ab, lambda z: {_case('z', {k: (p,) for k, (p, _) in R.ABBREVIATIONS.items()})}))), flatten(list_transform(findings, lambda z: {_case('z', {k: p for k, (_, p, _) in flow.FINDINGS.items()})}))))) AS ps FROM prt),
mul AS (SELECT *, len(ps) >= 2 OR len(cs) >= 2 AS multi, (len(mf) > 0)::INT + (len(findings) > 0)::INT + (len(detected) >= 2)::INT AS ly FROM cats),
fus AS (SELECT *, CASE WHEN multi THEN array_to_string(list_transform(ps, lambda p: CASE p {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.SHORT.items())} ELSE upper(p) END), '+') ELSE '' END AS dependency_label, CASE WHEN multi THEN ly ELSE 0 END AS layers,
  CASE WHEN multi THEN len(list_filter([{', '.join('(' + ' OR '.join(f"len(list_filter(cs, lambda c: contains(lower(c), '{w}'))) > 0" for w in ws) + ')' for ws, _ in R.HINTS)}], lambda h: h)) ELSE 0 END AS hints FROM mul)"""
)


def _fused(spark, sf_dir):
    return fusion.fuse(_hits(spark, sf_dir))


@query(FUSED + " SELECT pair_key, array_to_string(cs, '|') AS categories, array_to_string(ps, '|') AS parents, multi AS is_multi_fault, len(cs)::INT AS fault_count, dependency_label, layers::INT AS detection_layers, CASE WHEN layers >= 3 THEN 'high' WHEN layers >= 2 THEN 'medium' ELSE 'low' END AS confidence, hints::INT AS n_hints FROM fus")
def pair_fusion(spark, sf_dir):
    f = _fused(spark, sf_dir)
    return f.select("pair_key", _join("all_categories").alias("categories"), _join("all_parents").alias("parents"), "is_multi_fault", "fault_count", "dependency_label", "detection_layers", "confidence", F.size("validation_needed").alias("n_hints"))


def _pairs_sql(x: str) -> str:
    return FUSED + f", e AS (SELECT {x} AS x, unnest({x}) AS a, generate_subscripts({x}, 1) AS i FROM fus WHERE multi), pr AS (SELECT a AS first, unnest(x[i + 1:]) AS second FROM e) SELECT first, second, count(*)::BIGINT AS n FROM pr GROUP BY ALL"


@query(_pairs_sql("ps"))
def cooccurrence_parents(spark, sf_dir):
    return fusion.co_occurrence(_fused(spark, sf_dir), "all_parents")


@query(_pairs_sql("cs") + " ORDER BY n DESC, first, second LIMIT 30")
def cooccurrence_categories(spark, sf_dir):
    return fusion.co_occurrence(_fused(spark, sf_dir), "all_categories", 30)


@query(FUSED + " SELECT count(*)::BIGINT AS total, count_if(multi)::BIGINT AS multi, count_if(multi AND len(ps) = 2)::BIGINT AS dual, count_if(multi AND len(ps) >= 3)::BIGINT AS triple, round(100.0::DOUBLE * count_if(multi) / greatest(count(*), 1), 1)::VARCHAR || '%' AS rate FROM fus")
def multi_report(spark, sf_dir):
    return fusion.report(_fused(spark, sf_dir))


@query(FUSED + " SELECT repo, dependency_label, count(*)::BIGINT AS n FROM fus WHERE multi GROUP BY ALL")
def repo_label_counts(spark, sf_dir):
    return _fused(spark, sf_dir).filter("is_multi_fault").groupBy("repo", "dependency_label").agg(F.count("*").alias("n"))


EXPECTED = (("ML+LC", ("memory.memory_leak",), 1, 100000), ("LC+RL", ("resource.resource_leak",), 0, 5), ("NONE", ("none",), 0, 0))


@query(FUSED + ", ex AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {list(c)}, {lo}, {hi})" for a, c, lo, hi in EXPECTED) + ") t(alias, categories, lo, hi)) SELECT alias, count(dependency_label)::BIGINT AS found, count(dependency_label) BETWEEN min(lo) AND min(hi) AS in_range FROM ex LEFT JOIN (SELECT * FROM fus WHERE multi) f ON contains(replace(dependency_label, '+', ''), replace(alias, '+', '')) OR list_has_any(cs, categories) GROUP BY alias")
def expected_ranges(spark, sf_dir):
    e = spark.createDataFrame([(a, list(c), lo, hi) for a, c, lo, hi in EXPECTED], "alias string, categories array<string>, lo long, hi long")
    return fusion.expected_ranges(_fused(spark, sf_dir), e)


@query(FUSED + " SELECT pair_key::VARCHAR AS pair_key, repo, array_to_string(ps, '|') AS all_parents, multi::VARCHAR AS is_multi_fault, coalesce(before_source, '') AS before_source, '' AS pr_url FROM fus")
def hydrate_export(spark, sf_dir):
    f = _fused(spark, sf_dir).drop("before_source")
    source = view(spark, sf_dir, "v_code").select("pair_key", "before_source")
    return flat(f.join(source, "pair_key", "left"), ["pair_key", "repo", "all_parents", "is_multi_fault", "before_source", "pr_url"])


BASE = "CASE " + " ".join("WHEN " + " + ".join(f"{R.sql_has('before_source', p)}::INT" for p in ps) + f" >= 2 THEN {label}" for label, ps in R.BASELINE) + f" ELSE {R.SAFE} END"


@query(_with("v_code") + f"SELECT pair_key, {BASE} AS predicted FROM v_code")
def pattern_baseline(spark, sf_dir):
    return view(spark, sf_dir, "v_code").select("pair_key", fusion.baseline_label(F.col("before_source")).alias("predicted"))


ANSWERS = "SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'Lock_Contention. ' WHEN 1 THEN 'memory_leak' WHEN 2 THEN 'RESOURCE_LEAK!' WHEN 3 THEN 'This looks unsafe' ELSE '' END || coalesce(text, '') AS answer FROM {0}"
PARSED = "CASE WHEN contains(upper(answer), 'LOCK_CONTENTION') THEN 0 WHEN contains(upper(answer), 'MEMORY_LEAK') THEN 1 WHEN contains(upper(answer), 'RESOURCE_LEAK') THEN 2 ELSE 3 END"


def _answers(spark, sf_dir):
    return spark.sql(ANSWERS.format("{c}"), c=table(spark, sf_dir, "conversations"))


@query(f"WITH a AS ({ANSWERS.format('conversations')}) SELECT conv_id, turn, {PARSED} AS label FROM a")
def llm_parse(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", fusion.parsed_answer(F.col("answer")).alias("label"))


@query(f"WITH a AS ({ANSWERS.format('conversations')}), l AS (SELECT conv_id, turn, {PARSED} AS label FROM a), g AS (SELECT conv_id, label, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(turn)) AS rn FROM l GROUP BY conv_id, label) SELECT conv_id, label AS predicted FROM g WHERE rn = 1")
def vote_mode(spark, sf_dir):
    return vectors.majority(llm_parse(spark, sf_dir), "conv_id", "label", "turn")


@query(f"WITH {VEC}, {NEAR} SELECT vec_id, 'Classify the Java method as LOCK_CONTENTION, MEMORY_LEAK, RESOURCE_LEAK or SAFE.' || chr(10) || 'm' || vec_id::VARCHAR || chr(10) || 'Similar methods: ' || string_agg(['LOCK_CONTENTION', 'MEMORY_LEAK', 'RESOURCE_LEAK', 'SAFE'][neighbour_label + 1] || ' (similarity ' || printf('%.2f', sim) || ')', '; ' ORDER BY rank) AS prompt FROM k GROUP BY vec_id")
def prompt_build(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in screening.NAMES])
    n = _near(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.element_at(names, F.col("neighbour_label") + 1).alias("label"), "sim"))).alias("n"))
    return n.select("vec_id", screening.majority_prompt(F.concat(F.lit("m"), F.col("vec_id").cast("string")), F.col("n")).alias("prompt"))


ASK = "'Classify the Java method as LOCK_CONTENTION, MEMORY_LEAK, RESOURCE_LEAK or SAFE.' || chr(10) || 'm' || vec_id::VARCHAR"


@query(f"SELECT vec_id, 'zero_shot' AS mode, {ASK} AS prompt FROM embeddings UNION ALL SELECT vec_id, 'chain', {ASK} || chr(10) || 'Think step by step, then answer with one name.' FROM embeddings")
def prompt_modes(spark, sf_dir):
    v, name = table(spark, sf_dir, "embeddings"), F.concat(F.lit("m"), F.col("vec_id").cast("string"))
    return readers.union_all([v.select("vec_id", F.lit(m).alias("mode"), screening.majority_prompt(name, F.lit(None), m).alias("prompt")) for m in ("zero_shot", "chain")])


KEYS = ("java:S2095", "java:S6437", "java:S3077", "java:S2160", "java:S2142", "java:S3046", "java:S1", "")


@query(f"SELECT p_partkey, CASE {list(KEYS)}[p_partkey % {len(KEYS)} + 1] {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in R.RULE_KEYS.items())} ELSE {R.SAFE} END AS label FROM part")
def finding_labels(spark, sf_dir):
    key = F.get(F.array(*[F.lit(k) for k in KEYS]), (F.col("p_partkey") % len(KEYS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", fusion.finding_label(key).alias("label"))


# ---- extraction ----------------------------------------------------------------------------------------------------


def _extracted(spark, sf_dir):
    """Commits, contents of both revisions (some of the old ones are missing) and diffs to method pairs. Some repositories have a fork, which
    shares their hashes; some pull requests lack a title or an address, and some commits have a link of their own."""

    def forked(d: DataFrame) -> DataFrame:
        fork = d.filter("pair_key % 6 = 0").withColumn("repo", F.concat("repo", F.lit("-fork")))
        return d.unionByName(fork)

    c = forked(view(spark, sf_dir, "v_code"))
    key = F.col("pair_key")
    number, link = F.when(key % 2 == 0, key.cast("string")), F.when(key % 4 == 1, F.concat(F.lit("https://example.org/c/"), "commit_hash"))
    request = (number.alias("pr_number"), F.when(key % 7 != 0, F.concat(F.lit("u"), number)).alias("pr_url"), F.when(key % 5 == 0, "").otherwise("t").alias("pr_title"), link.alias("commit_url"))
    old = F.concat(F.lit("p"), F.col("pair_key").cast("string"))
    none = F.array().cast("array<string>")
    found = c.select("repo", "commit_hash", old.alias("parent_hash"), F.array("file_path").alias("changed_java_files"), none.alias("all_categories"), none.alias("all_parents"), (F.col("pair_key") % 5 == 0).alias("is_multi_fault"), F.lit("low").alias("confidence"), *request)
    contents = c.filter("pair_key % 13 != 0").select("repo", old.alias("revision"), "file_path", F.col("before_source").alias("content")).union(c.select("repo", "commit_hash", "file_path", "after_source"))
    return extraction.method_pairs(found, contents, forked(view(spark, sf_dir, "v_diff")))


XT0 = _with("v_code", "v_diff") + RULED.removeprefix(_with("v_code")) + f", {HUNKS}, " + _methods_sql("before_source", "mb") + ", " + _methods_sql("after_source", "ma") + f""", xt0 AS (SELECT det.*, mb.signature, mb.name, mb.start_line AS bs, mb.end_line AS be, ma.start_line AS sa, ma.end_line AS ea, len(mf) > 0 OR det.pair_key % 5 = 0 AS multi
  FROM mb JOIN ma USING (pair_key, signature) JOIN det USING (pair_key) WHERE det.pair_key % 13 <> 0 AND trim(before_source) <> trim(after_source)
  AND EXISTS (SELECT 1 FROM hunk h WHERE h.pair_key = mb.pair_key AND ((mb.start_line <= h.old_start + h.old_count - 1 AND mb.end_line >= h.old_start) OR (ma.start_line <= h.new_start + h.new_count - 1 AND ma.end_line >= h.new_start))))"""
XT = XT0 + ", xt AS (SELECT * FROM xt0 UNION ALL SELECT * REPLACE (repo || '-fork' AS repo) FROM xt0 WHERE pair_key % 6 = 0)"
XL = f", pl AS (SELECT *, {PAPER} AS l FROM xt)"


@query(XT + XL + """ SELECT substr(sha256(repo || ':' || commit_hash || ':' || file_path || ':' || signature), 1, 16) AS pair_id, commit_hash, file_path, name AS method_name, bs AS before_line_start, be AS before_line_end, sa AS after_line_start, ea AS after_line_end, multi AS is_multi_fault,
CASE WHEN len(l) > 0 THEN array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '+') ELSE coalesce(detected[1], 'UNKNOWN') END AS fault_category, CASE WHEN pair_key % 2 = 0 AND pair_key % 7 <> 0 THEN 'PR #' || pair_key || CASE WHEN pair_key % 5 = 0 THEN '' ELSE ' · t' END || ' | PR: u' || pair_key || ' | Commit: ' ELSE 'Commit: ' END
  || CASE WHEN pair_key % 4 = 1 THEN 'https://example.org/c/' || commit_hash ELSE 'https://github.com/' || repo || '/commit/' || commit_hash END AS pr_details FROM pl""")
def extract_pairs(spark, sf_dir):
    return _extracted(spark, sf_dir).select("pair_id", "commit_hash", "file_path", "method_name", "before_line_start", "before_line_end", "after_line_start", "after_line_end", "is_multi_fault", "fault_category", "pr_details")


@query(XT + f", tk AS (SELECT *, {NTOK.replace('text', 'before_source')} > 20 OR {NTOK.replace('text', 'after_source')} > 20 AS long FROM xt) SELECT count(*)::BIGINT AS total_pairs, count_if(multi)::BIGINT AS multi_fault_pairs, count_if(long)::BIGINT AS truncated FROM tk")
def extract_report(spark, sf_dir):
    return extraction.report(_extracted(spark, sf_dir), 20)


@query(XT + """, x AS (SELECT 'category' AS kind, unnest(detected) AS name FROM xt UNION ALL SELECT 'parent', string_split(c, '.')[1] FROM (SELECT unnest(detected) AS c FROM xt) UNION ALL SELECT 'signal', unnest(mf) FROM xt) SELECT kind, name, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def extract_counts(spark, sf_dir):
    return extraction.counts(_extracted(spark, sf_dir))


def _bodies_sql(side: str, name: str) -> str:
    """The first body of each method of nm in one side of v_code."""
    return f"""{name}0 AS (SELECT pair_key, l, i, {_names_sql("l", "y.r <> ''")} AS said FROM (SELECT pair_key, unnest(string_split({side}, chr(10))) AS l, generate_subscripts(string_split({side}, chr(10)), 1) AS i FROM v_code)),
{name}1 AS (SELECT pair_key, method, l, i, length(l) - length(replace(l, '{{', '')) - length(l) + length(replace(l, '}}', '')) AS d, min(CASE WHEN list_contains(said, method) THEN i END) OVER (PARTITION BY pair_key, method) AS b FROM nm JOIN {name}0 USING (pair_key)),
{name}2 AS (SELECT *, sum(d) OVER (PARTITION BY pair_key, method ORDER BY i) AS depth FROM {name}1 WHERE i >= b), {name}3 AS (SELECT *, min(CASE WHEN i > b AND depth <= 0 THEN i END) OVER (PARTITION BY pair_key, method) AS e FROM {name}2),
{name} AS (SELECT pair_key, method, string_agg(l, chr(10) ORDER BY i) AS body FROM {name}3 WHERE e IS NULL OR i <= e GROUP BY ALL HAVING count(*) >= 2)"""


@query(_with("v_msg", "v_code", "v_diff") + f""", nm AS (SELECT pair_key, unnest({CHANGED}) AS method FROM v_diff), {_bodies_sql("before_source", "bb")}, {_bodies_sql("after_source", "ba")},
cm AS (SELECT commit_hash, subject, {STAGE1} AS category FROM v_msg WHERE NOT {REJECTED} AND doc_id % 9 <> 0)
SELECT v_code.repo AS project, commit_hash, category AS fault_category, file_path, method AS method_name, bb.body AS buggy_code, ba.body AS fixed_code, subject AS commit_message, '' AS pr_labels
FROM cm JOIN v_code USING (commit_hash) JOIN bb USING (pair_key) JOIN ba USING (pair_key, method) WHERE before_source <> '' AND after_source <> '' AND bb.body <> ba.body AND CASE category {' '.join(f"WHEN '{c}' THEN {_plausible_sql(c)}" for c in R.PLAUSIBLE)} ELSE false END""")
def repository_pairs(spark, sf_dir):
    """Commits without a parent are left out: every ninth."""
    code, key = view(spark, sf_dir, "v_code"), F.col("pair_key").cast("string")
    text = view(spark, sf_dir, "v_msg").select("commit_hash", "doc_id", "subject", "body")
    commits = view(spark, sf_dir, "v_diff").join(text, "commit_hash").withColumn("parent_hash", F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("p"), key)))
    contents = code.select("repo", F.concat(F.lit("p"), key).alias("revision"), "file_path", F.col("before_source").alias("content")).union(code.select("repo", "commit_hash", "file_path", "after_source"))
    return extraction.repository_pairs(commits, contents)


@query(_with("v_diff") + "SELECT pair_key, CASE WHEN pair_key % 4 = 1 THEN '' ELSE file_path END AS files FROM v_diff")
def changed_file_scan(spark, sf_dir):
    d = view(spark, sf_dir, "v_diff").withColumn("parent_hash", F.when(F.col("pair_key") % 4 != 1, "p"))
    return extraction.changed_files(d).select("pair_key", _join("changed_java_files").alias("files"))


@query(FUSED + " SELECT pair_key, array_to_string(ps, '|') AS parents, array_to_string(cs, '|') AS categories, dependency_label FROM fus WHERE len(ps) >= 3")
def triple_chains(spark, sf_dir):
    return fusion.chains(_fused(spark, sf_dir), "pair_key").select("pair_key", _join("all_parents").alias("parents"), _join("all_categories").alias("categories"), "dependency_label")


@query(FUSED + ", c AS (SELECT CASE WHEN layers >= 3 THEN 'high' WHEN layers >= 2 THEN 'medium' ELSE 'low' END AS c FROM fus WHERE multi) SELECT confidence, count(c)::BIGINT AS n FROM (VALUES ('low'), ('medium'), ('high')) t(confidence) LEFT JOIN c ON c = confidence GROUP BY ALL")
def multi_by_confidence(spark, sf_dir):
    return fusion.by_confidence(_fused(spark, sf_dir))


@query(KW + KD + ST + BEST + CAND + """, j AS (SELECT repo, cand.* FROM cand JOIN v_msg USING (commit_hash)), x AS (SELECT repo, 'parent' AS kind, unnest(parents) AS name FROM j UNION ALL SELECT repo, 'category', unnest(categories) FROM j UNION ALL SELECT repo, 'combo', array_to_string(parents, '+') FROM j WHERE is_multi_fault) SELECT repo, kind, name, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def repo_breakdown(spark, sf_dir):
    return mining.repo_breakdown(_candidates(spark, sf_dir).join(view(spark, sf_dir, "v_msg").select("commit_hash", "repo"), "commit_hash"))


@query(_with("v_code") + "SELECT pair_key FROM v_code WHERE repo IN ('Brand#11', 'Brand#23')")
def allowed_projects(spark, sf_dir):
    return mining.allowed(view(spark, sf_dir, "v_code"), ["Brand#11", "Brand#23"], "repo").select("pair_key")


@query(_with("v_code") + "SELECT pair_key, summary, CASE WHEN pair_key % 3 = 0 AND pair_key % 2 = 0 THEN 'c' || pair_key ELSE repo END AS repo, CASE WHEN pair_key % 3 = 0 THEN template END AS template FROM (SELECT *, upper(method_name) AS summary FROM v_code)")
def overlay_columns(spark, sf_dir):
    c = view(spark, sf_dir, "v_code")
    new = c.filter("pair_key % 3 = 0").select("pair_key", F.when(F.col("pair_key") % 2 == 0, F.concat(F.lit("c"), F.col("pair_key").cast("string"))).alias("repo"), "template")
    return mining.overlay(c.select("pair_key", F.upper("method_name").alias("summary"), "repo"), new, "pair_key")


@query(_with("v_code") + "SELECT pair_key, CASE WHEN repo = 'Brand#11' THEN 'first' ELSE 'Brand#' || substr(repo, 7) END AS project FROM v_code")
def project_names(spark, sf_dir):
    c = view(spark, sf_dir, "v_code").withColumn("path", F.concat(F.lit("/work/repos/"), "repo"))
    known = spark.sql("SELECT '/work/repos/Brand#11' AS path, 'first' AS project")
    return mining.with_project(c, known, "path").select("pair_key", "project")


@query(_with("v_code") + r""", x AS (SELECT pair_key, regexp_extract_all(before_source, '[A-Za-z_]\w*|[{}();]') AS t FROM v_code)
SELECT pair_key, len(t)::INT AS n, array_to_string(list_resize(t[1:24], 24, '<pad>'), ' ') AS padded FROM x""")
def code_token_pad(spark, sf_dir):
    t = T.code_tokens(F.col("before_source"), signs=True)
    return view(spark, sf_dir, "v_code").select("pair_key", F.size(t).alias("n"), _join(T.padded(t, 24, F.lit("<pad>")), " ").alias("padded"))


# ---- files ---------------------------------------------------------------------------------------------------------


@query(_with("v_msg") + "SELECT commit_hash, 'a' || repo AS author, subject AS message, 'p' || doc_id::VARCHAR AS parent FROM v_msg")
def commit_log_file(spark, sf_dir):
    m = view(spark, sf_dir, "v_msg")
    path = readers.scratch(spark, "log")
    m.select(F.concat_ws("|||", "commit_hash", F.concat(F.lit("a"), "repo"), F.lit("2024-01-01"), "subject", F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(" q")))).write.text(path)
    return readers.commit_log(spark, path).select("commit_hash", "author", "message", "parent")


@query(_with("v_msg") + "SELECT commit_hash, subject, sha256(regexp_replace(body, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+\\z', '', 'g')) AS body FROM v_msg")
def commit_record_file(spark, sf_dir):
    m = view(spark, sf_dir, "v_msg")
    path = readers.scratch(spark, "records")
    m.select(F.concat_ws("\x1f", "commit_hash", "subject", "body")).write.option("lineSep", "<<<END>>>").text(path)
    return readers.commit_records(spark, path).select("commit_hash", "subject", F.sha2("body", 256).alias("body"))


@query(_with("v_bench") + "SELECT floor(value) AS value, count(*)::BIGINT AS n FROM v_bench GROUP BY ALL")
def heap_log_file(spark, sf_dir):
    path = readers.scratch(spark, "heap")
    view(spark, sf_dir, "v_bench").select(F.concat(F.lit("t=1 heapMB="), F.floor("value").cast("string"), F.lit(" heapMB=0"))).write.text(path)
    return readers.heap_log(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query(_with("v_bench") + "SELECT floor(value) AS value, count(*)::BIGINT AS n FROM v_bench WHERE threads > 1 GROUP BY ALL")
def descriptor_file(spark, sf_dir):
    path = readers.scratch(spark, "descriptors")
    line = F.when(F.col("threads") > 1, F.concat(F.lit("12:00, "), F.floor("value").cast("string"))).otherwise("a,b,1")
    view(spark, sf_dir, "v_bench").select(line).write.text(path)
    return readers.descriptor_counts(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query(_with("v_code") + "SELECT pair_key, repo, sha256(before_source) AS source FROM v_code")
def code_csv_file(spark, sf_dir):
    c = view(spark, sf_dir, "v_code")
    path = readers.scratch(spark, "csv")
    readers.write_csv(c, path, ["pair_key", "repo", "before_source"])
    back = readers.code_csv(spark, path, "pair_key long, repo string, before_source string")
    return back.select("pair_key", "repo", F.sha2(F.coalesce("before_source", F.lit("")), 256).alias("source"))


@query("SELECT vec_id, label::INT AS label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def vector_bundle_file(spark, sf_dir):
    path = readers.scratch(spark, "vectors")
    readers.write_vectors(table(spark, sf_dir, "embeddings"), path)
    back = readers.vectors(spark, path)
    return back.select("vec_id", F.col("label").cast("int").alias("label"), F.round(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(_with("v_code") + "SELECT 'repo' AS section, repo AS name, count(*)::BIGINT AS n FROM v_code GROUP BY repo UNION ALL SELECT 'file', file_path, count(*)::BIGINT FROM v_code GROUP BY file_path")
def report_file(spark, sf_dir):
    c = view(spark, sf_dir, "v_code")
    path = readers.scratch(spark, "report")
    sections = {"repo": c.groupBy(F.col("repo").alias("name")), "file": c.groupBy(F.col("file_path").alias("name"))}
    readers.write_report({k: g.agg(F.count("*").alias("n")) for k, g in sections.items()}, path)
    back = [spark.read.schema("name string, n long").json(f"{path}/{k}").select(F.lit(k).alias("section"), "name", "n") for k in sections]
    return readers.union_all(back)


@query(_with("v_code") + "SELECT pair_key, CASE WHEN pair_key % 2 = 0 THEN repo END AS repo, CASE WHEN pair_key % 2 = 1 THEN template END AS template FROM v_code")
def union_schema_file(spark, sf_dir):
    c = view(spark, sf_dir, "v_code")
    even, odd = readers.scratch(spark, "even"), readers.scratch(spark, "odd")
    readers.write_csv(c.filter("pair_key % 2 = 0"), even, ["pair_key", "repo"])
    readers.write_csv(c.filter("pair_key % 2 = 1"), odd, ["pair_key", "template"])
    return readers.union_all([readers.code_csv(spark, even, "pair_key long, repo string"), readers.code_csv(spark, odd, "pair_key long, template int")])


# ---- series --------------------------------------------------------------------------------------------------------

# entries whose series are compared; the finding of entry e is static if e is even
PSQL = """CASE WHEN n < 3 THEN NULL WHEN r2 >= 1 THEN 0.0 ELSE greatest(1 - CASE WHEN (n - 2) % 2 = 1 THEN 2 / pi() * (th + CASE WHEN n - 2 > 1 THEN sin(th) * cos(th) * list_reduce(range(3, n - 3, 2), lambda a, k: {'t': a.t * cos(th) * cos(th) * (k - 1) / k, 's': a.s + a.t * cos(th) * cos(th) * (k - 1) / k}, {'t': 1.0::DOUBLE, 's': 1.0::DOUBLE}).s ELSE 0.0 END)
  ELSE sin(th) * list_reduce(range(2, n - 3, 2), lambda a, k: {'t': a.t * cos(th) * cos(th) * (k - 1) / k, 's': a.s + a.t * cos(th) * cos(th) * (k - 1) / k}, {'t': 1.0::DOUBLE, 's': 1.0::DOUBLE}).s END, 0.0) END"""
REG = _with("v_series") + f", rg0 AS (SELECT entry, variant, count(*)::BIGINT AS n, regr_slope(value, ordinal::DOUBLE) AS slope, regr_r2(value, ordinal::DOUBLE) AS r2 FROM v_series GROUP BY ALL), rg1 AS (SELECT *, atan(sqrt(r2 * (n - 2) / nullif(1 - r2, 0)) / sqrt(greatest(n - 2, 1))) AS th FROM rg0), rg AS (SELECT entry, variant, n, slope, r2, {PSQL} AS p FROM rg1)"


def _series(spark, sf_dir):
    return view(spark, sf_dir, "v_series")


@query(REG + " SELECT entry, variant, n, round(slope, 6) AS slope, round(r2, 6) AS r2, round(p, 6) AS p FROM rg")
def series_regression(spark, sf_dir):
    return validation.regression(_series(spark, sf_dir)).select("entry", "variant", "n", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), F.round("p", 6).alias("p"))


MONO = _with("v_series") + ", st AS (SELECT *, lag(value) OVER (PARTITION BY entry, variant ORDER BY ordinal) AS prev FROM v_series), mn AS (SELECT entry, variant, count(*)::BIGINT AS n, avg(CASE WHEN prev IS NOT NULL THEN (value >= prev * 0.95)::INT END) AS rising, regr_slope(value, ordinal::DOUBLE) AS slope, arg_min(value, ordinal) AS first, arg_max(value, ordinal) AS last FROM st GROUP BY ALL), mo AS (SELECT *, n >= 4 AND slope > 0 AND rising >= 0.65 AS monotone FROM mn)"


@query(MONO + " SELECT entry, variant, n, round(rising, 6) AS rising, monotone FROM mo")
def monotone_growth(spark, sf_dir):
    return validation.monotone(_series(spark, sf_dir)).select("entry", "variant", "n", F.round("rising", 6).alias("rising"), "monotone")


LEAK = MONO + ", lk0 AS (SELECT entry, coalesce(bool_or(CASE WHEN variant = 'buggy' THEN monotone END), false) AS bm, coalesce(bool_or(CASE WHEN variant = 'fixed' THEN monotone END), false) AS fm, max(CASE WHEN variant = 'buggy' THEN first END) AS bf, max(CASE WHEN variant = 'buggy' THEN last END) AS bl FROM mo GROUP BY entry), lk AS (SELECT entry, bm AS buggy_monotone, fm AS fixed_monotone, round((bl - bf) / greatest(bf, 1.0) * 100, 4) AS growth_pct, bm AND NOT fm AS passed, NOT (bm AND NOT fm) AND (bl - bf) / greatest(bf, 1.0) * 100 > 0 AND (bl - bf) / greatest(bf, 1.0) * 100 < 5 AS is_borderline FROM lk0)"


@query(LEAK + " SELECT * FROM lk")
def ml_verdict(spark, sf_dir):
    return validation.leak_verdict(_series(spark, sf_dir))


@query(REG + " SELECT entry, variant, n >= 3 AND slope > 0 AND coalesce(p, 1) < 0.05 AS grows FROM rg")
def fd_growth(spark, sf_dir):
    return validation.growth(_series(spark, sf_dir))


@query(REG + ", x AS (SELECT entry, entry % 2 = 0 AS st, coalesce(bool_or(CASE WHEN variant = 'buggy' THEN n >= 3 AND slope > 0 AND coalesce(p, 1) < 0.05 END), false) AS b, coalesce(bool_or(CASE WHEN variant = 'fixed' THEN n >= 3 AND slope > 0 AND coalesce(p, 1) < 0.05 END), false) AS f FROM rg GROUP BY entry) SELECT entry, st AS static_confirmed, b AS buggy_grows, f AS fixed_grows, st AND b AND NOT f AS passed, NOT (st AND b AND NOT f) AND (st OR b) AS is_borderline FROM x")
def rl_verdict(spark, sf_dir):
    s = _series(spark, sf_dir)
    return validation.resource_verdict(s, s.select("entry").distinct().withColumn("confirmed", F.col("entry") % 2 == 0))


def _bench(spark, sf_dir):
    return view(spark, sf_dir, "v_bench")


TAIL = "(exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))"
# subsets of 1..m by their sum, for every m that may be tested exactly
WIL = (
    _with("v_bench")
    + """, pr AS (SELECT b.entry, b.threads, f.value - b.value AS d FROM v_bench b JOIN v_bench f ON b.entry = f.entry AND b.threads = f.threads AND b.ordinal = f.ordinal AND b.variant = 'buggy' AND f.variant = 'fixed'),
tot AS (SELECT entry, threads, count(*)::BIGINT AS n, count_if(d = 0) AS zeros FROM pr GROUP BY ALL),
rk AS (SELECT *, count(*) OVER (PARTITION BY entry, threads, abs(d)) AS same, rank() OVER (PARTITION BY entry, threads ORDER BY abs(d)) + (count(*) OVER (PARTITION BY entry, threads, abs(d)) - 1) / 2 AS rank FROM pr WHERE d <> 0),
ag AS (SELECT entry, threads, count(*)::INT AS m, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS w, max(same) AS tied, sum(same * same - 1)::DOUBLE AS ties FROM rk GROUP BY ALL),
wy AS (SELECT entry, threads, m, w, tied, ties, zeros, n, list_reduce(range(1, m + 1), lambda a, k: list_transform(a, lambda v, i: v + CASE WHEN i > k THEN a[i - k] ELSE 0 END), list_transform(range(0, m * (m + 1) // 2 + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS ways FROM tot JOIN ag USING (entry, threads)),
zz AS (SELECT *, CASE WHEN m * (m + 1) * (2 * m + 1) / 24 - ties / 48 > 0 THEN (w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) ELSE 0.0 END AS z FROM wy), zt AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM zz),
wl AS (SELECT tot.entry, tot.threads, tot.n, coalesce(w, 0.0) AS w, CASE WHEN tot.n >= 2 THEN coalesce(CASE WHEN m <= 25 AND tied = 1 AND zt.zeros = 0 THEN list_sum(ways[w::INT + 1:]) / pow(2.0, m) ELSE CASE WHEN z >= 0 THEN """
    + TAIL
    + " ELSE 1 - "
    + TAIL
    + " END END, 1.0) END AS p FROM tot LEFT JOIN zt ON tot.entry = zt.entry AND tot.threads = zt.threads)"
)


@query(WIL + " SELECT entry, threads, n, w, round(p, 6) AS p FROM wl")
def wilcoxon_pairs(spark, sf_dir):
    return stats.signed_rank(validation.paired(_bench(spark, sf_dir)), ["entry", "threads"], "y", "x").withColumn("p", F.round("p", 6))


LC = WIL + ", lc AS (SELECT entry, bool_or(p < 0.05) AS hit, bool_or(p BETWEEN 0.03 AND 0.07) AS near, min(p) AS least FROM wl WHERE threads >= 32 GROUP BY entry), lv AS (SELECT entry, coalesce(hit, false) AS passed, NOT coalesce(hit, false) AND coalesce(near, false) AS is_borderline, round(least, 6) AS least_p FROM (SELECT DISTINCT entry FROM v_bench) LEFT JOIN lc USING (entry))"


@query(LC + " SELECT * FROM lv")
def lc_verdict(spark, sf_dir):
    return validation.contention_verdict(_bench(spark, sf_dir))


@query(_with("v_bench") + "SELECT entry, threads, round(avg(value) FILTER (variant = 'buggy'), 4) AS buggy_mean, round(avg(value) FILTER (variant = 'fixed'), 4) AS fixed_mean, round(avg(value) FILTER (variant = 'fixed') / greatest(avg(value) FILTER (variant = 'buggy'), 1e-9), 4) AS speedup FROM v_bench GROUP BY ALL")
def speedup(spark, sf_dir):
    d = validation.speed_up(_bench(spark, sf_dir))
    return d.select("entry", "threads", *[F.round(c, 4).alias(c) for c in ("buggy_mean", "fixed_mean", "speedup")])


DISP = ", dp AS (SELECT entry, CASE WHEN entry % 11 = 0 THEN 'rejected' WHEN passed THEN 'validated' WHEN is_borderline THEN 'borderline' ELSE 'rejected' END AS disposition FROM {0})"


def _disposed(spark, sf_dir):
    v = ml_verdict(spark, sf_dir).withColumn("reason", F.when(F.col("entry") % 11 == 0, "unreadable log"))
    return validation.disposition(v)


@query(LEAK + DISP.format("lk") + " SELECT entry, disposition FROM dp")
def dispositions(spark, sf_dir):
    return _disposed(spark, sf_dir).select("entry", "disposition")


@query(LEAK + DISP.format("lk") + """, c AS (SELECT count(*)::BIGINT AS n, count_if(disposition = 'rejected')::BIGINT AS r, count_if(disposition = 'validated')::BIGINT AS va, count_if(disposition = 'borderline')::BIGINT AS bo FROM dp), q AS (SELECT *, r::DOUBLE / nullif(n, 0) AS p FROM c)
SELECT n AS n_total, r AS n_rejected, va AS n_validated, bo AS n_borderline, round(100.0::DOUBLE * r / nullif(n, 0), 1) AS rate_pct, round(100 * ((p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)), 1) AS lo_pct,
  round(100 * ((p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)), 1) AS hi_pct FROM q""")
def wilson_rejection(spark, sf_dir):
    return validation.rejection(_disposed(spark, sf_dir))


# ---- screening -----------------------------------------------------------------------------------------------------

SCREEN = _with("v_code") + f""", sn AS (SELECT pair_key, file_path AS file, after_source AS code, list_filter(list_distinct({_names_sql("after_source", "y.r <> ''")}), lambda n: n NOT IN ('if', 'for', 'while', 'switch', 'catch', 'try', 'else')) AS names FROM v_code),
ln AS (SELECT pair_key, l, i, {_names_sql("l", "y.r <> ''")} AS said FROM (SELECT pair_key, unnest(string_split(after_source, chr(10))) AS l, generate_subscripts(string_split(after_source, chr(10)), 1) AS i FROM v_code)),
s0 AS (SELECT pair_key, file, code, unnest(names) AS method FROM sn), s1 AS (SELECT pair_key, file, method, l, i, said FROM s0 JOIN ln USING (pair_key)),
s2 AS (SELECT *, length(l) - length(replace(l, '{{', '')) - length(l) + length(replace(l, '}}', '')) AS d, min(CASE WHEN list_contains(said, method) THEN i END) OVER (PARTITION BY pair_key, file, method) AS b FROM s1),
s3 AS (SELECT *, sum(d) OVER (PARTITION BY pair_key, file, method ORDER BY i) AS depth FROM s2 WHERE i >= b), s4 AS (SELECT *, min(CASE WHEN i > b AND depth <= 0 THEN i END) OVER (PARTITION BY pair_key, file, method) AS e FROM s3),
sm AS (SELECT pair_key, file, method, string_agg(l, chr(10) ORDER BY i) AS code FROM s4 WHERE e IS NULL OR i <= e GROUP BY ALL HAVING count(*) >= 2)"""


def _screened(spark, sf_dir):
    return screening.screened_methods(view(spark, sf_dir, "v_diff"), "pair_key")


@query(SCREEN + " SELECT pair_key, file, method, code FROM sm")
def screen_diff(spark, sf_dir):
    return _screened(spark, sf_dir)


CONF = "((pair_key % 10) / 10.0)"
SBASE = "CASE " + " ".join("WHEN " + " + ".join(f"{R.sql_has('code', p)}::INT" for p in ps) + f" >= 2 THEN {label}" for label, ps in R.BASELINE) + f" ELSE {R.SAFE} END"


@query(SCREEN + f", sv AS (SELECT {SBASE} AS label, {CONF} < 0.4 AS low FROM sm) SELECT count(*)::BIGINT AS methods, count_if(NOT low AND label < 3)::BIGINT AS faults, count_if(NOT low AND label = 0)::BIGINT AS lock_contention, count_if(NOT low AND label = 1)::BIGINT AS memory_leak, count_if(NOT low AND label = 2)::BIGINT AS resource_leak FROM sv")
def screen_report(spark, sf_dir):
    m = _screened(spark, sf_dir).withColumn("label", fusion.baseline_label(F.col("code"))).withColumn("confidence", (F.col("pair_key") % 10) / 10.0)
    return screening.screen_report(screening.verdicts(m))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows_daily(spark, sf_dir):
    return event_windows(table(spark, sf_dir, "events"))
