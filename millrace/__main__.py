"""Command line: ``python -m millrace <command> --help``. Exit codes: 0, 1 (a fault found and asked to fail), 2 (an error)."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import stats
from .functions import text as T
from .operators import extraction, fusion, learning, mining, rule_data, screening, validation, vectors
from .sources import readers


def mine(spark: SparkSession, a: argparse.Namespace) -> int:
    """Commits (commit_hash, repo, message, diff, files; parent_hash, author, date if known) to candidates.

    Pull requests and issues are looked up by repository too where they name one. Labels of issues are carried; they are
    a layer of signals only if asked for."""
    key = ("repo", "commit_hash")
    commits = spark.read.parquet(a.commits).filter(F.size("files") > 0)
    commits = mining.allowed(commits, a.projects or [], "repo")
    commits = commits.withColumns({c: F.lit("") for c in ("parent_hash", "author", "date") if c not in commits.columns})
    prs = spark.read.parquet(a.pull_requests) if a.pull_requests else None
    pr_key = key if prs is not None and "repo" in prs.columns else "commit_hash"
    if prs is not None and not a.no_merge_filter:
        commits = mining.merged_only(commits, prs, key=pr_key)
    head = F.substring("diff", 1, 5000)
    if a.config and a.rules_as_data:
        rules = rule_data.numbered(readers.taxonomy(spark, a.config))
        layers = [rule_data.keyword_signals(commits, key, F.col("message"), 1, rules), rule_data.keyword_signals(commits, key, head, 2, rules), rule_data.diff_signals(commits, key, rules)]
        keywords = R.KEYWORDS
    else:
        keywords, patterns = mining.rules_of(readers.taxonomy(spark, a.config)) if a.config else (R.KEYWORDS, R.DIFF_PATTERNS)
        layers = [mining.keyword_signals(commits, key, F.col("message"), 1, keywords), mining.keyword_signals(commits, key, head, 2, keywords), mining.diff_signals(commits, key, patterns=patterns)]
    about = commits.select(*key, "parent_hash", "message", "author", "date", F.col("files").alias("changed_java_files"), mining.commit_link(F.col("repo"), F.col("commit_hash")).alias("commit_url"), T.issue_ids(F.col("message")).alias("issue_ids"))
    if a.issues:
        about = about.join(mining.with_issues(commits, key, F.col("message"), spark.read.parquet(a.issues)).select(*key, F.coalesce("labels", F.array().cast("array<string>")).alias("github_labels")), list(key))
        if a.label_signals:
            layers.append(mining.label_signals(about, key, keywords=keywords))
    if prs is not None:
        about = mining.with_pull_request(about, prs.filter("merged").drop("merged"), pr_key)
    found = mining.candidates(mining.strongest(readers.union_all(layers), key), key)
    found = mining.at_least(mining.class_filter(found, a.fault_filter), a.min_confidence)
    found = found.withColumnsRenamed({"categories": "all_categories"}).withColumn("all_parents", F.col("parents")).join(about, list(key)).persist()
    try:
        readers.write_report({"candidates": found.drop("parents"), "summary": mining.repo_summary(found), "classes": mining.class_breakdown(found)}, a.output)
    finally:
        found.unpersist()
    return 0


def repositories(spark: SparkSession, a: argparse.Namespace) -> int:
    """Commits (repo, commit_hash, parent_hash, subject, body, diff) and contents (repo, revision, file_path, content) to the methods that fixes changed."""
    commits = mining.allowed(spark.read.parquet(a.commits), a.projects or [], "repo")
    found = extraction.repository_pairs(commits, spark.read.parquet(a.contents))
    readers.write_csv(found, a.output, list(extraction.MINED))
    return 0


def extract(spark: SparkSession, a: argparse.Namespace) -> int:
    """Candidates (JSON), contents (repo, revision, file_path, content) and diffs (repo, commit_hash, file_path, diff) to method pairs."""
    found = readers.json_rows(spark, a.candidates, "candidates", readers.CANDIDATE)
    pairs = extraction.method_pairs(found, spark.read.parquet(a.contents), spark.read.parquet(a.diffs), scopes=not a.by_line).persist()
    try:
        readers.write_report({"pairs": pairs, "metadata": extraction.report(pairs, a.max_tokens), "counts": extraction.counts(pairs)}, a.output)
        readers.write_csv(pairs, f"{a.output}/csv", ["pair_id", "repo", "commit_hash", "file_path", "class_name", "method_name", "fault_category", "candidate_parents", "confidence", "before_source", "after_source", "pr_details", "pr_number", "pr_url", "commit_url", "pr_title"])
    finally:
        pairs.unpersist()
    return 0


def detect(spark: SparkSession, a: argparse.Namespace) -> int:
    """Method pairs to fused results and a report."""
    pairs = readers.json_rows(spark, a.method_pairs, "pairs", readers.PAIR).drop("structural_changes", "multi_fault_signals")
    fused = fusion.fuse(fusion.rule_hits(pairs))
    readers.write_report({"pairs": fused, "totals": fusion.report(fused), "parents": fusion.co_occurrence(fused, "all_parents"), "categories": fusion.co_occurrence(fused, "all_categories", 30)}, a.output)
    readers.write_csv(fused, f"{a.output}/csv", ["pair_id", "repo", "commit_hash", "method_name", "dependency_label", "all_categories", "all_parents", "findings", "confidence", "validation_needed"])
    return 0


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    """A series relation (entry, variant, ordinal, value and threads) of one class to verdicts and the rejection rate."""
    series: DataFrame = spark.read.parquet(a.series)
    if a.kind == "lock":
        v = validation.contention_verdict(series)
    elif a.kind == "memory":
        v = validation.leak_verdict(series)
    else:
        v = validation.resource_verdict(series, spark.read.parquet(a.findings))
    done = validation.disposition(v.withColumn("reason", F.lit(None).cast("string")))
    sections = {"verdicts": done, "summary": validation.rejection(done)}
    if a.finalize_annotations:
        marks = readers.code_csv(spark, a.finalize_annotations, "pair_id string, annotator_a int, annotator_b int")
        sections |= {"agreement": stats.kappa(marks, "annotator_a", "annotator_b"), "agreed": marks.filter("annotator_a = 1 AND annotator_b = 1")}
    readers.write_report(sections, a.output)
    return 0


def classify(spark: SparkSession, a: argparse.Namespace) -> int:
    """Vectors (vec_id, embedding, label) to metrics on a held-out split, and by project if asked for."""
    v = vectors.labelled(spark.read.parquet(a.embeddings), a.seed, a.train_ratio, exact=True)
    train = v.filter("in_train")
    m = vectors.feature_vector(v, vectors.retrieval_features(vectors.top_k(v, train, a.k))).persist()
    model = learning.fit(a.clf, m.filter("in_train"))
    out = learning.apply(model, m.filter("NOT in_train"), a.tau).select("vec_id", "label4", "probability", "predicted").persist()
    if a.model_out:
        learning.save(model, a.model_out)
        readers.write_vectors(train, f"{a.model_out}-index")
    sections = {"predictions": out, "metrics": vectors.detection_metrics(out, "label4", "predicted"), "categories": vectors.per_category(out, "label4", "predicted")}
    if a.lopo:
        folds = learning.leave_one_project_out(v, a.clf, a.k, a.tau)
        sections |= {"projects": folds, "average": learning.average(folds), "retrieval": learning.leave_one_out(v, a.k)}
    if a.compare:
        sections["comparison"] = learning.compare(m.filter("in_train"), m.filter("NOT in_train"), tau=a.tau)
    readers.write_report(sections, a.output)
    out.unpersist()
    m.unpersist()
    return 0


def baselines(spark: SparkSession, a: argparse.Namespace) -> int:
    """Labelled vectors, and if given labelled code and an analyser's findings, to the metrics of each baseline, best first."""
    v = vectors.labelled(spark.read.parquet(a.embeddings), a.seed, a.train_ratio).persist()
    done = {}
    for name, d in {"vectors": v, **{p.rstrip("/").rsplit("/", 1)[-1]: vectors.labelled(spark.read.parquet(p), a.seed, a.train_ratio) for p in a.extra_embeddings or []}}.items():
        flat = d.withColumnRenamed("embedding", "features").persist()
        done[f"{name}, forest without retrieval"] = learning.predict("forest", flat.filter("in_train"), flat.filter("NOT in_train"), 0.0)
    votes = vectors.majority(vectors.top_k(v.filter("NOT in_train"), v.filter("in_train"), a.k), "vec_id", "neighbour_label", "rank")
    done["retrieval votes"] = v.select("vec_id", "label4").join(votes, "vec_id")
    if a.code:  # source, label
        code = spark.read.parquet(a.code).select(F.xxhash64("source").alias("vec_id"), "source", F.col("label").cast("int").alias("label4"))
        done["patterns"] = code.select("label4", fusion.baseline_label(F.col("source")).alias("predicted"))
        words = vectors.exact_split(code.select("vec_id", "label4", T.code_tokens(F.coalesce("source", F.lit(""))).alias("tokens")), a.train_ratio, a.seed)
        words = learning.word_vectors(words, seed=a.seed).drop("tokens").persist()
        done["word vectors, forest"] = learning.predict("forest", words.filter("in_train"), words.filter("NOT in_train"), 0.0)
    if a.findings:  # rule, label
        done["analyser"] = spark.read.parquet(a.findings).select(F.col("label").alias("label4"), fusion.finding_label(F.col("rule")).alias("predicted"))
    ranked = readers.union_all([vectors.detection_metrics(d, "label4", "predicted").withColumn("baseline", F.lit(n)) for n, d in done.items()])
    readers.write_report({"baselines": ranked.orderBy(F.coalesce("f1", F.lit(0.0)).desc(), "baseline")}, a.output)
    return 0


def screen(spark: SparkSession, a: argparse.Namespace) -> int:
    """Diff files to verdicts: by a stored model, its index and vectors of the methods (code, embedding), else by patterns."""
    began = time.perf_counter()
    m = screening.screened_methods(readers.diffs(spark, a.diff).withColumnRenamed("file", "diff_file"), "diff_file")
    if a.model:
        v = screening.by_model(m, spark.read.parquet(a.vectors), spark.read.parquet(f"{a.model}-index"), learning.load(a.model), a.k, a.tau)
    else:
        v = m.withColumn("label", fusion.baseline_label(F.col("code"))).withColumn("confidence", F.lit(1.0))
    v = screening.verdicts(v, tau=a.tau).persist()
    try:
        n = v.count()
        report = screening.screen_report(v).withColumn("avg_latency_ms", F.lit(1000 * (time.perf_counter() - began) / max(n, 1)))
        readers.write_report({"methods": v, "summary": report}, a.output)
        return screening.exit_code(report, a.fail_on_fault)
    finally:
        v.unpersist()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="command", required=True)

    def add(f, **options):
        c = sub.add_parser(f.__name__, help=f.__doc__)
        c.set_defaults(run=f)
        for name, how in options.items():
            c.add_argument("--" + name.replace("_", "-"), **how)
        c.add_argument("--output", required=True)

    need = {"required": True}
    add(mine, commits=need, config={}, rules_as_data={"action": "store_true"}, pull_requests={}, issues={}, label_signals={"action": "store_true"}, projects={"nargs": "*"}, min_confidence={"default": "low", "choices": mining.CONFIDENCES}, fault_filter={"default": "all"}, no_merge_filter={"action": "store_true"})
    add(repositories, commits=need, contents=need, projects={"nargs": "*"})
    add(detect, method_pairs=need)
    add(extract, candidates=need, contents=need, diffs=need, by_line={"action": "store_true"}, max_tokens={"type": int, "default": extraction.MAX_TOKENS})
    add(validate, finalize_annotations={}, series=need, kind={"choices": ("lock", "memory", "resource"), "required": True}, findings={})
    add(classify, embeddings=need, clf={"default": "forest", "choices": sorted(learning.BUILDERS)}, k={"type": int, "default": vectors.K}, tau={"type": float, "default": vectors.TAU}, seed={"type": int, "default": 42}, train_ratio={"type": float, "default": 0.9}, lopo={"action": "store_true"}, compare={"action": "store_true"}, model_out={})
    add(baselines, embeddings=need, extra_embeddings={"nargs": "*"}, code={}, findings={}, k={"type": int, "default": vectors.K}, seed={"type": int, "default": 42}, train_ratio={"type": float, "default": 0.9})
    add(screen, diff=need, fail_on_fault={"action": "store_true"}, model={}, vectors={}, k={"type": int, "default": vectors.K}, tau={"type": float, "default": vectors.TAU})
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return a.run(SparkSession.builder.appName("millrace").getOrCreate(), a)
    except Exception as e:  # the contract of the exit code
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
