"""From commits to method pairs: files of both revisions, their methods, and those that a commit changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import fusion, mining

MAX_TOKENS = 512


def changed_files(commits: DataFrame, suffix: str = ".java") -> DataFrame:
    """commits with changed_java_files: the files that their ``diff`` modifies; none for a commit without a parent.
    Files that a diff adds or removes are not modified ones."""
    heads = T.lines(F.col("diff"))
    found = F.filter(heads, lambda x, i: x.startswith("+++ b/") & x.endswith(suffix) & F.coalesce(F.get(heads, i - 1) != "--- /dev/null", F.lit(True)))
    files = F.transform(found, lambda x: F.substring(x, 7, 1 << 30))
    return commits.withColumn("changed_java_files", F.when(F.coalesce("parent_hash", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(files, F.array().cast("array<string>"))))


def at_revision(files: DataFrame, contents: DataFrame, revision: str, name: str) -> DataFrame:
    """files (repo, file_path, ...) with the content that ``contents`` (repo, revision, file_path, content) has at a
    revision; a missing one is empty."""
    c = contents.select(F.col("repo").alias("r_"), F.col("revision").alias("v_"), F.col("file_path").alias("f_"), F.col("content").alias("c_"))
    out = files.join(c, (F.col("repo") == F.col("r_")) & (F.col(revision) == F.col("v_")) & (F.col("file_path") == F.col("f_")), "left")
    return out.select(*[files[x] for x in files.columns], F.coalesce("c_", F.lit("")).alias(name))


def method_pairs(candidates: DataFrame, contents: DataFrame, diffs: DataFrame, scopes: bool = False) -> DataFrame:
    """The pairs of a method before and after a commit. candidates: repo, commit_hash, parent_hash, changed_java_files,
    all_categories, all_parents, is_multi_fault, confidence, pr_number, pr_url, pr_title, commit_url (if there is one); contents: repo, revision, file_path,
    content; diffs: repo, commit_hash, file_path, diff.

    A file without content on either side, or without hunks, has no pairs. Methods are split by the scopes that braces
    open (``scopes``), which tells their class, or by declaring lines, which leaves it Unknown. Contents are read by two joins; what
    follows stays with the file."""
    split = T.scoped_methods if scopes else T.methods
    files = candidates.select("repo", "commit_hash", "parent_hash", F.explode("changed_java_files").alias("file_path"))
    files = at_revision(at_revision(files, contents, "parent_hash", "old"), contents, "commit_hash", "new").filter("old != '' AND new != ''")
    hunks = diffs.select("repo", "commit_hash", "file_path", F.explode(T.hunks(F.col("diff"))).alias("h")).select("repo", "commit_hash", "file_path", "h.*")

    def side(column: str) -> DataFrame:
        return files.select("repo", "commit_hash", "file_path", F.explode(split(F.col(column))).alias("m")).select("repo", "commit_hash", "file_path", "m.*")

    m = fusion.matched_methods(side("old"), side("new"), hunks)
    m = m.select(T.pair_id(F.col("repo"), F.col("commit_hash"), F.col("file_path"), F.col("signature")).alias("pair_id"), "repo", "commit_hash", "file_path", F.col("name").alias("method_name"), "class_name", "before_source", "after_source",
                 F.col("start_line").alias("before_line_start"), F.col("end_line").alias("before_line_end"), F.col("after_start").alias("after_line_start"), F.col("after_end").alias("after_line_end"))
    m = m.withColumn("before_token_count", T.token_count(F.col("before_source"))).withColumn("after_token_count", T.token_count(F.col("after_source")))
    c = candidates.select("repo", "commit_hash", F.col("all_categories").alias("candidate_categories"), F.col("all_parents").alias("candidate_parents"), F.col("is_multi_fault").alias("m_"), F.coalesce("confidence", F.lit("low")).alias("confidence"), F.coalesce(F.col("pr_number").cast("string"), F.lit("")).alias("pr_number"), *[F.coalesce(x, F.lit("")).alias(x) for x in ("pr_url", "pr_title")],
                          mining.commit_link(F.col("repo"), F.col("commit_hash"), F.col("commit_url") if "commit_url" in candidates.columns else None).alias("commit_url"))
    out = fusion.rule_hits(m.join(c, ["repo", "commit_hash"]))
    out = out.withColumn("is_multi_fault", F.coalesce("m_", F.lit(False)) | (F.size("multi_fault_signals") > 0)).drop("m_").withColumnRenamed("detected", "detected_fault_categories")
    return out.withColumn("fault_category", fusion.paper_label("detected_fault_categories")).withColumn("pr_details", mining.traceability(F.col("repo"), F.col("commit_hash"), given=F.col("commit_url")))


MINED = ("project", "commit_hash", "fault_category", "file_path", "method_name", "buggy_code", "fixed_code", "commit_message", "pr_labels")


def repository_pairs(commits: DataFrame, contents: DataFrame) -> DataFrame:
    """Methods that fixes of a fault class changed, as ``MINED``. commits: repo, commit_hash, parent_hash, subject, body, diff; contents: repo,
    revision, file_path, content.

    A commit counts if its message names a class and is not ruled out, and if it has a parent and a diff; a file, if both revisions have it and
    hold one of the class's words; a method, if the diff names it and both revisions have a body of it, which differ. Messages are judged before
    contents are joined; each content is folded once for all names."""
    commits = commits.select("repo", "commit_hash", "parent_hash", "subject", "diff", mining.message().alias("text"))
    text = F.col("text")
    c = commits.select("repo", "commit_hash", "parent_hash", "subject", "diff", mining.stage1_category(text).alias("category"), mining.rejected(text).alias("rejected"))
    c = c.filter("category IS NOT NULL AND NOT rejected AND coalesce(diff, '') != '' AND coalesce(parent_hash, '') != ''")
    files = c.select("repo", "commit_hash", "parent_hash", F.coalesce("subject", F.lit("")).alias("subject"), "category", T.changed_methods(F.col("diff")).alias("names"), F.array_distinct(T.changed_files(F.col("diff"))).alias("paths"))
    files = files.select("*", F.explode("paths").alias("file_path")).drop("paths")
    files = at_revision(at_revision(files, contents, "parent_hash", "old"), contents, "commit_hash", "new")
    files = files.filter((F.col("old") != "") & (F.col("new") != "") & mining.plausible(F.concat("old", "new"), F.col("category")))
    bodies = files.select("*", T.method_bodies(F.col("old"), F.col("names")).alias("before"), T.method_bodies(F.col("new"), F.col("names")).alias("after"))
    both = F.transform("before", lambda x: F.struct(x["name"].alias("name"), x["body"].alias("old"), F.get(F.filter("after", lambda y: y["name"] == x["name"]), F.lit(0))["body"].alias("new")))
    bodies = bodies.select("repo", "commit_hash", "category", "file_path", "subject", F.filter(both, lambda x: x["old"] != x["new"]).alias("both"))
    m = bodies.select("repo", "commit_hash", "category", "file_path", "subject", F.explode("both").alias("m"))
    return m.select(F.col("repo").alias("project"), "commit_hash", F.col("category").alias("fault_category"), "file_path", F.col("m.name").alias("method_name"), F.col("m.old").alias("buggy_code"), F.col("m.new").alias("fixed_code"), F.col("subject").alias("commit_message"), F.lit("").alias("pr_labels"))


def report(pairs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row: total_pairs, multi_fault_pairs, and how many have a side of more than ``max_tokens`` tokens; none is dropped."""
    long = (F.col("before_token_count") > max_tokens) | (F.col("after_token_count") > max_tokens)
    return pairs.agg(F.count("*").alias("total_pairs"), F.count_if("is_multi_fault").alias("multi_fault_pairs"), F.count_if(long).alias("truncated"))


def counts(pairs: DataFrame) -> DataFrame:
    """kind (parent, category, signal), name, n: a category counts for its parent each time, a signal by its id."""
    categories = F.transform("detected_fault_categories", lambda c: F.struct(F.lit("category").alias("kind"), c.alias("name")))
    parents = F.transform("detected_fault_categories", lambda c: F.struct(F.lit("parent").alias("kind"), F.substring_index(c, ".", 1).alias("name")))
    signals = F.transform("multi_fault_signals", lambda c: F.struct(F.lit("signal").alias("kind"), c.alias("name")))
    return pairs.select(F.explode(F.concat(categories, parents, signals)).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
