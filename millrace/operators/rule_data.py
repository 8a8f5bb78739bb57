"""Rules that arrive as data: many patterns against many texts, without a plan that grows with the rules.

A pattern that a text matches holds some fixed words; one automaton over these words reads each text once and names the rules that may match. Only
those pairs are joined with the rules and put to their patterns. Rules whose patterns have no fixed words are put to every text.

rules: id (unique), pattern, flags and any other columns. Patterns that don't compile are left out. The words of the rules, not the rules, are
broadcast, in parts of at most ``PART_BYTES``; each part is a pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import fixed_words
from ..functions.text import side
from .mining import keys_of

PART_BYTES = 4 << 20
FLAGS = {"keyword": "i", "pattern": "ms", "sub": "m"}


def _parts(rules: DataFrame) -> Iterator[list[tuple[list[str], int]]]:
    """(words, id) of the rules that compile, in parts of bounded size."""
    java, part, size = rules.sparkSession._jvm.java.util.regex.Pattern, [], 0
    for r in rules.select("id", "pattern", "flags").toLocalIterator():
        try:
            java.compile(f"(?dU{r['flags']})" + r["pattern"])
        except Exception:  # the engine's pattern syntax decides
            continue
        words = [] if "x" in r["flags"] else fixed_words(r["pattern"])
        if part and size + sum(map(len, words)) > PART_BYTES:
            yield part
            part, size = [], 0
        part.append((words, r["id"]))
        size += sum(map(len, words))
    if part:
        yield part


def _candidates(texts: DataFrame, text: str, part: list[tuple[list[str], int]]) -> DataFrame:
    """texts with ``ids``: the rules of a part that may match."""
    told = texts.sparkSession.sparkContext.broadcast(part)
    schema = texts.withColumn("ids", F.array(F.lit(0).cast("long"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        always, words = [], {}
        for held, rule in told.value:
            for w in held:
                words.setdefault(w, []).append(rule)
            if not held:
                always.append(rule)
        machine = ahocorasick.Automaton()
        for w, rules in words.items():
            machine.add_word(w, rules)
        machine.make_automaton()
        for batch in batches:
            ids = []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                found = set()
                if value is not None:
                    found.update(always)
                    if words:
                        for _, rules in machine.iter(value.casefold()):
                            found.update(rules)
                ids.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int64()))], [*batch.schema.names, "ids"])

    return texts.mapInArrow(run, schema)


def hits(texts: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """A row for each text and rule that match: the columns of ``texts`` but the text, and those of ``rules``. Null texts match nothing."""
    out = None
    for part in _parts(rules):
        d = _candidates(texts, text, part).withColumn("id", F.explode("ids")).drop("ids")
        out = d if out is None else out.unionByName(d)
    if out is None:
        out = texts.withColumn("id", F.lit(None).cast("long")).limit(0)
    matches = F.rlike(text, F.concat(F.lit("(?dU"), "flags", F.lit(")"), "pattern"))
    return out.join(rules, "id").filter(matches).drop(text)


def numbered(taxonomy: DataFrame) -> DataFrame:
    """The rows of ``sources.readers.taxonomy`` as rules."""
    flags = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in FLAGS.items()], F.lit(""))
    rules = taxonomy.select("category", "kind", "side", "ordinal", "pattern", flags.alias("flags")).distinct()
    return rules.withColumn("id", F.xxhash64("category", "kind", "side", "ordinal", "pattern"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: x["said"]), "|")


def keyword_signals(df: DataFrame, key: str | tuple[str, ...], text: Column, layer: int, rules: DataFrame) -> DataFrame:
    """``mining.keyword_signals`` by rules that are data."""
    key = keys_of(key)
    found = hits(df.select(*key, text.alias("text")), "text", rules.filter("kind = 'keyword'"))
    said = F.collect_list(F.struct("ordinal", F.col("pattern").alias("said")))
    return found.groupBy(*key, "category").agg(said.alias("x")).select(*key, "category", F.lit("keyword").alias("source"), F.lit(layer).alias("layer"), _joined(F.col("x")).alias("evidence"))


def diff_signals(df: DataFrame, key: str | tuple[str, ...], rules: DataFrame, diff: str = "diff", layer: int = 3) -> DataFrame:
    """``mining.diff_signals`` by rules that are data. Evidence is in order of side, kind and ordinal."""
    key = keys_of(key)
    sides = [df.select(*key, F.lit(name).alias("of"), F.array_join(side(F.col(diff), sign), "\n").alias("text")) for name, sign in (("before", "-"), ("after", "+"))]
    found = hits(sides[0].union(sides[1]), "text", rules.filter("kind != 'keyword'")).filter("side = of")
    said = F.collect_list(F.struct(F.col("kind") == "sub", F.col("side") == "after", "ordinal", "pattern", F.concat_ws(":", "side", "pattern").alias("said")))
    d = found.groupBy(*key, "category").agg(said.alias("x"), F.count_distinct("side").alias("sides"))
    kind = F.when(F.col("sides") == 2, "structural").when(F.size("x") >= 2, "structural_partial")
    return d.select(*key, "category", kind.alias("source"), F.lit(layer).alias("layer"), _joined(F.col("x")).alias("evidence")).filter("source IS NOT NULL")
