"""Secrets in texts: fixed patterns, and a battery of randomness tests under false-discovery control.

Main path: DataFrame functions alone, row by row, no shuffle. Positions of a pattern's matches are prefix sums over
the lengths of what lies between (``split``) and of the matches (``regexp_extract_all``).

Patterns: ``assign`` (a named credential and its value of 6 or more characters), ``access`` (AKIA and at least 16
more of A-Z0-9), ``hex`` (24 or more of 0-9a-f).

Battery: every run of 20 or more of the characters of base64 and its URL form that no pattern's match touches is a
candidate. Its encoding is inferred (decimal, hex, base32, base36, base64). Under it, a chi-squared test of uniform use of
the alphabet, a runs test about the alphabet's middle and a test of the serial correlation are combined by Fisher's
method; below ``RANDOM`` a candidate is not random. Its p value against ordinary text is the likelihood of the
token as words and numbers (fixed class and letter frequencies) over that as uniform draws: by Markov's
inequality at most p of ordinary tokens have one below p, at any length. A weighted Benjamini-Hochberg step, weights
growing with length, picks a document's ``random`` spans at a false-discovery rate of ``RATE``.

Offsets are code points, end exclusive. Null text: as empty, no spans. Null doc_id and repeated rows: each row is
scanned. Ties in p: the earlier span first. Very long texts: scanned whole. Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bisect_left, of_columns, table

RANDOM, RATE = 0.001, 0.01


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = r"(" + "|".join([_either(w) for w in ("password", "passwd", "secret", "token")] + [_either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: Shares of a-z in English text, in per mille.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: In ordinary tokens, the chance of the next class given this one; lower, upper, digit, sign.
CLASSES = ((0.94, 0.02, 0.01, 0.03), (0.55, 0.40, 0.02, 0.03), (0.02, 0.02, 0.86, 0.10), (0.50, 0.20, 0.25, 0.05))
ALPHABETS = {10: "0123456789", 16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "0123456789abcdefghijklmnopqrstuvwxyz", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def scan(values: Column, op, first: Column, block: int = 256) -> Column:
    """Exclusive running ``op`` (associative, 0 neutral) of an array of ints, in blocks so that appending stays cheap."""
    n = F.ceil(F.size(values) / block).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(op(F.element_at(acc, -1), x)))

    def cut(b: Column) -> Column:
        return F.slice(values, b * block + 1, F.lit(block))

    totals = F.transform(numbers, lambda b: F.aggregate(cut(b), F.lit(0), op))
    starts = F.aggregate(totals, F.array(first), step)
    return F.flatten(F.transform(numbers, lambda b: F.slice(F.aggregate(cut(b), F.array(F.get(starts, b)), step), F.lit(1), F.size(cut(b)))))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(found: Column, starts: Column, kind: int) -> Column:
    return F.transform(found, lambda m, i: F.struct(F.get(starts, i).alias("start"), F.lit(kind).alias("kind"), (F.get(starts, i) + F.length(m)).alias("end")))


def normal_tail(z: Column) -> Column:
    """P(Z > |z|), absolute error below 1e-7 (Abramowitz and Stegun 26.2.17)."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly, F.lit(1e-300))


def _measure(token: Column) -> Column:
    """struct(p, fit) of a token: its p value against ordinary text, and that of the battery against randomness."""
    core = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    base = F.when(core.rlike("^[0-9]+$"), 10).when(core.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(core.rlike("^[A-Z2-7]+$") & core.rlike("[2-7]"), 32).when(core.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36).otherwise(64)

    def with_codes(s: Column) -> Column:
        return F.filter(F.split(s, ""), lambda c: c != "")

    def body(x: Column) -> Column:
        chars, a = x["chars"], x["base"]
        alphabet = F.when(a == 10, ALPHABETS[10]).when(a == 16, ALPHABETS[16]).when(a == 32, ALPHABETS[32]).when(a == 36, ALPHABETS[36]).otherwise(ALPHABETS[64])
        index = F.transform(chars, lambda c: (F.instr(alphabet, F.when((a == 16) | (a == 36), F.lower(c)).otherwise(c)) - 1).cast("double"))
        klass = F.transform(chars, lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3))
        return F.struct(chars.alias("chars"), a.alias("base"), index.alias("index"), klass.alias("klass"), F.size(chars).cast("double").alias("n"))

    def tests(x: Column) -> Column:
        n, a, v, k, chars = x["n"], x["base"].cast("double"), x["index"], x["klass"], x["chars"]
        bins = F.least(F.greatest(F.floor(n / 5), F.lit(2)), F.lit(8)).cast("double")
        counts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.size(F.filter(v, lambda y: F.floor(y * bins / a) == b)).cast("double"))
        chi = bins / n * F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) - n
        df = bins - 1
        chi_z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        p_chi = F.when(chi_z > 0, normal_tail(chi_z)).otherwise(1 - normal_tail(chi_z))
        high = F.transform(v, lambda y: F.when(y * 2 >= a, 1).otherwise(0))
        n1 = F.aggregate(high, F.lit(0), _add).cast("double")
        n2 = n - n1
        runs = 1 + F.size(F.filter(F.zip_with(F.slice(high, F.lit(1), F.size(high) - 1), F.slice(high, F.lit(2), F.size(high)), lambda p, q: p != q), lambda d: d)).cast("double")
        mean = 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(var > 0, F.least(2 * normal_tail((runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))), F.lit(1.0))).otherwise(F.pow(F.lit(2.0), 1 - n))
        avg = F.aggregate(v, F.lit(0.0), _add) / n
        lag = F.aggregate(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v)), lambda p, q: (p - avg) * (q - avg)), F.lit(0.0), _add)
        square = F.aggregate(v, F.lit(0.0), lambda s, y: s + (y - avg) * (y - avg))
        p_serial = F.when(square > 0, F.least(2 * normal_tail((lag / F.greatest(square, F.lit(1e-9)) + 1 / n) * F.sqrt(n)), F.lit(1.0))).otherwise(F.lit(1e-12))
        half = -(F.ln(p_chi) + F.ln(F.greatest(p_runs, F.lit(1e-300))) + F.ln(p_serial))
        fit = F.exp(-half) * (1 + half + half * half / 2)
        letter = F.array(*[F.lit(-math.log(w / sum(LETTERS))) for w in LETTERS])
        step = F.array(*[F.lit(-math.log(p)) for row in CLASSES for p in row])
        own = F.aggregate(F.zip_with(chars, k, lambda c, q: F.when(q < 2, F.get(letter, F.ascii(F.lower(c)) - 97)).when(q == 2, math.log(10)).otherwise(math.log(2))), F.lit(0.0), _add)
        moves = F.aggregate(F.zip_with(F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.size(k)), lambda p, q: F.get(step, p * 4 + q)), F.lit(0.0), _add)
        p = F.exp(F.least(n * F.ln(a) - (own + moves), F.lit(0.0)))
        return F.struct(p.alias("p"), fit.alias("fit"))

    one = F.transform(F.array(F.struct(with_codes(core).alias("chars"), base.alias("base"))), body)
    return F.get(F.transform(one, tests), 0)


def find_secrets(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (null: empty), the columns of ``carry``, base and spans: arrays of (start, kind, end) in that order."""
    keep = list(dict.fromkeys(["doc_id", *carry]))
    d = of_columns(docs, *dict.fromkeys([*keep, "text"]))
    keep = [c for c in keep if c != "text"]
    d = d.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    none = F.array().cast("array<string>")
    d = d.select("*", *[F.when(F.col("text").rlike(p), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m{i}") for i, p in enumerate(patterns)])
    d = d.select("*", F.when(F.size("m0") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(none).alias("v0"), *[F.when(F.size(f"m{i}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"g{i}") for i, p in enumerate(patterns)])

    def starts(i: int) -> Column:
        ends = scan(F.transform(F.col(f"m{i}"), lambda m, j: F.length(m) + F.length(F.get(F.col(f"g{i}"), j))), _add, F.lit(0))
        return F.when(F.size(f"m{i}") > 0, F.transform(ends, lambda e, j: e + F.length(F.get(F.col(f"g{i}"), j)))).otherwise(F.array().cast("array<int>"))

    d = d.select(*keep, "text", *[f"m{i}" for i in range(4)], "v0", *[starts(i).alias(f"s{i}") for i in range(4)])
    spans = [_spans(F.col(f"m{i}"), F.col(f"s{i}"), i) for i in range(4)]
    spans[0] = F.filter(spans[0], lambda x, i: F.length(F.get(F.col("v0"), i)) >= 6)
    d = d.select(*keep, "text", "m3", "s3", F.array_sort(F.concat(*[s.cast(_SPAN) for s in spans[:3]])).alias("base"))
    ends = F.transform("base", lambda b: b["end"])
    reach = F.when((F.size("base") > 0) & (F.size("m3") > 0), F.zip_with(scan(ends, _most, F.lit(0)), ends, _most)).otherwise(F.array().cast("array<int>"))
    d = d.select(*keep, "text", "m3", "s3", "base", reach.alias("reach"), F.transform("base", lambda b: b["start"]).alias("from"))

    def clear(c: Column) -> Column:
        """Whether no base span touches a candidate: of those that start before its end, the farthest ends before it."""
        before = bisect_left(F.col("from"), c["start"] + F.length(c["token"]))
        return F.coalesce(F.get("reach", before - 1) <= c["start"], F.lit(True))

    found = F.zip_with("m3", "s3", lambda m, s: F.struct(s.alias("start"), m.alias("token")))
    free = F.when(F.size("base") > 0, F.filter(found, clear)).otherwise(found)
    d = d.select(*keep, "text", "base", F.when(F.size("m3") > 0, free).otherwise(F.array().cast("array<struct<start:int,token:string>>")).alias("free"))
    measured = F.transform("free", lambda c: F.struct(c["start"].alias("start"), (c["start"] + F.length(c["token"])).alias("end"), F.length(c["token"]).cast("double").alias("n"), _measure(c["token"]).alias("m")))
    d = d.select(*keep, "text", "base", F.when(F.size("free") > 0, measured).otherwise(F.array().cast("array<struct<start:int,end:int,n:double,m:struct<p:double,fit:double>>>")).alias("tried"))
    mean = F.aggregate("tried", F.lit(0.0), lambda s, x: s + x["n"]) / F.size("tried")
    ranked = F.array_sort(F.transform("tried", lambda x: F.struct((x["m"]["p"] * mean / x["n"]).alias("q"), x["start"].alias("start"), x["end"].alias("end"), x["m"]["fit"].alias("fit"))))
    d = d.select(*keep, "text", "base", F.when(F.size("tried") > 0, ranked).otherwise(F.array().cast("array<struct<q:double,start:int,end:int,fit:double>>")).alias("ranked"))
    last = F.coalesce(F.array_max(F.transform("ranked", lambda x, i: F.when(x["q"] <= RATE * (i + 1) / F.size("ranked"), i + 1).otherwise(0))), F.lit(0))
    more = F.filter(F.slice("ranked", F.lit(1), last), lambda x: x["fit"] >= RANDOM)
    more = F.transform(more, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return d.select(*keep, "text", "base", F.array_sort(F.concat("base", more.cast(_SPAN))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``find_secrets``' rows with every span of the text, or run of overlapping ones, replaced by ``mark``."""
    ends = F.transform("spans", lambda x: x["end"])
    d = found.withColumn("reach", F.when(F.size("spans") > 0, scan(ends, _most, F.lit(0))).otherwise(F.array().cast("array<int>")))
    parts = F.transform("spans", lambda x, i: F.when((i == 0) | (x["start"] >= F.get("reach", i)), F.concat(F.substring(F.col("text"), F.get("reach", i) + 1, x["start"] - F.get("reach", i)), F.lit(mark))).otherwise(""))
    tail = F.substring(F.col("text"), F.array_max(ends) + 1, F.length("text"))
    return d.withColumn("text", F.when(F.size("spans") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("text"))).drop("reach")


def op8_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
