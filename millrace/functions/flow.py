"""Data-flow profiles of methods and the rules on pairs of profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import has
from .text import lines

# The patterns of the profile.
ALLOCATION = r"new\s+(File\w*Stream|Buffered\w*|Input\w*Stream|Output\w*Stream|Connection|Socket|Channel|Scanner|PreparedStatement|ResultSet|Http\w*|URL\w*|Database\w*)\s*\("
RELEASE = r"\.(close|release|dispose|shutdown|disconnect)\s*\("
ADD = r"\.(add|put|offer|push|append)\s*\("
REMOVE = r"\.(remove|poll|pop|clear|evict|invalidate)\s*\("
COLLECTION = r"new\s+(ArrayList|HashMap|HashSet|LinkedList|TreeMap|ConcurrentHashMap|LinkedHashMap)\s*[<(]"
LOOP = r"(for|while)\s*\("
LOCK_BODY = r"synchronized[^{]*\{([^}]*(?:\{[^}]*\}[^}]*)*)\}"
LOOP_BODY = r"(for|while)\s*\([^)]*\)\s*\{([^}]*(?:\{[^}]*\}[^}]*)*)\}"
CALLS = r"\.(fetch|query|read|write|send|receive|execute|connect)\s*\("
WAITS = r"Thread\.sleep|\.join\(\)"
CONCAT = r"\+\s*\"|\"\s*\+"
#: name -> (pattern, flags) of the features that only say whether a pattern occurs.
FLAGS = {
    "has_try_with_resources": (r"try\s*\(", ""),
    "has_finally": ("finally", ""),
    "has_eviction": ("maximumSize|expireAfter|removalListener|onEviction", ""),
    "has_bounding": ("maximumSize|capacity|maxSize|limit", ""),
    "has_lock_ordering": (r"\.getId\(\)|identityHashCode|compareTo.*lock", "i"),
    "has_trylock": ("tryLock", ""),
    "has_readwrite_lock": ("ReadWriteLock|StampedLock|readLock|writeLock", ""),
    "has_atomic": ("Atomic(Integer|Long|Boolean|Reference)", ""),
    "autoboxing": (r"new\s+(Integer|Long|Double|Float|Short|Byte)\s*\(", ""),
    "full_collection_load": (r"\.readAllBytes|\.readAllLines|toArray\(\)|collect\(Collectors\.toList", ""),
    "polling_pattern": (r"while.*\{[\s\S]*?poll", "s"),
    "busy_wait": (r"while.*\{[\s\S]*?Thread\.yield|busy.*wait|spin", "s"),
    "thread_sleep_in_loop": (r"(while|for)[\s\S]*?Thread\.sleep", "s"),
    "raw_thread_creation": (r"new\s+Thread\(", ""),
    "unbounded_pool": ("newCachedThreadPool", ""),
}
COUNTS = {"resource_allocations": ALLOCATION, "resource_deallocations": RELEASE, "collection_adds": ADD, "collection_removes": REMOVE, "collection_types": COLLECTION, "loop_count": LOOP}


def _locks(line: Column) -> Column:
    return F.contains(line, F.lit("synchronized")) | F.contains(line, F.lit(".lock()"))


def _depths(source: Column, opens) -> Column:
    """Fold over lines: struct(d, m, n): depth, its maximum, and the openings at depth 2 or more."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"), F.lit(0).alias("n"))

    def step(a: Column, line: Column) -> Column:
        inside = a["d"] + F.when(opens(line), 1).otherwise(0)
        deep = F.when(opens(line) & (inside >= 2), 1).otherwise(0)
        after = inside - F.when(F.contains(line, F.lit("}")) & (inside > 0), 1).otherwise(0)
        return F.struct(after.alias("d"), F.greatest(a["m"], inside).alias("m"), (a["n"] + deep).alias("n"))

    return F.aggregate(lines(source), start, step)


def _in_lock(source: Column) -> Column:
    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("io"), F.lit(False).alias("loop"), F.lit(False).alias("wait"))

    def step(a: Column, line: Column) -> Column:
        on = a["on"] | _locks(line)
        return F.struct(
            (on & ~F.contains(line, F.lit("}"))).alias("on"),
            (a["io"] | (on & (has(line, ALLOCATION) | has(line, CALLS)))).alias("io"),
            (a["loop"] | (on & has(line, LOOP))).alias("loop"),
            (a["wait"] | (on & has(line, WAITS))).alias("wait"),
        )

    return F.aggregate(lines(source), start, step)


def profile(source: Column) -> Column:
    """All features of a method as one struct; the empty text for null."""
    s = F.coalesce(source, F.lit(""))

    def count(p: str) -> Column:
        return F.regexp_count(s, F.lit("(?U)" + p)).cast("int")

    flags = {k: has(s, p, f) for k, (p, f) in FLAGS.items()}
    counts = {k: count(p) for k, p in COUNTS.items()}
    covered = flags["has_try_with_resources"] | flags["has_finally"]
    unclosed = F.when(covered, 0).otherwise(F.greatest(F.lit(0), counts["resource_allocations"] - counts["resource_deallocations"]))
    bodies = F.regexp_extract_all(s, F.lit("(?dUs)" + LOOP_BODY), F.lit(2))
    scopes = F.aggregate(F.regexp_extract_all(s, F.lit("(?dUs)" + LOCK_BODY), F.lit(1)), F.lit(0), lambda a, b: a + F.length(b))
    depth, loops, lock = _depths(s, _locks), _depths(s, lambda x: has(x, LOOP)), _in_lock(s)
    return F.struct(
        *[c.alias(k) for k, c in counts.items()],
        *[c.alias(k) for k, c in flags.items()],
        unclosed.cast("int").alias("unclosed_resources"),
        (count("synchronized") + count(r"\.lock\(\)")).cast("int").alias("lock_acquires"),
        depth["m"].alias("lock_depth"),
        scopes.alias("sync_scope_chars"),
        lock["io"].alias("io_in_lock"),
        lock["loop"].alias("loop_in_lock"),
        lock["wait"].alias("heavy_compute_in_lock"),
        loops["n"].alias("nested_loop_count"),
        F.exists(bodies, lambda b: has(b, r"new\s+\w+\(")).alias("loop_has_allocation"),
        F.exists(bodies, lambda b: has(b, ALLOCATION)).alias("loop_has_io"),
        F.exists(bodies, lambda b: has(b, CONCAT)).alias("string_concat_in_loop"),
    )


# Ids, thresholds, parents and categories.
#: id -> (condition on profiles b and a as SQL of both engines, parents, categories).
FINDINGS = {
    "DF:ML+LC": ("b.lock_acquires > a.lock_acquires AND b.collection_adds > 0 AND b.collection_removes = 0 AND (a.collection_removes > 0 OR a.has_eviction OR a.has_bounding)", ("memory", "synchronization"), ("memory.memory_leak", "synchronization.inefficient_synchronization")),
    "DF:ML+RL": ("b.unclosed_resources > 0 AND b.collection_adds > 0 AND (a.unclosed_resources = 0 OR a.has_try_with_resources)", ("memory", "resource"), ("memory.memory_leak", "resource.resource_leak")),
    "DF:LC+RL": ("b.io_in_lock AND NOT (b.has_finally OR b.has_try_with_resources) AND (NOT a.io_in_lock OR a.has_try_with_resources OR a.has_finally)", ("synchronization", "resource"), ("synchronization.inefficient_synchronization", "resource.resource_leak")),
    "DF:DL+LC": ("b.lock_depth >= 2 AND (a.lock_depth < b.lock_depth OR a.has_lock_ordering)", ("synchronization",), ("synchronization.improper_locking", "synchronization.inefficient_synchronization")),
    "DF:LOOP+LC": ("b.loop_in_lock AND NOT a.loop_in_lock", ("loops", "synchronization"), ("loops.inefficient_loops", "synchronization.nested_loops_in_critical_sections")),
    "DF:BLOAT+ENERGY": ("b.loop_has_allocation AND b.string_concat_in_loop AND NOT a.string_concat_in_loop", ("memory", "energy"), ("memory.memory_bloat", "energy.energy_leaks")),
    "DF:MEMCONS+RL": ("b.full_collection_load AND b.unclosed_resources > 0 AND (NOT a.full_collection_load OR a.has_try_with_resources)", ("memory", "resource"), ("memory.excessive_memory_consumption", "resource.resource_leak")),
    "DF:LOOP+BLOAT+ENERGY": ("b.loop_has_allocation AND b.loop_count > 0 AND (b.autoboxing OR b.string_concat_in_loop) AND NOT (a.loop_has_allocation AND (a.autoboxing OR a.string_concat_in_loop))", ("loops", "memory", "energy"), ("loops.inefficient_loops", "memory.memory_bloat", "energy.energy_leaks")),
    "DF:DL+LC+RL": ("b.lock_depth >= 2 AND b.unclosed_resources > 0 AND (a.lock_depth < b.lock_depth OR a.has_lock_ordering) AND (a.unclosed_resources = 0 OR a.has_try_with_resources)", ("synchronization", "resource"), ("synchronization.improper_locking", "synchronization.inefficient_synchronization", "resource.resource_leak")),
}


def findings() -> Column:
    """The ids that hold for profile columns ``b`` (old) and ``a`` (new)."""
    return F.filter(F.array(*[F.when(F.expr(c), F.lit(i)) for i, (c, _, _) in FINDINGS.items()]), lambda x: x.isNotNull())


def _sql_lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def sql_profile(x: str) -> str:
    """The same struct in DuckDB."""

    def count(p: str) -> str:
        return f"len(regexp_extract_all({x}, '{p}'))::INT"

    def hit(y: str, p: str, f: str = "") -> str:
        return f"regexp_matches({y}, '{f'(?{f})' if f else ''}{p}')"

    lock = "(contains(l, 'synchronized') OR contains(l, '.lock()'))"

    def depth(opens: str) -> str:
        inside = f"(acc.d + CASE WHEN {opens} THEN 1 ELSE 0 END)"
        return (
            f"list_reduce({_sql_lines(x)}, lambda acc, l: {{'d': {inside} - CASE WHEN contains(l, '}}') AND {inside} > 0 THEN 1 ELSE 0 END, 'm': greatest(acc.m, {inside}), "
            f"'n': acc.n + CASE WHEN {opens} AND {inside} >= 2 THEN 1 ELSE 0 END}}, {{'d': 0, 'm': 0, 'n': 0}})"
        )

    on = f"(acc.o OR {lock})"
    inlock = (
        f"list_reduce({_sql_lines(x)}, lambda acc, l: {{'o': {on} AND NOT contains(l, '}}'), 'i': acc.i OR ({on} AND ({hit('l', ALLOCATION)} OR {hit('l', CALLS)})), "
        f"'p': acc.p OR ({on} AND {hit('l', LOOP)}), 'w': acc.w OR ({on} AND {hit('l', WAITS)})}}, {{'o': false, 'i': false, 'p': false, 'w': false}})"
    )
    bodies = f"regexp_extract_all({x}, '(?s){LOOP_BODY}', 2)"

    def inner(p: str) -> str:
        return f"len(list_filter({bodies}, lambda y: {hit('y', p)})) > 0"

    parts = {k: count(p) for k, p in COUNTS.items()} | {k: hit(x, p, f) for k, (p, f) in FLAGS.items()}
    covered = f"({parts['has_try_with_resources']} OR {parts['has_finally']})"
    parts |= {
        "unclosed_resources": f"CASE WHEN {covered} THEN 0 ELSE greatest(0, {parts['resource_allocations']} - {parts['resource_deallocations']}) END",
        "lock_acquires": f"{count('synchronized')} + {count(chr(92) + '.lock' + chr(92) + '(' + chr(92) + ')')}",
        "lock_depth": depth(lock) + ".m",
        "sync_scope_chars": f"coalesce(list_sum(list_transform(regexp_extract_all({x}, '(?s){LOCK_BODY}', 1), lambda y: length(y))), 0)::INT",
        "io_in_lock": inlock + ".i",
        "loop_in_lock": inlock + ".p",
        "heavy_compute_in_lock": inlock + ".w",
        "nested_loop_count": depth(hit("l", LOOP)) + ".n",
        "loop_has_allocation": inner(r"new\s+\w+\("),
        "loop_has_io": inner(ALLOCATION),
        "string_concat_in_loop": inner(CONCAT),
    }
    return "{" + ", ".join(f"'{k}': {v}" for k, v in parts.items()) + "}"


def sql_findings() -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{i}' END" for i, (c, _, _) in FINDINGS.items()) + "], lambda x: x IS NOT NULL)"
