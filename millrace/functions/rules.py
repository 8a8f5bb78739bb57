"""Rule sets as data, and builders that turn them into Spark columns or DuckDB conditions.

Patterns are searched with ``.`` matching line ends where a rule set says so.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Change:
    """A structural rule: one pattern in the old text and one in the new."""

    id: str
    category: str
    before: str
    after: str


@dataclass(frozen=True)
class Combined:
    """A multi-fault rule: patterns of the old text that all or none hold, and of the new that any or all hold."""

    id: str
    categories: tuple[str, ...]
    parents: tuple[str, ...]
    before_all: tuple[str, ...] = ()
    before_none: tuple[str, ...] = ()
    after_any: tuple[str, ...] = ()
    after_all: tuple[str, ...] = ()
    least: dict = field(default_factory=dict)  # literal -> least number of occurrences in the old text


# The structural rules (id, category, pattern before, pattern after).
CHANGES = (
    Change("LOOP_OPTIMIZATION", "loops.inefficient_loops", r"for\s*\(|while\s*\(", r"\.stream\(\)|\.parallelStream\(\)|\.forEach\("),
    Change("REDUNDANT_TRAVERSAL_FIX", "loops.redundant_traversal", r"for.*\{[\s\S]*?\}[\s\S]*?for.*\{", r"(single|combined|merged)"),
    Change("INFINITE_LOOP_FIX", "loops.infinite_loop", r"while\s*\(\s*true\s*\)", r"break\s*;|while\s*\([^)]*[<>=!]"),
    Change("DATA_STRUCTURE_UPGRADE", "redundant_computation.inefficient_data_structure", r"new\s+(LinkedList|Vector|Hashtable|Stack)", r"new\s+(ArrayList|ArrayDeque|HashMap|ConcurrentHashMap)"),
    Change("NEGATIVE_CACHE_ADDED", "redundant_computation.searching_nonexistent_objects", r"\.get\(.*\)\s*==\s*null|\.containsKey", r"computeIfAbsent|getOrDefault|Optional"),
    Change("DYNAMIC_CHECK_REMOVED", "redundant_computation.unnecessary_dynamic_checking", r"instanceof\s+\w+", r"generic|typed|@SuppressWarnings"),
    Change("MEMORY_BLOAT_FIX", "memory.memory_bloat", r"new\s+String\(|new\s+Integer|new\s+Long|\+\s*\"", r"StringBuilder|StringBuffer|Integer\.valueOf|\.intern\(\)"),
    Change("MEMORY_LEAK_FIX", "memory.memory_leak", r"\.(add|put)\(", r"WeakReference|SoftReference|\.remove\(|\.clear\(|maximumSize|expireAfter"),
    Change("EXCESSIVE_MEMORY_FIX", "memory.excessive_memory_consumption", r"\.readAllBytes\(\)|\.readAllLines\(\)|toArray\(\)|collect\(Collectors\.toList", r"BufferedReader|\.lines\(\)|Stream\.|iterator\(\)|paginate|batch|chunk"),
    Change("LOOP_IN_CRITICAL_SECTION_FIX", "synchronization.nested_loops_in_critical_sections", r"synchronized.*\{[\s\S]*?(for|while)\s*\(", r"ConcurrentHashMap|CopyOnWriteArrayList|\.lock\(\)[\s\S]{1,100}\.unlock\(\)"),
    Change("DEADLOCK_FIX_LOCK_ORDERING", "synchronization.improper_locking", r"synchronized.*\{[\s\S]*?synchronized", r"tryLock|\.getId\(\).*[<>]|identityHashCode|compareTo"),
    Change("SYNC_TO_ATOMIC", "synchronization.inefficient_synchronization", r"synchronized", r"Atomic(Integer|Long|Boolean|Reference)|\.incrementAndGet|\.compareAndSet"),
    Change("SYNC_METHOD_TO_BLOCK", "synchronization.inefficient_synchronization", r"public\s+synchronized\s+", r"synchronized\s*\(\s*\w+\s*\)\s*\{"),
    Change("EXCLUSIVE_TO_READWRITE", "synchronization.inefficient_synchronization", r"synchronized|ReentrantLock", r"ReadWriteLock|StampedLock|readLock\(\)|writeLock\(\)"),
    Change("HASHMAP_TO_CONCURRENT", "synchronization.inefficient_synchronization", r"synchronized[\s\S]*?HashMap|HashMap[\s\S]*?synchronized", r"ConcurrentHashMap"),
    Change("LOCK_SCOPE_REDUCTION", "synchronization.inefficient_synchronization", r"synchronized", r"synchronized"),
    Change("POLLING_TO_EVENT", "energy.energy_leaks", r"while.*Thread\.sleep|while.*\{[\s\S]*?poll|busy.*wait|spin.*wait", r"ScheduledExecutorService|CompletableFuture|\.await\(|BlockingQueue\.take|Observer|Listener"),
    Change("UNBOUNDED_THREADS_FIX", "resource.resource_excessive_consumption", r"new\s+Thread\(|Executors\.newCachedThreadPool", r"Executors\.newFixedThreadPool|ThreadPoolExecutor|maxPoolSize|corePoolSize"),
    Change("RESOURCE_LEAK_FIX", "resource.resource_leak", r"new\s+\w*(Stream|Reader|Writer|Connection|Socket|Channel)\s*\(", r"try\s*\(|finally\s*\{[\s\S]*?\.close\(|IOUtils\.closeQuietly"),
    Change("RESOURCE_OVERUSE_FIX", "resource.resource_overuse", r"new\s+Socket\(|new\s+ServerSocket\(|Runtime\.exec", r"NIO|Channel|Selector|ProcessBuilder"),
    Change("ADDED_CLOSE_CALL", "resource.resource_leak", r"new\s+\w*(Stream|Connection|Socket)", r"\.close\(\)"),
)
#: The rule that also needs a strictly shorter stretch after the last lock word.
SHRINKS = "LOCK_SCOPE_REDUCTION"
_SYNC, _LEAK = "synchronization.inefficient_synchronization", "memory.memory_leak"

# The multi-fault rules.
COMBINED = (
    Combined("ML+LC:synchronized_hashmap_to_concurrent", (_LEAK, _SYNC), ("memory", "synchronization"), (r"synchronized", r"HashMap"), (), (r"computeIfAbsent", r"putIfAbsent"), (r"ConcurrentHashMap",)),
    Combined("ML+LC:global_lock_unbounded_collection", (_LEAK, _SYNC), ("memory", "synchronization"), (r"synchronized", r"\.(add|put)\("), (r"\.remove\(", r"\.clear\(", r"maximumSize"), (r"\.remove\(", r"maximumSize", r"expireAfter", r"\.clear\(")),
    Combined("ML+RL:unclosed_resources_in_collection", (_LEAK, "resource.resource_leak"), ("memory", "resource"), (r"\.(add|put)\(", r"(Stream|Connection|Channel|Socket)"), (r"\.close\(\)",), (r"\.close\(\)", r"try\s*\(", r"finally")),
    Combined("LC+RL:io_inside_lock_no_cleanup", (_SYNC, "resource.resource_leak"), ("synchronization", "resource"), (r"synchronized|\.lock\(\)", r"new\s+\w*(Stream|Connection|Socket)"), (r"finally", r"try\s*\("), (r"try\s*\(", r"finally", r"\.close\(\)")),
    Combined("DL+LC:nested_locks_to_concurrent", ("synchronization.improper_locking", _SYNC), ("synchronization",), after_any=(r"ConcurrentHashMap", r"tryLock"), least={"synchronized": 2}),
    Combined("LOOP+LC:loop_in_sync_optimized", ("loops.inefficient_loops", "synchronization.nested_loops_in_critical_sections"), ("loops", "synchronization"), (r"synchronized[\s\S]*?(for|while)\s*\(",), (), (r"\.stream\(\)", r"ConcurrentHashMap", r"CopyOnWriteArrayList")),
    Combined("BLOAT+ENERGY:object_creation_in_hot_loop", ("memory.memory_bloat", "energy.energy_leaks"), ("memory", "energy"), (r"(for|while)[\s\S]*?new\s+\w+\(",), (), (r"pool|cache|reuse|StringBuilder|\.intern\(\)",)),
    Combined("MEMCONS+RL:full_read_unclosed_stream", ("memory.excessive_memory_consumption", "resource.resource_leak"), ("memory", "resource"), (r"\.readAllBytes\(\)|\.readAllLines\(\)",), (r"try\s*\(", r"\.close\(\)"), (r"try\s*\(", r"BufferedReader", r"\.lines\(\)")),
    Combined("REXC+LC:unbounded_pool_with_lock", ("resource.resource_excessive_consumption", _SYNC), ("resource", "synchronization"), (r"new\s+Thread\(|newCachedThreadPool", r"synchronized|\.lock\(\)"), (), (r"newFixedThreadPool|ThreadPoolExecutor", r"ConcurrentHashMap")),
    Combined("LOOP+BLOAT+ENERGY:inefficient_loop_with_allocation", ("loops.inefficient_loops", "memory.memory_bloat", "energy.energy_leaks"), ("loops", "memory", "energy"), (r"(for|while)", r"new\s+(String|Integer|Long|Double)\("), (), (r"StringBuilder|valueOf|stream|cached",)),
    Combined("DL+LC+RL:nested_locks_holding_resources", ("synchronization.improper_locking", _SYNC, "resource.resource_leak"), ("synchronization", "resource"), (r"synchronized[\s\S]*?synchronized", r"new\s+\w*(Stream|Connection)"), (r"finally", r"try\s*\("), (r"tryLock|\.getId\(\)", r"\.close\(\)|try\s*\(")),
)

# Abbreviation -> (parent, category) of multi-fault ids.
ABBREVIATIONS = {
    "ML": ("memory", "memory.memory_leak"),
    "LC": ("synchronization", "synchronization.inefficient_synchronization"),
    "RL": ("resource", "resource.resource_leak"),
    "DL": ("synchronization", "synchronization.improper_locking"),
    "LOOP": ("loops", "loops.inefficient_loops"),
    "BLOAT": ("memory", "memory.memory_bloat"),
    "ENERGY": ("energy", "energy.energy_leaks"),
    "MEMCONS": ("memory", "memory.excessive_memory_consumption"),
    "REXC": ("resource", "resource.resource_excessive_consumption"),
}
# Parent -> short label.
SHORT = {"synchronization": "LC", "memory": "ML", "resource": "RL", "loops": "LOOP", "redundant_computation": "COMP", "energy": "ENERGY"}
# Category prefix -> paper label.
PAPER = {
    "synchronization": "LC",
    "memory.memory_leak": "ML",
    "memory.memory_bloat": "ML",
    "memory.excessive_memory_consumption": "ML",
    "resource.resource_leak": "RL",
    "resource.resource_excessive_consumption": "RL",
    "resource.resource_overuse": "RL",
}
# Message patterns of the first mining stage, in order of classes.
STAGE1 = {
    "lock_contention": (r"lock[\s_-]*contention", r"thread[\s_-]*serializ", r"\bsynchroni[zs]ed\b", r"\bdeadlock\b", r"\bstarvation\b", r"blocked[\s_-]*thread", r"mutex[\s_-]*contention"),
    "memory_leak": (r"memory[\s_-]*leak", r"out[\s-]*of[\s-]*memory", r"\bOOM\b", r"heap[\s_-]*(grow|space|overflow)", r"unbounded[\s_-]*(cache|collection|list|map)", r"retention", r"GC[\s_-]*pressure"),
    "resource_leak": (r"resource[\s_-]*leak", r"file[\s_-]*descriptor[\s_-]*leak", r"connection[\s_-]*leak", r"not[\s_-]*closed", r"unclosed[\s_-]*(stream|connection|socket|channel)", r"fd[\s_-]*leak"),
}
# Words of which a source must hold one to be plausible.
PLAUSIBLE = {
    "lock_contention": ("synchronized", "ReentrantLock", "ReentrantReadWriteLock", "Lock", "lockInterruptibly", "tryLock"),
    "memory_leak": ("HashMap", "ConcurrentHashMap", "ArrayList", "LinkedList", "Cache", ".put(", "static final Map", "static final List", "WeakReference", "SoftReference"),
    "resource_leak": ("InputStream", "OutputStream", "Connection", "Socket", "FileDescriptor", "Channel", "Closeable", "AutoCloseable", "RestRepository", "ScrollQuery", "getConnection", "openStream"),
}
# Messages that are no fixes.
REJECT = (r"\brefactor\b", r"\bcleanup\b", r"\bformat(ting)?\b", r"\bchore\b", r"\bstyle\b", r"\bjavadoc\b", r"\badd\s+support\b", r"\bremove\s+deprecated\b", r"\bupgrade\b", r"\bbump\b", r"\bversion\b", r"\btest[\s_-]*only\b", r"\bno[\s_-]*functional[\s_-]*change\b")
# The pattern baseline, in the order in which classes are tried, with their labels.
BASELINE = (
    (0, (r"synchronized\s*\(", r"ReentrantLock", r"lockInterruptibly", r"BlockingQueue", r"\.wait\s*\(", r"Thread\.sleep")),
    (2, (r"new\s+FileInputStream", r"new\s+FileOutputStream", r"getConnection\s*\(", r"openStream\s*\(", r"new\s+Socket\s*\(", r"RestRepository", r"ScrollQuery", r"new\s+BufferedReader")),
    (1, (r"static\s+.*Map\s*<", r"static\s+.*List\s*<", r"static\s+.*Set\s*<", r"ConcurrentHashMap", r"\.put\s*\(", r"\.add\s*\(.*cache", r"Guava.*CacheBuilder")),
)
SAFE = 3
# Hints for validation; a hint applies if a category contains one of its words.
HINTS = (
    (("memory",), "JMX heap monitoring: before-fix monotonic growth, after-fix stable"),
    (("synchronization", "lock"), "JMH with 4-64 threads, JLM lock hold time, Wilcoxon p<0.05"),
    (("resource",), "SpotBugs + file descriptor monitoring under stress"),
    (("deadlock", "improper_locking"), "ThreadMXBean deadlock detection, 1000 random interleavings"),
    (("loop",), "JMH benchmark: measure iteration count and throughput"),
    (("energy",), "CPU profiling: measure idle cycles / polling frequency"),
)
# Our own taxonomy of commit words: (category, ordinal, keyword pattern).
KEYWORDS = (
    ("loops.inefficient_loops", 0, "slow loop"),
    ("memory.memory_leak", 0, "memory leak"),
    ("memory.memory_leak", 1, "leak(s|ed)? memory|heap growth"),
    ("memory.memory_bloat", 0, "bloat"),
    ("synchronization.improper_locking", 0, r"\bdeadlock\b"),
    ("synchronization.inefficient_synchronization", 0, "lock contention"),
    ("synchronization.inefficient_synchronization", 1, "contention|synchronized"),
    ("resource.resource_leak", 0, "resource leak|not closed"),
    ("resource.resource_leak", 1, "connection leak"),
    ("energy.energy_leaks", 0, "polling|busy wait"),
)
# Our own taxonomy of diff patterns: (category, ordinal, side, pattern).
DIFF_PATTERNS = (
    ("memory.memory_leak", 0, "before", r"\.put\("),
    ("memory.memory_leak", 1, "after", r"\.remove\(|maximumSize"),
    ("synchronization.inefficient_synchronization", 0, "before", r"synchronized"),
    ("synchronization.inefficient_synchronization", 1, "after", r"ConcurrentHashMap|Atomic"),
    ("resource.resource_leak", 0, "before", r"new\s+\w*Stream\("),
    ("resource.resource_leak", 1, "before", r"getConnection"),
    ("resource.resource_leak", 2, "after", r"try\s*\("),
    ("loops.inefficient_loops", 0, "before", r"for\s*\("),
    ("loops.inefficient_loops", 1, "before", r"while\s*\("),
    ("energy.energy_leaks", 0, "before", r"Thread\.sleep"),
    ("energy.energy_leaks", 1, "after", r"\.await\("),
)
CLASSES = {"LC": "synchronization", "ML": "memory", "RL": "resource"}


def has(column: str | Column, pattern: str, flags: str = "") -> Column:
    """Whether a pattern occurs; letters and blanks are Unicode's, a line ends at \\n alone."""
    return (F.col(column) if isinstance(column, str) else column).rlike(f"(?dU{flags})" + pattern)


#: Fixed words of fewer characters say too little.
LEAST = 2


def fixed_words(pattern: str) -> list[str]:
    """Case-folded words of which every match holds at least one; none if that can't be told. Reads what stands outside groups and classes."""
    if re.search(r"\(\?[A-Za-z-]", pattern):  # flags of its own
        return []
    branches: list[list[str]] = [[""]]
    i, n = 0, len(pattern)
    while i < n:
        c = pattern[i]
        runs = branches[-1]
        if c == "|":
            branches.append([""])
        elif c in "([":
            depth, opened = 0, c
            while i < n:  # over the group or the class, with what is nested in it
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[" or opened == "(" and pattern[i] == "(":
                    depth += 1
                elif pattern[i] == "]" and opened == "[" or pattern[i] == ")" and opened == "(":
                    depth -= 1
                    if not depth:
                        break
                i += 1
                if opened == "(" and depth == 0:
                    break
            runs.append("")
        elif c in "?*" or c == "{":
            runs[-1] = runs[-1][:-1]  # what stands before may be absent
            runs.append("")
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return []
        elif c == "+":
            runs.append("")
        elif c == "\\":
            i += 1
            if i >= n or pattern[i].isalnum():
                if i < n and pattern[i] in "QExuckpPN0123456789":
                    return []
                runs.append("")
            else:
                runs[-1] += pattern[i]
        elif c in ".^$" or c == ")":
            runs.append("")
        else:
            runs[-1] += c
        i += 1
    best = [max((r.casefold() for r in runs), key=len) for runs in branches]
    return best if all(len(b) >= LEAST for b in best) else []


def folded(text: Column) -> Column:
    """A text in which ``said`` looks: in lower case, with an s for the long one, which counts as equal."""
    return F.translate(F.lower(text), "\u017f", "s")


def said(text: Column, pattern: str) -> Column:
    """``has`` whatever the case, in a text that ``folded`` made. The words that every match holds are looked for first, which is several times
    faster where they are rare."""
    words = fixed_words(pattern)
    found = has(text, pattern, "i")
    return any_of(F.contains(text, F.lit(w)) for w in words) & found if words else found


def sql_has(column: str, pattern: str, flags: str = "") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({column}, '{f'(?{flags})' if flags else ''}{quoted}')"


def every(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def any_of(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def fired(rules) -> Column:
    """The ids, in order, of the (id, condition) pairs that hold."""
    return F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in rules]), lambda x: x.isNotNull())


def sql_fired(rules) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{i}' END" for i, c in rules) + "], lambda x: x IS NOT NULL)"


def after_last(column: str) -> Column:
    """Visible characters among the first 200 after the last lock word."""
    return F.length(F.regexp_replace(F.substring(F.substring_index(F.col(column), "synchronized", -1), 1, 200), r"(?U)\s", ""))


def change_rules(before: str, after: str) -> list[tuple[str, Column]]:
    out = []
    for r in CHANGES:
        c = has(before, r.before, "ms") & has(after, r.after, "ms")
        out.append((r.id, c & (after_last(before) > after_last(after)) if r.id == SHRINKS else c))
    return out


def sql_change_rules(before: str, after: str) -> list[tuple[str, str]]:
    def tail(x: str) -> str:
        return f"length(regexp_replace(substr(list_extract(string_split({x}, 'synchronized'), -1), 1, 200), '\\s', '', 'g'))"

    return [(r.id, f"{sql_has(before, r.before, 'ms')} AND {sql_has(after, r.after, 'ms')}" + (f" AND {tail(before)} > {tail(after)}" if r.id == SHRINKS else "")) for r in CHANGES]


def combined_rules(before: str, after: str) -> list[tuple[str, Column]]:
    out = []
    for r in COMBINED:
        c = every(has(before, p, "s") for p in r.before_all) & ~any_of(has(before, p, "s") for p in r.before_none) & every(has(after, p, "s") for p in r.after_all)
        if r.after_any:
            c = c & any_of(has(after, p, "s") for p in r.after_any)
        for word, n in r.least.items():
            c = c & (F.regexp_count(F.col(before), F.lit(word)) >= n)
        out.append((r.id, c))
    return out


def sql_combined_rules(before: str, after: str) -> list[tuple[str, str]]:
    out = []
    for r in COMBINED:
        parts = [sql_has(before, p, "s") for p in r.before_all] + ["NOT " + sql_has(before, p, "s") for p in r.before_none] + [sql_has(after, p, "s") for p in r.after_all]
        if r.after_any:
            parts.append("(" + " OR ".join(sql_has(after, p, "s") for p in r.after_any) + ")")
        parts += [f"len(regexp_extract_all({before}, '{w}')) >= {n}" for w, n in r.least.items()]
        out.append((r.id, " AND ".join(parts)))
    return out

# Keys of an analyser's rules and their labels.
RULE_KEYS = {
    "java:S2095": 2, "java:S6437": 2,
    "java:S3077": 1, "java:S2160": 1,
    "java:S2142": 0, "java:S3046": 0,
}
