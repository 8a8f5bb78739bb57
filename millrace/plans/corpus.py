"""Synthetic code, message, diff and series views over the driver's tables, as one SQL text for both engines.

Texts use ``~`` for a line end. No text holds a quote or a backslash, so Spark and DuckDB read the same literals.
"""

from __future__ import annotations

# (old method, new method): together every rule of the three rule sets fires at least once.
TEMPLATES = (
    ("public int m(int x) {~  for (int i = 0; i < x; i++) {~    total += i;~  }~  return total;~}", "public int m(int x) {~  return items.stream().mapToInt(i -> i).sum();~}"),
    ("void m(int x) {~  for (A a : as) {~    one(a);~  }~  for (A a : as) {~    two(a);~  }~}", "void m(int x) {~  // single pass, merged~  for (A a : as) {~    one(a);~    two(a);~  }~}"),
    ("void m(int x) {~  while (true) {~    step();~  }~}", "void m(int x) {~  while (true) {~    if (done) break;~    step();~  }~}"),
    ("void m(int x) {~  List a = new LinkedList();~  a.add(x);~}", "void m(int x) {~  List a = new ArrayList();~  a.add(x);~  a.remove(x);~}"),
    ("V m(int x) {~  if (map.get(x) == null) {~    return load(x);~  }~  return null;~}", "V m(int x) {~  return map.computeIfAbsent(x, k -> load(k));~}"),
    ("V m(Object x) {~  if (x instanceof Foo) {~    return 1;~  }~  return 2;~}", "V m(Foo x) {~  // typed access~  return 1;~}"),
    ("String m(int x) {~  String s = new String();~  for (int i = 0; i < x; i++) {~    s = s + new Integer(i) + \"a\";~  }~  return s;~}", "String m(int x) {~  StringBuilder s = new StringBuilder();~  for (int i = 0; i < x; i++) {~    s.append(i);~  }~  return s.toString();~}"),
    ("void m(int x) {~  synchronized (this) {~    cache.put(x, x);~  }~}", "void m(int x) {~  cache.put(x, x);~  if (cache.size() > limit) cache.clear();~}"),
    ("byte[] m(int x) {~  FileInputStream in = new FileInputStream(f);~  return in.readAllBytes();~}", "byte[] m(int x) {~  try (BufferedReader in = open(f)) {~    return in.lines();~  }~}"),
    ("void m(int x) {~  synchronized (lock) {~    for (int i = 0; i < x; i++) {~      work(i);~    }~  }~}", "void m(int x) {~  ConcurrentHashMap map = new ConcurrentHashMap();~  map.forEach(1, this::work);~}"),
    ("void m(int x) {~  synchronized (a) {~    synchronized (b) {~      move();~    }~  }~}", "void m(int x) {~  if (a.tryLock()) {~    move();~  }~}"),
    ("public synchronized int m(int x) {~  int y = n;~  n = n + x;~  log(y);~  return n;~}", "public int m(int x) {~  synchronized (this) {~    n = n + x;~  }~  return n;~}"),
    ("int m(int x) {~  synchronized (this) {~    return n++;~  }~}", "int m(int x) {~  return n.incrementAndGet();~}"),
    ("int m(int x) {~  synchronized (this) {~    return n;~  }~}", "int m(int x) {~  rw.readLock();~  return n;~}"),
    ("V m(int x) {~  synchronized (this) {~    Map c = new HashMap();~    c.put(x, x);~    return c;~  }~}", "V m(int x) {~  Map c = new ConcurrentHashMap();~  c.putIfAbsent(x, x);~  return c;~}"),
    ("void m(int x) {~  while (!ready) {~    Thread.sleep(10);~    queue.poll();~  }~}", "void m(int x) {~  latch.await(10);~}"),
    ("void m(int x) {~  synchronized (this) {~    new Thread(job).start();~  }~}", "void m(int x) {~  pool = Executors.newFixedThreadPool(4);~  pool.submit(job);~}"),
    ("void m(int x) {~  list.add(new FileInputStream(f));~}", "void m(int x) {~  try (InputStream in = open(f)) {~    use(in);~  }~}"),
    ("void m(int x) {~  Socket s = new Socket(host, x);~  s.send(1);~}", "void m(int x) {~  SocketChannel c = SocketChannel.open();~  c.close();~}"),
    ("void m(int x) {~  lock.lock();~  Connection c = new Connection(url);~  c.query(x);~  lock.unlock();~}", "void m(int x) {~  try (Connection c = open(url)) {~    c.query(x);~  } finally {~    done();~  }~}"),
    ("void m(int x) {~  synchronized (a) {~    synchronized (b) {~      out = new FileOutputStream(f);~    }~  }~}", "void m(int x) {~  if (a.getId() < b.getId()) {~    try (OutputStream o = open(f)) {~      o.close();~    }~  }~}"),
    ("void m(int x) {~  while (go) {~    for (int i = 0; i < x; i++) {~      String s = new String(\"a\" + i);~    }~  }~}", "void m(int x) {~  cached = x;~}"),
    ("int m(int x) {~  return x + 1;~}", "int m(int x) {~  return x + 2;~}"),
    ("int m(int x) { return x; }", "int m(int x) { return -x; }"),
    ("int m(int x) {~  // größer~  return max(x, 0);~}", "int m(int x) {~  // größte~  return max(x, 1);~}"),
    ("boolean m(int x) {~  return x > 0;~}", "boolean m(int x) {~  return x >= 0;~}"),
    ("void m(int x) {~  counters.put(x, 1);~  static final Map<A> z = null;~}", "void m(int x) {~  counters.put(x, 2);~  ConcurrentHashMap z = null;~}"),
    ("int m(int x) {~  y = x;~  return y;~}", "int m(int x) {~  return x;~}"),
    ("", "int m(int x) {~  return x;~}"),
)

# Beginnings of commit messages.
MESSAGES = (
    "Fix lock contention in scheduler, fixes #12", "Fix memory leak in cache HBASE-77", "Resource leak: stream not closed (#31)", "Refactor session code", "Fix deadlock and memory leak, closes 44",
    "Add support for heap growth chart", "Connection leak in pool; resolves #9", "Update docs", "Reduce busy wait and polling in worker", "bump version to 2", "Slow loop and bloat in report ABC-34", "Unbounded cache causes OOM",
)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(c) if isinstance(c, int) else "'" + c + "'" for c in r) + ")" for r in rows)


CODE = f"""SELECT p_partkey AS pair_key, p_brand AS repo, 'c' || CAST(p_partkey AS STRING) AS commit_hash, 'src/F' || CAST(p_partkey % 7 AS STRING) || '.java' AS file_path,
  'Unknown.m(int x)' AS signature, 'm' AS method_name, CAST(i AS INT) AS template, replace(b, '~', chr(10)) AS before_source, replace(a, '~', chr(10)) AS after_source
  FROM part JOIN (VALUES {_values((i, b, a) for i, (b, a) in enumerate(TEMPLATES))}) AS t(i, b, a) ON p_partkey % {len(TEMPLATES)} = i"""

MSG = f"""SELECT doc_id, 'c' || CAST(doc_id AS STRING) AS commit_hash, source AS repo, s || ' ' || CAST(doc_id AS STRING) AS subject, coalesce(text, '') AS body
  FROM documents JOIN (VALUES {_values(enumerate(MESSAGES))}) AS t(i, s) ON doc_id % {len(MESSAGES)} = i"""

#: Files of nested scopes around a method, with braces in strings, characters, comments and annotations.
FILE = f"""SELECT pair_key, repo, commit_hash, file_path, 'package p; import java.util.*;' || chr(10) || '@Doc("}}") public class A' || CAST(pair_key % 5 AS STRING) || '<T extends B<T>> {{' || chr(10)
  || '  String s = "}}{{ class X {{ void no() {{ }} }}"; // }} {{ int not() {{' || chr(10) || '  char c = ' || chr(39) || '}}' || chr(39) || '; int[] a = {{1, 2}}; /* }} void gone() {{' || chr(10) || ' */' || chr(10)
  || '  public A' || CAST(pair_key % 5 AS STRING) || '(int x) {{ super(x); }}' || chr(10) || '  @Note({{"a", "b)"}})' || chr(10) || before_source || chr(10)
  || CASE pair_key % 4 WHEN 0 THEN '  interface I {{ void q(int y) throws E; default int w() {{ return 1; }} }}' WHEN 1 THEN '  enum C {{ RED(1) {{ int tint() {{ return 2; }} }}, BLUE; C(int r) {{ }} int base() {{ return 0; }} }}'
     WHEN 2 THEN '  Object late(@Named("(") Map<String, List<A>> in) {{ if (x) {{ go(in); }} return new Foo<A>(1) {{ public String name() {{ return "{{"; }} }}; }}'
     ELSE '  static class N {{ class O {{ int deep()[] {{ return null; }} }} record P(int z) {{ <Q> int sum() {{ return z; }} }} @interface J {{ int v(); }} }}' END
  || chr(10) || CASE WHEN pair_key % 7 = 0 THEN '  void open() {{' ELSE '}}' END AS source FROM ({CODE}) AS code"""

DIFF = f"""SELECT pair_key, repo, commit_hash, file_path, '--- a/' || file_path || chr(10) || '+++ b/' || file_path || chr(10) || '@@ -' || CAST(pair_key % 90 + 1 AS STRING) || ',3 +' || CAST(pair_key % 90 + 1 AS STRING)
  || CASE WHEN pair_key % 3 = 0 THEN '' ELSE ',4' END || ' @@ class A ' || method_name || '(int x) {{' || chr(10) || '-' || replace(before_source, chr(10), chr(10) || '-') || chr(10) || '+' || replace(after_source, chr(10), chr(10) || '+')
  || CASE WHEN pair_key % 4 = 0 THEN chr(10) || '+++ b/README.md' || chr(10) || '@@ -1 +1 @@' || chr(10) || '+text' ELSE '' END AS diff FROM ({CODE}) AS code"""

#: Values per user in time order; a third of the users get a rising trend.
SERIES = """SELECT user_id AS entry, CASE WHEN event_id % 2 = 0 THEN 'buggy' ELSE 'fixed' END AS variant,
  row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS ordinal,
  value + CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN 60.0 * (row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1) ELSE 0.0 END AS value FROM events"""

#: Benchmark values of an entry: eight a variant, at four thread counts.
BENCH = """SELECT l_partkey AS entry, CASE WHEN l_linenumber % 2 = 1 THEN 'buggy' ELSE 'fixed' END AS variant,
  CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 8 WHEN 2 THEN 32 ELSE 64 END AS threads,
  row_number() OVER (PARTITION BY l_partkey, l_linenumber % 2 ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS ordinal,
  l_quantity * CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 3 = 0 THEN 3.0 ELSE 1.0 END AS value FROM lineitem"""

VIEWS = {"v_code": CODE, "v_msg": MSG, "v_diff": DIFF, "v_file": FILE, "v_series": SERIES, "v_bench": BENCH}
