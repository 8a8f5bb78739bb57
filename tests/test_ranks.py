"""The signed-rank test makes its series once, also with zeros, ties, unknown differences and values measured twice."""

import random

from millrace.functions import stats
from millrace.operators import validation


def test_ranks_of_differences_in_one_pass(spark):
    rng = random.Random(3)
    rows = [(e, 32, o, v, rng.choice([None, 1.0, 2.0, 3.0, 5.5]) if e else 2.0) for e in range(6) for o in range(e * 4 + 1) for v in ("buggy", "fixed") for _ in range(1 + (e == 3 and o == 2))]
    bench = spark.createDataFrame(rows, "entry long, threads int, ordinal long, variant string, value double")
    told = stats.signed_rank(validation.paired(bench), ["entry", "threads"], "y", "x")
    assert told._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = {r.entry: r for r in told.collect()}
    for e in range(6):
        pairs = [(b[4], f[4]) for b in rows for f in rows if b[0] == f[0] == e and b[2] == f[2] and (b[3], f[3]) == ("buggy", "fixed")]
        d = [y - x for x, y in pairs if x is not None and y is not None and y != x]
        size = [abs(v) for v in d]
        w = sum(sum(s < abs(v) for s in size) + (size.count(abs(v)) + 1) / 2 for v in d if v > 0)
        assert (got[e].n, got[e].w) == (len(pairs), w) and (got[e].p is None) == (len(pairs) < 2)
        if not d and len(pairs) > 1:
            assert got[e].p == 1.0
