from pyspark.accumulators import AccumulatorParam

from loomdex.operators import orphans
from loomdex.operators.orphans import index_orphans

REFS = "kind int, key string, ref_id long, at timestamp"
PARENTS = "kind int, key string, loaded_at timestamp, removed_at timestamp"


def brute(refs, parents):
    out = set()
    for kind, key, ref, at in refs:
        if key is None:
            continue
        live = any(k == kind and p == key and a is not None and at is not None and a <= at and (b is None or at < b) for k, p, a, b in parents)
        if not live:
            out.add((kind, ref))
    return out


def run(rows, refs, parents, target=3):
    got = orphans.orphans(rows(refs, REFS), rows(parents, PARENTS), target).collect()
    assert len(got) == len({(x.kind, x.ref_id) for x in got})
    return {(x.kind, x.ref_id) for x in got}


def test_missing_removed_not_yet_loaded_and_bounds(rows):
    refs = [(1, "a", 1, "2025-01-05"), (1, "a", 2, "2025-01-01"), (1, "a", 3, "2025-01-10"), (1, "a", 4, "2025-01-09"), (1, "b", 5, "2025-01-05"), (2, "a", 6, "2025-01-05"), (1, None, 7, "2025-01-05"), (1, "a", 8, None), (1, "", 9, "2025-01-05"), (1, "a", 1, "2025-01-05")]
    parents = [(1, "a", "2025-01-02", "2025-01-10"), (1, "a", "2025-01-02", "2025-01-10"), (1, "a", "2025-01-20", None), (2, "x", "2025-01-01", None), (1, "b", None, None)]
    assert run(rows, refs, parents) == brute(refs, parents) == {(1, 2), (1, 3), (1, 5), (2, 6), (1, 8), (1, 9)}


def test_hot_key_over_several_tasks(rows):
    refs = [(1, "hot", i, f"2025-01-{1 + i % 28:02d} 00:00:00") for i in range(90)] + [(1, f"k{i}", 1000 + i, "2025-02-01") for i in range(30)]
    parents = [(1, "hot", f"2025-01-{d:02d} 00:00:00", f"2025-01-{d + 1:02d} 00:00:00") for d in range(1, 28, 3)] + [(1, f"k{i}", "2025-01-01", None) for i in range(0, 30, 2)]
    assert run(rows, refs, parents, target=8) == brute(refs, parents)


def test_overlapping_lives_merge(rows):
    parents = [(1, "a", f"2025-01-{d:02d} 12:00:00", f"2025-01-{d + 2:02d} 00:00:00") for d in range(1, 20)] + [(1, "a", "2025-01-03", "2025-01-02")]
    assert orphans.merged_lifetimes(rows(parents, PARENTS).selectExpr("kind", "1L h1", "1 h2", "loaded_at", "removed_at")).count() == 1


def test_empty_sides(rows):
    assert run(rows, [], []) == set()
    assert run(rows, [(1, "a", 1, "2025-01-01")], []) == {(1, 1)}
    assert run(rows, [], [(1, "a", "2025-01-01", None)]) == set()


def test_colliding_hashes_are_told_apart():
    import numpy as np

    h1 = np.array([5, 5, 5, 7])
    h2 = np.array([1, 2, 3, 1])
    at = np.array([10, 10, 10, 10])
    par = (np.array([5, 5]), np.array([1, 2]), np.array([0, 20]), np.array([15, 30]))
    assert orphans._alive((h1, h2, at), par).tolist() == [True, False, False, False]


def test_index_with_extra_columns(rows):
    gtp = rows([(1, 1, "t", "./a/../x.c", 1, "2025-02-01", "z"), (2, 3, "u", None, 1, "2025-02-01", "z"), (3, 2, "no tag", ".//x.c", 1, "2025-02-01", "z")], "gtp_id long, db int, tag string, path string, lineno int, read_at timestamp, kind string")
    parsed = rows([(1, " 007 ", "2025-02-01"), (2, "?", "2025-02-01"), (3, "8", "2025-02-01")], "run_id long, fid string, parsed_at timestamp")
    defs = rows([("t", "2025-03-01", None, 1)], "tag string, loaded_at timestamp, removed_at timestamp, h1 int")
    files = rows([(7, "./x.c", "2025-01-01", None, "c")], "fid long, path string, loaded_at timestamp, removed_at timestamp, kind string")
    got = {(x.ref_table, x.field, x.ref_id) for x in index_orphans(gtp, parsed, defs, files).collect()}
    assert got == {("gtp", "tag", 1), ("parsefile_data", "fid", 3)}


def groups(spark, monkeypatch, refs, parents, target):
    """Rows of references and parents by group, and the result."""
    seen = spark.sparkContext.accumulator([], Lists())
    probe = orphans._probe

    def counted(r, p):
        seen.add([(r.num_rows, p.num_rows)])
        return probe(r, p)

    monkeypatch.setattr(orphans, "_probe", counted)
    got = {(x.kind, x.ref_id) for x in orphans.orphans(refs, parents, target).collect()}
    return seen.value, got


class Lists(AccumulatorParam):
    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return a + b


def test_many_parents_are_parted(spark, monkeypatch):
    refs = spark.range(1000).selectExpr("1 kind", "concat('k', id * 3000) key", "id ref_id", "timestamp'2025-02-01' at")
    parents = spark.range(3_000_000).selectExpr("1 kind", "concat('k', id) key", "timestamp'2025-01-01' loaded_at", "if(id % 6000 = 0, timestamp'2025-01-15', null) removed_at")
    sizes, got = groups(spark, monkeypatch, refs, parents, 100_000)
    assert len(sizes) > 30 and max(a + b for a, b in sizes) <= 100_000 and sum(b for _, b in sizes) == 3_000_000
    assert got == {(1, i) for i in range(0, 1000, 2)}


def test_one_key_of_many_lifetimes_is_cut_by_time(spark, monkeypatch):
    refs = spark.range(20_000).selectExpr("1 kind", "'hot' key", "id ref_id", "timestamp_seconds(1700000000 + id * 10) at")
    parents = spark.range(50_000).selectExpr("1 kind", "'hot' key", "timestamp_seconds(1700000000 + id * 4) loaded_at", "timestamp_seconds(1700000002 + id * 4) removed_at")
    sizes, got = groups(spark, monkeypatch, refs, parents, 5_000)
    assert max(b for _, b in sizes) < 6_000 and max(a for a, _ in sizes) <= 5_000
    assert got == {(1, i) for i in range(20_000) if (i * 10) % 4 >= 2 or i * 10 >= 200_000}


def test_lifetimes_that_span_cuts(rows):
    parents = [(1, "hot", f"2025-01-{d:02d} 00:00:00", f"2025-01-{d + 1:02d} 00:00:00") for d in range(1, 28, 2)] + [(1, f"k{i}", "2024-01-01", None) for i in range(12)] + [(1, f"e{i}", "2025-01-05", "2025-01-20") for i in range(12)]
    refs = [(1, k, 100 * n + d, f"2025-01-{d:02d} 12:00:00") for n, k in enumerate(["hot", "none", *[f"k{i}" for i in range(12)], *[f"e{i}" for i in range(12)]]) for d in range(1, 29)]
    for target in (2, 5, 20, 1000):
        assert run(rows, refs, parents, target) == brute(refs, parents)
