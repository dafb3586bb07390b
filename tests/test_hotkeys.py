from loomdex.operators import hotkeys

GTP = "gtp_id long, tag string, path string, lineno int, w int"


def test_shares_with_nulls_and_repeats(rows):
    recs = [(i, "hot", f"p{i % 3}", i % 5, 0) for i in range(60)] + [(100 + i, f"t{i}", None, None, 0) for i in range(40)] + [(0, "hot", "p0", 0, 0)] * 3
    got = {(x.key_field, x.key_value, x.n) for x in hotkeys.hot_keys(rows(recs, GTP), 0.05).collect()}
    assert got == {("tag", "hot", 60)} | {("lineno", str(i), 12) for i in range(5)}


def test_values_that_are_no_tags(rows):
    recs = [(i, x, "p", None, 0) for i, x in enumerate(["", "a b", "x" * 512, None, "ok"])]
    assert [(x.key_field, x.key_value) for x in hotkeys.hot_keys(rows(recs, GTP), 0.01).collect()] == [("tag", "ok")]


def test_profile_ties_and_nulls(rows):
    recs = [(1, "a", "./p", 10, 0), (2, "a", "q", 10, 0), (3, "a", "p", 300, 0), (4, "a", "q", None, 0), (5, "b", None, None, 0), (5, "b", None, None, 0)]
    got = {x.tag: x for x in hotkeys.tag_profile(rows(recs, GTP)).collect()}
    a, b = got["a"], got["b"]
    assert (a.n_records, a.n_paths, a.top_path, a.n_lines, a.top_line, a.line_p50, a.line_p90) == (4, 2, "p", 2, 10, 10, 300)
    assert (b.n_records, b.n_paths, b.top_path, b.n_lines, b.line_p50) == (1, 0, None, 0, None)


def test_percentiles_over_many_spans(rows):
    vals = [(i * 37) % 5003 for i in range(2000)]
    pairs = rows([("k", v, 1) for v in vals], "key string, value int, w long")
    x = hotkeys.key_percentiles(pairs, (0.25, 0.5, 0.99)).first()
    want = sorted(vals)
    assert (x.p25, x.p50, x.p99) == (want[499], want[999], want[1979])


def test_percentiles_of_wide_values(rows):
    import random

    r = random.Random(7)
    for kind, most in (("int", 2**31 - 1), ("long", 2**62)):
        vals = [r.randint(-most, most) for _ in range(500)] + [0, -1, 1, most, -most] * 3
        pairs = rows([(k, v, 1) for k in "ab" for v in set(vals)] + [("c", 5, 10), ("c", None, 3), ("d", None, 1)], f"key string, value {kind}, w long")
        got = {x.key: (x.p1, x.p50, x.p100) for x in hotkeys.key_percentiles(pairs, (0.01, 0.5, 1.0)).collect()}
        want = sorted(set(vals))
        at = lambda p: want[-(-len(want) * p // 100) - 1]
        assert got == {"a": (at(1), at(50), at(100)), "b": (at(1), at(50), at(100)), "c": (5, 5, 5)}


def test_empty(rows):
    assert hotkeys.hot_keys(rows([], GTP)).count() == 0
    assert hotkeys.tag_profile(rows([], GTP)).count() == 0
    assert hotkeys.line_profile(rows([], GTP)).count() == 0


def test_written_tables_are_released(spark):
    from loomdex import common

    t = common.written(spark.range(3), "three")
    assert t.count() == 3 and common.release(spark) > 0 and common.release(spark) == 0
    assert spark.read.option("ignoreMissingFiles", "true").schema("id long").parquet(common.shared_dir(spark)).count() == 0
