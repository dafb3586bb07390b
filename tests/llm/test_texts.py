"""Visual forms, encoding and mixing."""

import random
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from loomdex.common import table
from loomdex.llm import mixing, tokens, visual

ALIKE = dict(zip((x := visual.LOOKALIKES.split())[::2], x[1::2], strict=True))


def within(c, ranges):
    return any(a <= ord(c) <= b for a, b in ranges)


def brute_form(s):
    """The form by plain string operations, character by character."""
    out = []
    for i, c in enumerate(s):
        if ord(c) in visual.JOINERS:
            if 0 < i < len(s) - 1:
                p, n = s[i - 1], s[i + 1]
                if within(p, visual.JOINING) or within(p, visual.PICTURES) and within(n, visual.PICTURES) and ord(c) == 0x200D:
                    out.append(c)
            continue
        if within(c, visual.INVISIBLE):
            continue
        kind = unicodedata.decomposition(c).rpartition("> ")
        if kind[0] in ("<wide", "<narrow"):
            c = "".join(chr(int(x, 16)) for x in kind[2].split())
        for d in unicodedata.normalize("NFD", c):
            d = ALIKE.get(d, d)
            out.append(" " if unicodedata.category(d) == "Zs" and ord(d) != 0x1680 or ord(d) in visual.BLANK else d)
    return unicodedata.normalize("NFC", "".join(out))


POOL = [*"aeoAE oeic", *"\u0430\u0435\u0301\u0308\u0323\u0327\u030a\u3099\u0302", "\u1100", "\u1161", "\u11a8", "\uac01", "\uac00", "\u304b", "\u0451", "\u1ec7", "\uff76", "\uff9e", "\uff21", "\u3000", "\u200d", "\u200b", "\u00a0", "\U0001f680", "\u00b2", "\u212b", "\u09c7", "\u09be", "\u0f71", "\u0915", "\ufb01", "\u0344", "\r\n", "\t"]


def test_forms_equal_brute_force():
    r = random.Random(5)
    texts = ["".join(r.choice(POOL) for _ in range(r.randint(0, 16))) for _ in range(8000)] + [None, "", "\u0301", "x" * 100_000 + "\uff21"]
    got = visual.form_array(pa.array(texts)).to_pylist()
    assert got == [None if t is None else brute_form(t) for t in texts]


def test_every_character_equals_brute_force():
    chars = [chr(i) for i in range(1, 0x11000) if not 0xD800 <= i <= 0xDFFF]
    assert visual.form_array(pa.array(chars)).to_pylist() == [brute_form(c) for c in chars]


def test_sliced_arrays():
    a = pa.array(["\uff21", None, "b\u0301", "\u0441"])
    assert visual.form_array(a.slice(1, 2)).to_pylist() == [None, "b\u0301"]


def test_visible_differences_stay(rows):
    d = rows([(1, "a b"), (2, "a\u00a0b"), (3, "a  b"), (4, "a\tb"), (5, "A b"), (6, "\u00e0 b"), (7, "a\u0300 b"), (8, "x\u00b2"), (9, "x2"), (10, "\u0430 b"), (11, "a b"), (12, ""), (13, None), (14, "a b\n"), (15, "a b\r\n")], "doc_id long, text string")
    got = {tuple(x) for x in visual.alike_pairs(d, "doc_id", "text").collect()}
    assert got == {(1, 2), (1, 10), (2, 10), (2, 11), (10, 11), (6, 7)}


def test_texts_of_invisible_characters_alone(rows):
    d = rows([(1, "\u200b"), (2, "\ufeff"), (3, "\u200b"), (4, ""), (5, None), (6, " ")], "doc_id long, text string")
    assert sorted(tuple(x) for x in visual.alike_pairs(d, "doc_id", "text").collect()) == [(1, 2), (2, 3)]


def test_copies_of_a_text_do_not_meet(spark):
    d = spark.range(1, 100_001).selectExpr("id AS doc_id", "if(id = 50000, 'p\u0430y', 'pay') AS text")
    begun = time.time()
    got = visual.alike_pairs(d, "doc_id", "text").selectExpr("count(*)", "count_if(doc_a = 50000)", "count_if(doc_b = 50000)").first()
    assert tuple(got) == (99_999, 50_000, 49_999) and time.time() - begun < 60


def test_pairs_with_clashing_columns_and_copies(rows):
    d = rows([(1, "\uff41", 0), (2, "a", 0), (2, "a", 0), (3, "a", 0)], "doc_id long, text string, form int")
    got = sorted(tuple(x) for x in visual.alike_pairs(d, "doc_id", "text").collect())
    assert got == [(1, 2), (1, 3)]
    assert visual.alike_pairs(rows([], "doc_id long, text string"), "doc_id", "text").count() == 0
    forms = sorted((x.doc_id, x.form) for x in visual.visual_form(d, "doc_id", "text").collect())
    assert forms == [(1, "a"), (2, "a"), (2, "a"), (3, "a")]


# --- tokens ---
def whole_encoder():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.ranks(tokens.VOCABULARY), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    try:
        return whole_encoder()
    except (ImportError, OSError):
        pytest.skip("no vocabulary here")


WORDS = [*"ab s t 're ve ll d'''  \t\n\r=+1\u00b2\u00e9.,", "'s", "'re", "'ll", "\u3000", "\x85", "\x1c", "\u1100", "\u5b57", "\u2460", "\U0001f680", "\u0345"]


def test_words_equal_pattern(encoder):
    import public_tokenizers
    import regex

    r = random.Random(2)
    texts = ["".join(r.choice(WORDS) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    cps, ends = tokens.code_points(pa.array(texts))
    at = np.r_[tokens.word_starts(cps, ends), len(cps)]
    joined = "".join(texts)
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert [joined[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [w for t in texts for w in pattern.findall(t)]


def test_ids_equal_whole_encoding_and_decode(spark, rows, encoder, monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice(WORDS) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", None, "x" * 5000, "the " * 3000, " ", "a" * 300 + " " + "a" * 300]
    d = rows([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, block int")
    got = {x.doc_id: list(x.ids) for x in tokens.encode(d, "doc_id", "text").collect()}
    assert got == {i: encoder.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {x.doc_id: x.tokens for x in tokens.encode(d, "doc_id", "text", counts=True).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    back = tokens.decode(tokens.encode(d, "doc_id", "text"), "doc_id", "ids")
    assert {x.doc_id: x.text for x in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_encoding_of_nothing(rows, encoder):
    assert tokens.encode(rows([], "doc_id long, text string"), "doc_id", "text").count() == 0
    assert [(x.doc_id, x.ids) for x in tokens.encode(rows([(1, None), (1, None)], "doc_id long, text string"), "doc_id", "text").collect()] == [(1, []), (1, [])]


def test_decoding_of_odd_ids(rows, encoder):
    ids = encoder.encode_ordinary("a\U0001f680b")
    d = rows([(1, ids, 0), (2, [ids[1]], 0), (3, None, 0), (4, [], 0), (5, [-1, 10**9, ids[0], None], 0), (1, ids, 0)], "doc_id long, ids array<int>, text int")
    got = sorted((x.doc_id, x.text) for x in tokens.decode(d, "doc_id", "ids").collect() if x.text is not None)
    assert got[0] == got[1] == (1, "a\U0001f680b") and "\ufffd" in got[2][1] and got[3:] == [(4, ""), (5, "a")]
    assert tokens.decode(d, "doc_id", "ids").filter("text IS NULL").count() == 1
    assert tokens.decode(d.limit(0), "doc_id", "ids").count() == 0


def test_words_that_share_a_hash():
    h1, h2 = np.array([5, 5, 9], np.uint64), np.array([1, 2, 1], np.uint64)
    assert tokens._distinct(np.r_[h1, h1], np.r_[h2, h2]).size == 3
    assert tokens._find(h1, h2, np.array([5, 9, 5], np.uint64), np.array([2, 1, 1], np.uint64)).tolist() == [1, 2, 0]


# --- mixing ---
def test_flow_meets_quotas_at_least_cost():
    capacity = {("a",): 100, ("a", "b"): 50, ("b",): 10}
    flow, quota = mixing.route(capacity, {"a": 0.5, "b": 0.5, "none": 0.3}, {"a": 1, "b": 3, "none": 2})
    got = {s: sum(n for (_, t), n in flow.items() if t == s) for s in "ab"}
    assert got == quota and abs(quota["a"] - quota["b"]) <= 1
    assert flow.get((("a",), "a"), 0) <= 100 and flow.get((("a", "b"), "b"), 0) <= 150
    assert sum(quota.values()) == 280  # all there is: 100 of a, 30 for b, the shared 50 three times


def test_largest_total_against_all_subsets():
    import itertools

    r = random.Random(1)
    for _ in range(200):
        names = "abcd"[: r.randint(1, 4)]
        pats = {tuple(sorted(r.sample(names, r.randint(1, len(names))))) for _ in range(5)}
        cap = {p: r.randint(5, 600) for p in pats}
        rep = {s: r.randint(1, 3) for s in names}
        w = {s: r.random() + 0.1 for s in names}
        flow, quota = mixing.route(cap, w, rep)
        have, share = sorted(quota), sum(w[s] for s in quota)

        def supply(part):  # what can reach the sources of a subset at most
            return sum(min(c * max(rep[s] for s in p), sum(c * rep[s] for s in p if s in part)) for p, c in cap.items() if set(p) & set(part))

        best = min(supply(part) * share / sum(w[s] for s in part) for k in range(1, len(have) + 1) for part in itertools.combinations(have, k))
        assert best - 2 * len(have) - 2 <= sum(quota.values()) <= best + 1
        for s in have:
            assert sum(n for (_, t), n in flow.items() if t == s) == quota[s]
        for p, c in cap.items():
            assert sum(n for (q, _), n in flow.items() if q == p) <= c * max(rep[s] for s in p)


def test_mix_of_small_sources(rows, encoder):
    docs = [(i, f"word{i} and more text here", "big", 0) for i in range(200)] + [(1000 + i, f"rare{i} text", "small", 0) for i in range(10)] + [(2000, "shared text of both", "big", 0), (2001, "shared text of both", "small", 0), (2002, "shared text of both", "small", 0), (3000, None, "big", 0), (3001, "", "small", 0), (3002, "x", None, 0), (3003, "y", "unknown", 0)]
    targets = [("big", 0.5, 1), ("small", 0.5, 3), ("small", 0.5, 3), ("empty", 0.2, 2), (None, 0.1, 1)]
    d = rows(docs, "doc_id long, text string, source string, tokens int")
    m = mixing.Mix(d, rows(targets, "source string, weight double, max_repeats int"))
    rep = {x.source: x for x in m.report().collect()}
    assert rep["small"].most_uses <= 3 and rep["big"].most_uses == 1 and rep["empty"].used_tokens == 0
    assert abs(rep["small"].share - 0.5) < 0.05 and rep["small"].documents == 11 and rep["big"].documents == 201
    assert {x.source for x in m.selection().collect()} == {"big", "small"}
    again = mixing.Mix(d, rows(targets, "source string, weight double, max_repeats int"))
    assert sorted(map(tuple, again.selection().collect())) == sorted(map(tuple, m.selection().collect()))


def test_mix_of_nothing(rows, encoder):
    m = mixing.Mix(rows([], "doc_id long, text string, source string"), rows([("a", 1.0, 2)], "source string, weight double, max_repeats int"))
    x = m.report().first()
    assert (x.used_tokens, x.share) == (0, None) and m.selection().count() == 0


def test_given_total(rows, encoder):
    d = rows([(i, f"one two three {i}", "a") for i in range(50)], "doc_id long, text string, source string")
    m = mixing.Mix(d, rows([("a", 1.0, 2)], "source string, weight double, max_repeats int"), total=100)
    x = m.report().first()
    assert 90 <= x.used_tokens <= 110 and x.share == 1.0


def test_a_frequent_word_is_spread(spark, encoder, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 400)
    monkeypatch.setattr(tokens, "SPREAD", 3)
    d = spark.range(200).selectExpr("id", "concat('the same words again ', id) AS text")
    got = {x.id: list(x.ids) for x in tokens.encode(d, "id", "text").collect()}
    assert got == {i: encoder.encode_ordinary(f"the same words again {i}") for i in range(200)}


def test_mix_of_the_table(spark, data, encoder):
    """Quotas, shares and uses of the report against the selection, the selection against the texts, by brute force."""
    d, targets = table(spark, data, "documents"), table(spark, data, "mix_targets").collect()
    m = mixing.Mix(d, table(spark, data, "mix_targets"))
    docs = {x.doc_id: (x.source, x.text) for x in d.collect()}
    picked = [tuple(x) for x in m.selection().select("doc_id", "source", "tokens", "uses").collect()]
    report = {x.source: x for x in m.report().collect()}
    assert set(report) == {x.source for x in targets}
    used, texts = {}, {}
    for doc, source, size, uses in picked:
        of, text = docs[doc]
        assert of == source and size == len(encoder.encode_ordinary(text)) and 1 <= uses <= report[source].max_repeats
        assert text not in texts.setdefault(source, set())
        texts[source].add(text)
        used[source] = used.get(source, 0) + size * uses
    have = {s: {t for o, t in docs.values() if o == s and t} for s in report}
    share = sum(report[s].weight for s in report if have[s])
    total = sum(x.quota for x in report.values())
    longest = max(len(encoder.encode_ordinary(t)) for ts in have.values() for t in ts)
    patterns = len({tuple(sorted(s for s in have if t in have[s])) for ts in have.values() for t in ts})
    for s, x in report.items():
        assert x.used_tokens == used.get(s, 0) and x.documents == len(have[s]) and x.tokens == sum(len(encoder.encode_ordinary(t)) for t in have[s])
        assert abs(x.quota - total * x.weight / share) <= len(report) if have[s] else x.quota == 0
        assert abs(x.used_tokens - x.quota) <= longest * patterns and abs(x.share - x.used_tokens / sum(used.values())) < 1e-9
    # one source at least is used up: the total can't be larger
    assert any(x.quota >= x.tokens * x.max_repeats - len(report) for s, x in report.items() if have[s])


def test_every_text_of_the_table(spark, data, encoder):
    d = table(spark, data, "documents")
    texts = dict(d.select("doc_id", "text").toPandas().itertuples(index=False, name=None))
    got = {x.doc_id: list(x.ids) for x in tokens.encode(d, "doc_id", "text").collect()}
    assert got == {k: encoder.encode_ordinary(v or "") for k, v in texts.items()}
    groups = {}
    for k, v in texts.items():
        if v:
            groups.setdefault(brute_form(v), []).append(k)
    want = {(a, b) for g in groups.values() for a in g for b in g if a < b and texts[a] != texts[b]}
    assert {tuple(x) for x in visual.alike_pairs(d, "doc_id", "text").collect()} == want
    forms = {x.doc_id: x.form for x in visual.visual_form(d, "doc_id", "text").collect()}
    assert forms == {k: brute_form(v) if v else v for k, v in texts.items()}
