"""Hand-derived cases of single operators."""

import itertools
from collections import Counter
from random import Random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskframe.functions import paths, scoring
from riskframe.operators import coverage, delta, matching, similarity
from riskframe.sources import lcov


@pytest.mark.parametrize(("cc", "cov", "want"), [(1.0, 100.0, 1.0), (4.0, 50.0, 6.0), (6.0, 0.0, 42.0), (12.0, 0.0, 156.0), (12.0, -5.0, 156.0)])
def test_score(spark, cc, cov, want):
    assert spark.range(1).select(scoring.crap(F.lit(cc), F.lit(cov))).first()[0] == want


@pytest.mark.parametrize(("hits", "want"), [({11: 0, 13: 4, 14: 0, 17: 0, 19: 1, 20: 0}, [(11, 11), (14, 17), (20, 20)]), ({9: 0, 10: 0, 20: 0, 21: 0}, [(10, 20)]), ({15: 2}, [])])
def test_uncovered_ranges(spark, hits, want):
    f = spark.createDataFrame([(1, "a", 10, 20)], "ord long, path string, start_line int, end_line int")
    lines = spark.createDataFrame([("a", k, v) for k, v in hits.items()], "path string, line int, hits long")
    assert sorted((r["first"], r["last"]) for r in coverage.uncovered_ranges(f, lines).collect()) == want


def test_coverage_of_unknown_and_empty_files(spark):
    f = spark.createDataFrame([(1, "a", 10, 13), (2, "a", 50, 60), (3, "b", 1, 2)], "ord long, path string, start_line int, end_line int")
    lines = spark.createDataFrame([("a", 10, 5), ("a", 11, 0), ("a", 12, 1), ("a", 13, 0)], "path string, line int, hits long")
    assert {r["ord"]: r["coverage"] for r in coverage.span_coverage(f, lines).collect()} == {1: 50.0, 2: 100.0, 3: None}


def test_longest_suffix_wins(spark):
    q = spark.createDataFrame([(1, "x/y/z/m.py"), (2, "z/m.py"), (3, "q/z/m.py"), (4, "am.py")], "id long, path string")
    n = spark.createDataFrame([("m.py",), ("y/z/m.py",), ("./z/m.py",), (".",)], "needle string")
    assert {r["id"]: r["needle"] for r in matching.suffix_join(q, n).collect()} == {1: "y/z/m.py", 2: "z/m.py", 3: "z/m.py", 4: None}


@pytest.mark.parametrize(("glob", "path", "want"), [("tests/**", "tests/a/b.rs", True), ("*.rs", "a/b.rs", False), ("**/b.rs", "b.rs", True), ("a/?.rs", "a/bc.rs", False), ("a/[!b-d]x", "a/ex", True), ("a/[!b-d]x", "a/bx", False), ("a[/]x", "a/x", False), ("{a,b/*}/c", "b/q/c", True), ("{a,b}/c", "ab/c", False)])
def test_glob(glob, path, want):
    assert bool(paths.re.match(paths.glob_regex(glob), path)) is want


def test_lcov(spark):
    text = "DA:1,1\nSF:a\nDA:1,2\nDA:1,3\nDA:2,0\nend_of_record\nDA:9,9\nSF:b\nend_of_record\nSF:a\nDA:2,1\nend_of_record"
    got = lcov.parsed(spark.createDataFrame([("r", text)], "report string, text string")).collect()
    assert sorted((r["path"], r["line"], int(r["hits"])) for r in got) == [("a", 1, 5), ("a", 2, 1)]


def side(spark, rows):
    return spark.createDataFrame(rows, "file string, name string, line long, crap double, ord long")


def test_delta_passes(spark):
    now = side(spark, [("a/x.rs", "same", 1, 5.0, 1), ("b/y.rs", "shift", 9, 5.0, 2), ("q.rs", "mv", 1, 5.0, 3), ("n.rs", "fresh", 1, 1.0, 4)])
    old = side(spark, [("a/x.rs", "same", 1, 1.0, 1), ("a/x.rs", "same", 1, 9.0, 2), ("b/y.rs", "shift", 1, 5.0, 3), ("z.py", "mv", 1, 5.005, 4), ("g.rs", "gone", 1, 1.0, 5)])
    got, removed = delta.compare(now, old)
    assert {r["ord"]: (r["status"], r["previous_file"]) for r in got.collect()} == {1: ("improved", None), 2: ("unchanged", None), 3: ("moved", "z.py"), 4: ("new", None)}
    assert [r["name"] for r in removed.collect()] == ["gone"]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 7), st.integers(0, 7)).filter(lambda p: p[0] < p[1]), st.sampled_from([0.8, 0.9, 1.0]), max_size=15))
def test_groups_hold_every_pair_and_only_similar_members(found):
    rows = pd.DataFrame([(a, b, s) for (a, b), s in found.items()], columns=["first", "second", "score"])
    groups = similarity.grouped(rows)
    inside = {p for m, _, _ in groups for p in itertools.combinations(m, 2)}
    assert inside == set(found)


def test_groups_of_a_long_chain(spark):
    chain = [(k, k + 1, 0.9) for k in range(1, 68)] + [(68, 69, 1.0), (69, 70, 1.0), (68, 70, 1.0)]
    got = {r["members"] for r in similarity.groups(spark.createDataFrame(chain, "first long, second long, score double")).collect()}
    assert got == {",".join(map(str, m)) for m, _, _ in similarity.grouped(pd.DataFrame(chain, columns=["first", "second", "score"]))}
    assert "68,69,70" in got


def plain_novelty(now, before):
    """grp -> (size, status, grown_from), by all pairs of groups."""
    sides = [{g: Counter(m for h, m in rows if h == g) for g in {g for g, _ in rows}} for rows in (now, before)]
    out = {}
    for g, a in sides[0].items():
        held = max((sum((a & b).values()) for b in sides[1].values()), default=0)
        status = "new" if held < 2 else "unchanged" if held == sum(a.values()) else "grown"
        out[g] = (sum(a.values()), status, held if status == "grown" else None)
    return out


def drawn(seed, groups, universe, most):
    random = Random(seed)
    return [(g, random.randrange(universe)) for g in range(groups) for _ in range(random.randint(1, most))]


@pytest.mark.parametrize("small", [64, 4])
def test_novelty_and_resolved_equal_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(similarity, "SMALL", small)  # both ways to meet
    for seed, shift in ((1, 0), (2, 3)):
        before = drawn(seed, 30, 25, 9)
        kept = [(g + shift, m) for k, (g, m) in enumerate(before) if k % 5 and g % 4]
        now = kept + drawn(seed + 7, 8, 25, 12) + [(99, 7), (99, 7), (98, 1000), (98, 1001)]
        a, b = (spark.createDataFrame(rows, "grp long, member long") for rows in (now, before))
        assert {r[0]: (r[1], r[2], r[3]) for r in similarity.novelty(a, b).collect()} == plain_novelty(now, before)
        sets = [{g: {m for h, m in rows if h == g} for g in {g for g, _ in rows}} for rows in (now, before)]
        want = {(g, sum(h == g for h, _ in before)) for g, s in sets[1].items() if sum(h == g for h, _ in before) >= 2 and not any(len(s & t) >= 2 for t in sets[0].values())}
        assert {tuple(r) for r in similarity.resolved(a, b).collect()} == want


def test_candidates_of_groups_that_kept_their_members_are_few(spark):
    """Many groups over few members: the ones that share some members with a group are no candidates once it has its own back."""
    before = drawn(5, 400, 40, 12)
    a, b, _ = similarity.items(*(spark.createDataFrame(rows, "grp long, member long") for rows in (before, before)))
    own = a.withColumn("least", F.col("n")).filter("n >= 2")
    assert similarity.candidates(own, b.withColumn("least", F.lit(2))).count() < 400 * 400 / 20


def test_groups_without_a_name_count_as_recorded_ones(spark):
    a = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (None, 8)], "grp long, member long")
    b = spark.createDataFrame([(None, 5), (None, 6), (2, 7), (2, 8), (3, 1), (3, 2)], "grp long, member long")
    assert {r["grp"]: r["status"] for r in similarity.novelty(a, b).collect()} == {1: "unchanged", None: "new"}
    assert {tuple(r) for r in similarity.resolved(a, b).collect()} == {(None, 2), (3, 2)}


@pytest.mark.parametrize("modulus", [None, 3])
def test_pairs_equal_all_pairs_also_where_hashes_clash(spark, monkeypatch, modulus):
    if modulus:
        monkeypatch.setattr(similarity, "hashed", lambda c: F.pmod(F.xxhash64(c), F.lit(modulus)))
    random = Random(3)
    base = [{f"s{random.randrange(40)}" for _ in range(random.randint(1, 12))} for _ in range(25)]
    sets = dict(enumerate([*base, *({x for x in s if random.random() > 0.1} | {f"u{k}"} if k % 3 else s for k, s in enumerate(base))]))
    rows = [(k, x) for k, s in sets.items() for x in s]
    for t in (0.5, 0.82, 1.0):
        got = {(r[0], r[1]): r[2] for r in similarity.pairs(spark.createDataFrame(rows, "id long, shape string"), t).collect()}
        score = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(sets, 2) if min(len(sets[i]), len(sets[j])) >= 2}
        assert got == {p: s for p, s in score.items() if s >= t}


def test_pairs_are_found_once_for_groups(spark):
    """The steps of the labels read the pairs, they do not find them anew."""
    calls = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    found = spark.createDataFrame([(k, k + 1, 0.9) for k in range(10)], "first long, second long, score double")
    assert similarity.groups(found.mapInArrow(told, found.schema)).count() and calls.value == 10
