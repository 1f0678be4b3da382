"""Settings, envelopes and the text formats."""

import json

import pytest

from riskframe import config
from riskframe.operators import delta, scope, similarity, triage
from riskframe.render import cells, text
from riskframe.sources import baseline


def test_settings():
    s = config.from_text('threshold = 12\ngate = ["bool-ops"]\n[limits]\n"bool-ops" = 3', top=5)
    assert (s.threshold, s.gate, s.limits, s.top) == (12, ["bool_ops"], {"bool_ops": 3}, 5)
    for bad in ("nothing = 1", "threshold = nan", "epsilon = -1.0", 'sort = "x"', 'gate = ["x"]', "[limits]\nlines = -1"):
        with pytest.raises(ValueError):
            config.from_text(bad)
    assert scope.exclude_globs(["x"], None, ["y"]) == [*scope.DEFAULT_EXCLUDES, "y", "x"]
    assert scope.exclude_globs(None, ["c"], []) == ["c"] and scope.exclude_globs(None, ["c"], ["y"], True) == ["y"]
    assert scope.select_packages(["a", "b", "a", "c"], ["c", "a"]) == ["a", "c"]
    with pytest.raises(ValueError, match="zz"):
        scope.select_packages(["a"], ["zz"])
    assert config.exit_code(False, 3, True) == 1 and config.exit_code(True, 0, False) == 2 and not config.exit_code(False, 3, False)
    assert config.cache_folder(None, "/w", None, {}) == "/w/target/riskframe" and config.cache_folder(None, None, None, {}) is None
    assert config.carries_pairs("json") and not config.carries_pairs("sarif")


def test_configuration_is_found_upwards(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "riskframe.toml").write_text("")
    assert config.find(str(tmp_path / "a/b")) == str(tmp_path / "riskframe.toml")


def test_envelope_round_trip(spark, tmp_path):
    rows = [(0, "a.rs", "f", 3, 2.0, None, 6.0, None, [(1, 2)], (0, 1, 2, 3, 4, 5)), (1, "b.rs", "é\n", 4, 1.0, 0.1, 1.7290000000000003, "c", [], None)]
    df = spark.createDataFrame(rows, f"ord long, file string, function string, line long, cyclomatic double, coverage double, crap double, crate string, uncovered {baseline.RANGES}, signals {baseline.SIGNALS}")
    path = str(tmp_path / "run.json")
    baseline.write_report(df, path, "9", try_weight=None, duplicate_groups=[])
    found = baseline.envelope(spark, path)
    assert sorted(map(str, baseline.entries(found).select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert baseline.try_weight(found) == 1.0 and found.first()["duplicate_groups"] == []
    assert set(json.loads(baseline.read_patiently(path))) == {"version", "entries", "duplicate_groups"}
    assert [p.name for p in tmp_path.iterdir()] == ["run.json"]
    assert delta.mismatches(baseline.entries(found).filter("ord = 1"), 0.5, 1.0, ["signals"])[0].startswith("the baseline was recorded with try weight 0.5")


def test_span_text_refuses_other_lines(spark):
    df = spark.createDataFrame([("a\r\nb\nc", 2, 3)], "text string, start_line int, end_line int")
    assert baseline.span_text(df).first()["body"] == "b\nc"
    with pytest.raises(Exception, match="no such lines"):
        baseline.span_text(df.selectExpr("text", "2 AS start_line", "4 AS end_line")).collect()


def test_identity_goes_on_until_nothing_pairs(spark):
    now = spark.createDataFrame([(1, "p/a/x.rs", "f"), (2, "q/a/x.rs", "f"), (3, "m.rs", "g"), (4, "k.rs", "h")], "id long, file string, name string")
    before = spark.createDataFrame([(10, "old/p/a/x.rs", "f"), (20, "a/x.rs", "f"), (30, "n.py", "g"), (50, "k.rs", "z")], "old long, file string, name string")
    # the second pair is only the other's single best once the first is gone
    assert {r["id"]: r["identity"] for r in similarity.aligned(now, before).collect()} == {1: 10, 2: 20, 3: 30, 4: None}


def test_groups_of_pairs_all_or_nothing(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "first long, second long")
    held = spark.createDataFrame([(7, 1), (7, 2), (8, 2), (8, 3)], "grp long, member long")
    assert {tuple(r) for r in similarity.group_of_pairs(pairs, held).collect()} == {(1, 2, 7), (2, 3, 8)}
    assert {r["grp"] for r in similarity.group_of_pairs(pairs, held.filter("grp = 7")).collect()} == {None}


def test_answers():
    class Fault(Exception):
        def __init__(self, retry, after=None):
            self.retry, self.after = retry, after

    calls, waits = [], []

    def answer(q):
        calls.append(q)
        if q == "later" and calls.count(q) < 3:
            raise Fault(True, 99 if calls.count(q) == 2 else None)
        if q == "never":
            raise Fault(False)
        return q.upper()

    got = triage.answered(triage.Stub(answer), [{"k": "a"}, {"k": "later"}, {"k": "never"}], threads=1, sleep=waits.append)
    assert got == [{"k": "A"}, {"k": "LATER"}, None] and waits == [0.5, 10.0] and calls.count("never") == 1


ROWS = [{"file": f"src/a/{n}.rs", "line": k, "name": n, "cc": 12.0, "coverage": c, "crap": s, "status": t, "baseline_crap": b, "uncovered": [{"start": 1, "end": 3}, {"start": 5, "end": 5}]} for k, (n, c, s, t, b) in enumerate([("one", 0.0, 156.0, "regressed", 20.0), ("two|x", None, 40.0, "new", None), ("three", 50.0, 9.0, "improved", 10.5), ("four", 100.0, 2.0, "unchanged", 2.0)], 1)]


def test_cells():
    assert cells.change(0.0004) == "+0.000" and cells.change(0.04) == "+0.040" and cells.change(-3.0) == "-3.0"
    assert cells.ranges([{"start": i, "end": i + (i == 2)} for i in range(1, 6)]) == "1, 2-3, 3 +2 more"
    assert cells.bar(25.0, 10) == "###......." and cells.relative("/w/a/b.rs", "/w") == "a/b.rs"
    assert cells.link("https://x/r/", "v 1", "a b/c.rs", 3) == "https://x/r/blob/v%201/a%20b/c.rs#L3" and cells.link("https://x", "v", "/abs", 1) is None


def test_formats():
    s = {"total": 4, "crappy": 2, "worst_name": "one", "worst_crap": 156.0, "worst_file": "src/a/one.rs"}
    assert all(len(line) <= 50 for line in text.human(ROWS, 50).splitlines()) and "CC" not in text.human(ROWS, 50)
    assert "#####....." in text.human(ROWS, 120) and text.human(ROWS, 90, 7).endswith("… and 7 more\n")
    assert "`two\\|x`" in text.markdown(ROWS, s, 30.0)
    found = text.comment(ROWS * 1, 30.0, most=1)
    assert found.index("### regressed (1)") < found.index("### new over the threshold (1)") < found.index("<summary>improved (1)")
    assert "below `src/a/`" in found and "four" not in found
    assert [r["message"]["text"][:3] for r in json.loads(text.sarif(ROWS, 30.0))["runs"][0]["results"]] == ["one", "two"]
    with pytest.raises(ValueError):
        text.sarif(ROWS, 30.0, compared=True)
    assert [json.loads(text.badge(n))["color"] for n in (0, 5, 6)] == ["brightgreen", "yellow", "red"]
    groups = [{"score": 0.9, "members": list("abcdefg"), "status": "new"}, {"score": 0.8, "members": ["x", "y"], "status": "unchanged"}]
    assert "a, b, c, d, e +2 more" in text.duplicates(groups, compared=True) and "x, y" not in text.duplicates(groups, compared=True)
    reasons = [{"gating": False, "ord": 1, "rank": 1, "name": "f", "file": "a", "signal": "lines", "value": 9, "baseline": 3}, {"gating": True, "ord": 2, "rank": 2, "name": "g", "file": "b", "signal": "stubs", "value": 2, "baseline": None}]
    assert text.reasons(reasons) == "! g (b): stubs 2\n  f (a): lines 3 -> 9\n"
