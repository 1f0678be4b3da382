"""The registered queries of the analytical operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, scoring
from ..operators import coverage, delta, matching, ranking, similarity, triage
from ..render import cells
from ..sources import lcov
from . import analog as A

THRESHOLD = 30.0
GLOBS = ["src/BUILDING/**", "src/*/n1?.rs", "**/n7.rs", "nothing/**"]
ALLOW = ["MACHINERY/n2.rs", "fn_1*"]


def crap_score(spark, d):
    e = A.entries(spark, d)
    return e.select("ord", "file", "name", "cc", "coverage", "crap", scoring.severity(F.col("crap"), THRESHOLD).alias("severity"), scoring.grade(F.col("crap"), THRESHOLD).alias("grade")).orderBy(F.desc("crap"), "ord")


def coverage_span(spark, d):
    return A.entries(spark, d, first=2, last=5).select("ord", "coverage", "crap")


def uncovered_ranges(spark, d):
    r = coverage.uncovered_ranges(A.functions(spark, d), A.lines(spark, d))
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    rows = r.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("first", text.alias("t")))).alias("x"))
    return rows.select("ord", F.array_join(F.transform("x", lambda x: x["t"]), ",").alias("ranges"))


def missing_policy(spark, d):
    parts = [A.entries(spark, d, p).groupBy(F.lit(p).alias("policy")).agg(F.count("*").alias("n"), F.count_if(F.col("coverage").isNull()).alias("unknown"), F.count_if(F.col("crap") > THRESHOLD).alias("crappy")) for p in ("pessimistic", "optimistic", "skip")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def scope_diagnostics(spark, d):
    return coverage.scope(A.functions(spark, d), A.lines(spark, d).filter("path NOT LIKE '%3'"))


def crate_rollup(spark, d):
    return ranking.rollup(A.entries(spark, d), THRESHOLD)


def global_summary(spark, d):
    return ranking.summary(A.entries(spark, d), THRESHOLD)


def top_min_slice(spark, d):
    return ranking.top(A.entries(spark, d), 200, 20.0).select("ord", "file", "name", "crap")


def human_cap(spark, d):
    return ranking.capped(A.entries(spark, d), THRESHOLD).select("ord", "file", "name", "crap")


def comment_cap(spark, d):
    return ranking.per_bucket(A.entries(spark, d), "crate", [F.desc("crap"), "ord"], 25).select("crate", "ord", "rank", "left_out")


def annotations(spark, d):
    """Escaped message of each crappy entry; files and names get characters that must be escaped."""
    e = A.entries(spark, d).filter(F.col("crap") > THRESHOLD)
    file, name = F.concat(F.lit("a,b:50%/"), "file"), F.concat("name", F.lit("\r\n100%, a:b"))
    return e.select("ord", F.concat(F.lit("::warning file="), cells.escaped(file, True), F.lit(",line="), F.col("line").cast("string"), F.lit("::"), cells.escaped(name)).alias("message"))


def page_paths(spark, d):
    p = A.table(spark, d, "pages")
    return p.select(F.col("page_id").alias("id"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


def suffix_join(spark, d):
    q = page_paths(spark, d)
    tail = lambda k: F.array_join(F.slice(paths.parts(F.col("path")), -k, k), "/")
    needles = q.filter("id % 3 = 0").select(tail(2).alias("needle")).unionByName(q.filter("id % 5 = 0").select(tail(1).alias("needle")))
    return matching.suffix_join(q, needles).select("id", "needle")


def crate_attribution(spark, d):
    f = A.functions(spark, d)
    roots = f.select("crate", F.concat(F.lit("src/"), "crate").alias("root")).distinct().unionByName(f.filter("ord % 10 = 0").select(F.concat("crate", F.lit("-sub")).alias("crate"), F.col("file").alias("root")).filter("root LIKE '%n1.rs'").distinct())
    return matching.prefix_join(f.select(F.col("ord").alias("id"), F.col("file").alias("path")), roots).select("id", "crate")


def exclude_globs(spark, d):
    f = A.functions(spark, d)
    return f.select("ord", "file", matching.matched_glob(F.col("file"), GLOBS).alias("glob"))


def unmatched_globs(spark, d):
    return matching.unmatched_globs(A.functions(spark, d), "file", GLOBS)


def allow_filter(spark, d):
    return A.functions(spark, d).filter(~matching.allowed(F.col("file"), F.col("name"), ALLOW)).select("ord", "file", "name")


def compared(spark, d):
    return delta.compare(A.current(spark, d), A.baseline(spark, d))


def delta_full(spark, d):
    return compared(spark, d)[0].select("ord", "status", "baseline_crap", "previous_file")


def delta_removed(spark, d):
    return compared(spark, d)[1]


def delta_counts(spark, d):
    return delta.counts(*compared(spark, d))


def delta_slice(spark, d):
    shown = ranking.top(A.current(spark, d), 300)
    return delta.restrict(compared(spark, d)[0], shown).select("ord", "file", "name", "line", "status")


def signal_rows(spark, d):
    items = A.table(spark, d, "lineitem")
    sums = lambda rows, tail: rows.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias(f"nesting{tail}"), F.count_if(F.col("l_returnflag") == "A").alias(f"stubs{tail}"), F.count_if(F.col("l_linestatus") == "O").alias(f"panics{tail}"), F.count("*").alias(f"lines{tail}"))
    now, before = sums(items, ""), sums(items.filter("l_shipdate < TIMESTAMP'1998-06-01 00:00:00'"), "_before")
    rows = compared(spark, d)[0].select("ord", "status").join(now, F.col("ord") == F.col("l_orderkey")).drop("l_orderkey").join(before, F.col("ord") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return rows


SIGNALS, LIMITS, GATES = ["nesting", "lines", "stubs", "panics"], {"nesting": 4, "lines": 5}, {"nesting", "stubs"}


def delta_reasons(spark, d):
    return delta.reasons(signal_rows(spark, d), SIGNALS, LIMITS, GATES)


def gate_counts(spark, d):
    r = delta_reasons(spark, d)
    return r.agg(F.count_if(F.col("signal") == "crap").alias("regressed"), F.count_if("gating").alias("gating"), F.count_if(F.col("gating") & (F.col("signal") != "crap")).alias("gating_signals"))


def jaccard_pairs(spark, d):
    return similarity.pairs(A.shapes(spark, d), 0.82)


def duplicate_groups(spark, d):
    return similarity.groups(similarity.pairs(A.shapes(spark, d), 0.82))


def members(spark, d, since):
    """A recorded run's groups: orders of a customer as members of a group."""
    o = A.table(spark, d, "orders").filter(F.col("o_orderkey") % since != 0)
    return o.select(F.col("o_custkey").alias("grp"), (F.col("o_orderkey") % 2000).alias("member"))


def novelty(spark, d):
    return similarity.novelty(members(spark, d, 13), members(spark, d, 4))


def resolved(spark, d):
    return similarity.resolved(members(spark, d, 2), members(spark, d, 7))


def asks(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), triage.cache_key(F.col("lang"), F.col("source"), (F.col("n_chars") % 50).cast("string")).alias("key"))


def triage_plan(spark, d):
    a = asks(spark, d)
    return triage.plan(a, a.filter("ord % 9 = 0"), 100).select("ord", "hit", "asked")


def verdict_tally(spark, d):
    """Verdicts from scores of events: valid ones, held under the floor, and their levels."""
    e = A.table(spark, d, "events").select("event_type", (F.col("value") / 100).alias("v"))
    ok = e.withColumn("v", triage.validated(F.col("v"), 0.0, 1.0))
    v = ok.withColumn("verdict", F.when(F.col("v").isNull(), "rejected").otherwise(triage.verdict(F.col("event_type"), F.col("v"), 0.25)))
    return v.groupBy("verdict", triage.level(F.col("v") * 3).alias("level")).agg(F.count("*").alias("n"))


def lcov_parse(spark, d):
    """The coverage lines of orders, written as reports and parsed back."""
    i = A.table(spark, d, "lineitem")
    da = F.concat(F.lit("DA:"), F.col("l_linenumber").cast("string"), F.lit(","), F.when(F.col("l_returnflag") == "R", "0").otherwise("1"))
    rec = i.groupBy("l_orderkey").agg(F.array_join(F.collect_list(da), "\n").alias("body"))
    text = F.concat(F.lit("DA:9,9\nSF:o"), F.col("l_orderkey").cast("string"), F.lit("\nFN:1,x\n"), F.col("body"), F.lit("\nend_of_record\nDA:8,8"))
    reports = rec.groupBy((F.col("l_orderkey") % 64).alias("report")).agg(F.array_join(F.collect_list(text), "\n").alias("text"))
    return lcov.parsed(reports).select("path", "line", F.col("hits").cast("long").alias("hits"))


def file_rows(spark, d):
    return A.table(spark, d, "documents").select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.length("text").cast("long").alias("length"), F.md5("text").alias("hash"))


def cache_incremental(spark, d):
    f = file_rows(spark, d)
    stale = f.withColumn("hash", F.when(F.col("length") % 4 == 0, F.lit("x")).otherwise(F.col("hash"))).filter("length % 7 <> 0")
    return lcov.incremental(f, stale).select("path", "length")


def cache_evict(spark, d):
    return lcov.evicted(file_rows(spark, d), ["en", "fr/src1"], ["en/src2", "fr"]).select("path")


def html_nesting(spark, d):
    """Depth of nested tags of each page: the largest running sum of opening and closing tags."""
    tags = F.regexp_extract_all("html", F.lit("(</?(?:div|ul|li|p|nav|article|body|html|head)[ >])"), F.lit(1))
    step = F.transform(tags, lambda t: F.when(t.startswith("</"), F.lit(-1)).otherwise(F.lit(1)))
    state = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    most = F.aggregate(step, state, lambda s, x: F.struct((s["d"] + x).alias("d"), F.greatest(s["m"], s["d"] + x).alias("m")), lambda s: s["m"])
    return A.table(spark, d, "pages").select("page_id", most.cast("long").alias("nesting"))


ROWS = A.scored_sql()
ORACLES = {
    "crap_score": f"WITH {ROWS} SELECT ord, file, name, cc, coverage, crap, CASE WHEN crap > 30 THEN 'crappy' ELSE 'clean' END AS severity, CASE WHEN crap > 30 THEN 'high' WHEN crap > 10 THEN 'moderate' ELSE 'low' END AS grade FROM e",
    "coverage_span": f"WITH {A.scored_sql(2, 5)} SELECT ord, coverage, crap FROM e",
    "uncovered_ranges": f"""WITH {A.FUNCTIONS}, x AS (SELECT f.ord, l.line, l.hits, count(*) FILTER (hits > 0) OVER (PARTITION BY f.ord ORDER BY l.line ROWS UNBOUNDED PRECEDING) AS i FROM f JOIN l USING (path) WHERE l.line BETWEEN 1 AND 7),
      y AS (SELECT ord, min(line) AS a, max(line) AS b FROM x WHERE hits = 0 GROUP BY ord, i) SELECT ord, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM y GROUP BY 1""",
    "missing_policy": " UNION ALL ".join(f"SELECT * FROM (WITH {A.scored_sql(policy=p)} SELECT '{n}' AS policy, count(*)::BIGINT AS n, count(*) FILTER (coverage IS NULL)::BIGINT AS unknown, count(*) FILTER (crap > 30)::BIGINT AS crappy FROM e)" for n, p in (("pessimistic", "coalesce(coverage, 0::DOUBLE)"), ("optimistic", "coalesce(coverage, 100::DOUBLE)"), ("skip", "coverage"))),
    "scope_diagnostics": f"""WITH {A.FUNCTIONS}, a AS (SELECT DISTINCT path FROM f), b AS (SELECT DISTINCT path FROM l WHERE path NOT LIKE '%3'), j AS (SELECT a.path AS x, b.path AS y FROM a FULL JOIN b ON a.path = b.path)
      SELECT count(x)::BIGINT AS analysed, count(y)::BIGINT AS reported, count(*) FILTER (x = y)::BIGINT AS matched, count(*) FILTER (y IS NULL)::BIGINT AS source_only, count(*) FILTER (x IS NULL)::BIGINT AS report_only,
      (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT x FROM j WHERE y IS NULL ORDER BY x LIMIT 10)) AS examples,
      coalesce((SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT y FROM j WHERE x IS NULL ORDER BY y LIMIT 10)), '') AS report_examples FROM j""",
    "crate_rollup": f"WITH {ROWS} SELECT crate, count(*)::BIGINT AS total, count(*) FILTER (crap > 30)::BIGINT AS crappy FROM e GROUP BY 1",
    "global_summary": f"""WITH {ROWS}, w AS (SELECT * FROM e ORDER BY crap DESC, ord LIMIT 1), tot AS (SELECT count(*)::BIGINT AS total, count(*) FILTER (crap > 30)::BIGINT AS crappy FROM e)
      SELECT total, crappy, w.file AS worst_file, w.name AS worst_name, w.crap AS worst_crap, CASE WHEN crappy > 0 THEN 1 ELSE 0 END AS exit_code, CASE WHEN crappy = 0 THEN 'brightgreen' WHEN crappy <= 5 THEN 'yellow' ELSE 'red' END AS colour FROM tot, w""",
    "top_min_slice": f"WITH {ROWS} SELECT ord, file, name, crap FROM (SELECT * FROM e ORDER BY crap DESC, ord LIMIT 200) WHERE crap >= 20",
    "human_cap": f"WITH {ROWS} SELECT ord, file, name, crap FROM e WHERE crap > 30 UNION ALL SELECT ord, file, name, crap FROM (SELECT * FROM e WHERE crap <= 30 ORDER BY crap DESC, file, name, line, ord LIMIT 10)",
    "comment_cap": f"WITH {ROWS}, r AS (SELECT crate, ord, row_number() OVER (PARTITION BY crate ORDER BY crap DESC, ord)::INTEGER AS rank, greatest(count(*) OVER (PARTITION BY crate) - 25, 0)::BIGINT AS left_out FROM e) SELECT * FROM r WHERE rank <= 25",
    "annotations": f"""WITH {ROWS}, x AS (SELECT *, replace('a,b:50%/' || file, '%', '%25') AS p, replace(name || chr(13) || chr(10) || '100%, a:b', '%', '%25') AS m FROM e WHERE crap > 30)
      SELECT ord, '::warning file=' || replace(replace(p, ':', '%3A'), ',', '%2C') || ',line=' || line || '::' || replace(replace(m, chr(13), '%0D'), chr(10), '%0A') AS message FROM x""",
    "suffix_join": """WITH q AS (SELECT page_id AS id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS raw FROM pages),
      p AS (SELECT id, list_filter(string_split(raw, '/'), lambda x: x <> '') AS c FROM q),
      n AS (SELECT array_to_string(c[-2:], '/') AS needle FROM p WHERE id % 3 = 0 UNION SELECT c[-1] FROM p WHERE id % 5 = 0),
      m AS (SELECT p.id, needle, row_number() OVER (PARTITION BY p.id ORDER BY length(needle) - length(replace(needle, '/', '')) DESC) AS r FROM p JOIN n ON array_to_string(c, '/') = needle OR suffix(array_to_string(c, '/'), '/' || needle))
      SELECT q.id, m.needle FROM q LEFT JOIN m ON q.id = m.id AND r = 1""",
    "crate_attribution": f"""WITH {A.FUNCTIONS}, r AS (SELECT DISTINCT crate, 'src/' || crate AS root FROM f UNION SELECT DISTINCT crate || '-sub', file FROM f WHERE ord % 10 = 0 AND file LIKE '%n1.rs'),
      m AS (SELECT f.ord, r.crate, row_number() OVER (PARTITION BY f.ord ORDER BY length(root) DESC) AS k FROM f JOIN r ON f.file = root OR starts_with(f.file, root || '/')) SELECT f.ord AS id, m.crate FROM f LEFT JOIN m ON f.ord = m.ord AND k = 1""",
    "exclude_globs": f"WITH {A.FUNCTIONS} SELECT ord, file, CASE WHEN file LIKE 'src/BUILDING/%' THEN 'src/BUILDING/**' WHEN regexp_full_match(file, 'src/[^/]*/n1[^/][.]rs') THEN 'src/*/n1?.rs' WHEN file LIKE '%/n7.rs' THEN '**/n7.rs' END AS glob FROM f",
    "unmatched_globs": f"""WITH {A.FUNCTIONS}, g AS (SELECT unnest(['src/BUILDING/**', 'src/*/n1?.rs', '**/n7.rs', 'nothing/**']) AS pat, unnest(['src/BUILDING/.*', 'src/[^/]*/n1[^/][.]rs', '(.*/)?n7[.]rs', 'nothing/.*']) AS re)
      SELECT pat AS "glob" FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE regexp_full_match(f.file, g.re))""",
    "allow_filter": f"WITH {A.FUNCTIONS} SELECT ord, file, name FROM f WHERE NOT (file LIKE '%/MACHINERY/n2.rs' OR name LIKE 'fn\\_1%' ESCAPE '\\')",
    "delta_full": f"WITH {A.DELTA} SELECT ord, status, baseline_crap, previous_file FROM delta",
    "delta_removed": f"WITH {A.DELTA} SELECT * FROM removed",
    "delta_counts": f"WITH {A.DELTA} SELECT count(*) FILTER (status = 'regressed')::BIGINT AS regressed, count(*) FILTER (status = 'improved')::BIGINT AS improved, count(*) FILTER (status = 'new')::BIGINT AS new, count(*) FILTER (status = 'unchanged')::BIGINT AS unchanged, count(*) FILTER (status = 'moved')::BIGINT AS moved, (SELECT count(*)::BIGINT FROM removed) AS removed FROM delta",
    "delta_slice": f"WITH {A.DELTA}, shown AS (SELECT DISTINCT file, name, line FROM (SELECT * FROM cur ORDER BY crap DESC, ord LIMIT 300)) SELECT ord, file, name, line, status FROM delta JOIN shown USING (file, name, line)",
    "jaccard_pairs": """WITH s AS (SELECT DISTINCT doc_id AS id, unnest(string_split(text, chr(10))) AS shape FROM documents), n AS (SELECT id, count(*) AS n FROM s WHERE shape <> '' GROUP BY 1 HAVING count(*) >= 2),
      c AS (SELECT a.id AS first, b.id AS second, count(*) AS c FROM s a JOIN s b ON a.shape = b.shape AND a.id < b.id AND a.shape <> '' GROUP BY 1, 2)
      SELECT first, second, c::DOUBLE / (x.n + y.n - c) AS score FROM c JOIN n x ON first = x.id JOIN n y ON second = y.id WHERE c::DOUBLE / (x.n + y.n - c) >= 0.82::DOUBLE""",
    "novelty": """WITH g AS (SELECT o_custkey AS grp, o_orderkey % 2000 AS m, count(*) AS c FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY 1, 2), h AS (SELECT o_custkey AS old, o_orderkey % 2000 AS m, count(*) AS c FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2),
      k AS (SELECT grp, max(held) AS held FROM (SELECT grp, old, sum(least(g.c, h.c)) AS held FROM g JOIN h USING (m) GROUP BY 1, 2) GROUP BY 1), z AS (SELECT grp, sum(c)::BIGINT AS size FROM g GROUP BY 1)
      SELECT z.grp, size, CASE WHEN coalesce(held, 0) < 2 THEN 'new' WHEN held = size THEN 'unchanged' ELSE 'grown' END AS status, CASE WHEN held >= 2 AND held <> size THEN held::BIGINT END AS grown_from FROM z LEFT JOIN k ON z.grp = k.grp""",
    "resolved": """WITH a AS (SELECT DISTINCT o_custkey AS grp, o_orderkey % 2000 AS m FROM orders WHERE o_orderkey % 2 <> 0), b AS (SELECT o_custkey AS grp, o_orderkey % 2000 AS m FROM orders WHERE o_orderkey % 7 <> 0),
      t AS (SELECT DISTINCT old FROM (SELECT b.grp AS old, a.grp FROM a JOIN (SELECT DISTINCT * FROM b) b USING (m) GROUP BY 1, 2 HAVING count(*) >= 2)) SELECT grp, count(*)::BIGINT AS size FROM b WHERE grp NOT IN (SELECT old FROM t) GROUP BY 1 HAVING count(*) >= 2""",
    "triage_plan": """WITH a AS (SELECT doc_id AS ord, length(lang) || ':' || lang || length(source) || ':' || source || length((n_chars % 50)::VARCHAR) || ':' || (n_chars % 50) AS key FROM documents), h AS (SELECT ord, key IN (SELECT key FROM a WHERE ord % 9 = 0) AS hit FROM a)
      SELECT ord, hit, NOT hit AND row_number() OVER (PARTITION BY hit ORDER BY ord) <= 100 AS asked FROM h""",
    "verdict_tally": """WITH e AS (SELECT event_type, CASE WHEN value / 100 BETWEEN -1e-9 AND 1 + 1e-9 THEN greatest(0::DOUBLE, least(1::DOUBLE, value / 100)) END AS v FROM events)
      SELECT CASE WHEN v IS NULL THEN 'rejected' WHEN v < 0.25::DOUBLE THEN 'uncertain' ELSE event_type END AS verdict, round(v * 3)::BIGINT AS level, count(*)::BIGINT AS n FROM e GROUP BY 1, 2""",
    "lcov_parse": "SELECT 'o' || l_orderkey AS path, l_linenumber AS line, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END)::BIGINT AS hits FROM lineitem GROUP BY 1, 2",
    "cache_incremental": "SELECT lang || '/' || source || '/' || doc_id AS path, length(text)::BIGINT AS length FROM documents WHERE length(text) % 7 = 0 OR length(text) % 4 = 0",
    "cache_evict": "SELECT lang || '/' || source || '/' || doc_id AS path FROM documents WHERE NOT (lang = 'en' AND source <> 'src2') AND NOT (lang = 'fr' AND source = 'src1')",
    "html_nesting": """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(</?(?:div|ul|li|p|nav|article|body|html|head)[ >])')) AS t, generate_subscripts(regexp_extract_all(html, '(</?(?:div|ul|li|p|nav|article|body|html|head)[ >])'), 1) AS i FROM pages),
      s AS (SELECT page_id, sum(CASE WHEN starts_with(t, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS d FROM t), m AS (SELECT page_id, max(d) AS m FROM s GROUP BY 1) SELECT p.page_id, greatest(0, coalesce(m, 0))::BIGINT AS nesting FROM pages p LEFT JOIN m ON p.page_id = m.page_id""",
}
SIGNAL_SQL = f"""{A.DELTA}, now AS (SELECT l_orderkey AS o, count(DISTINCT l_suppkey) AS nesting, count(*) AS lines, count(*) FILTER (l_returnflag = 'A') AS stubs, count(*) FILTER (l_linestatus = 'O') AS panics FROM lineitem GROUP BY 1),
  bef AS (SELECT l_orderkey AS o, count(DISTINCT l_suppkey) AS nesting, count(*) AS lines, count(*) FILTER (l_returnflag = 'A') AS stubs, count(*) FILTER (l_linestatus = 'O') AS panics FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1),
  w AS (SELECT delta.ord, status, now.*, bef.nesting AS b1, bef.lines AS b2, bef.stubs AS b3, bef.panics AS b4 FROM delta JOIN now ON delta.ord = now.o LEFT JOIN bef ON delta.ord = bef.o),
  z AS (SELECT ord, 0 AS rank, 'crap' AS signal, NULL::BIGINT AS value, NULL::BIGINT AS baseline, true AS gating FROM w WHERE status = 'regressed'
  UNION ALL SELECT ord, 1, 'nesting', nesting, b1, true FROM w WHERE CASE WHEN status = 'new' THEN nesting > 4 ELSE nesting > b1 END
  UNION ALL SELECT ord, 2, 'lines', lines, b2, status = 'new' FROM w WHERE CASE WHEN status = 'new' THEN lines > 5 ELSE lines > b2 END
  UNION ALL SELECT ord, 3, 'stubs', stubs, b3, true FROM w WHERE CASE WHEN status = 'new' THEN stubs > 0 ELSE stubs > b3 END
  UNION ALL SELECT ord, 4, 'panics', panics, b4, false FROM w WHERE CASE WHEN status = 'new' THEN panics > 0 ELSE panics > b4 END)"""
ORACLES |= {
    "delta_reasons": f"WITH {SIGNAL_SQL} SELECT * FROM z",
    "gate_counts": f"WITH {SIGNAL_SQL} SELECT count(*) FILTER (signal = 'crap')::BIGINT AS regressed, count(*) FILTER (gating)::BIGINT AS gating, count(*) FILTER (gating AND signal <> 'crap')::BIGINT AS gating_signals FROM z",
}


def queries() -> dict:
    return {f.__name__: f for f in (
        crap_score, coverage_span, uncovered_ranges, missing_policy, scope_diagnostics, crate_rollup, global_summary, top_min_slice, human_cap, comment_cap, annotations, suffix_join, crate_attribution, exclude_globs, unmatched_globs,
        allow_filter, delta_full, delta_removed, delta_counts, delta_slice, delta_reasons, gate_counts, jaccard_pairs, duplicate_groups, novelty, resolved, triage_plan, verdict_tally, lcov_parse, cache_incremental, cache_evict, html_nesting,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
