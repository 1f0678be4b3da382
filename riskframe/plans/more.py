"""Further queries: files, members, recorded runs, source text, duplicates. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import shared
from ..operators import coverage, delta, matching, ranking, scope, similarity, triage
from ..sources import baseline as recorded
from ..sources import code, lcov
from . import analog as A
from . import catalog as C

ROOTS = ["src/MACHINERY", "src", "old"]


def path_index(spark, d):
    """Coverage lines under several spellings of a path: some can be resolved, the others are told by their components."""
    spelled = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("./o"), "l_orderkey")).when(F.col("l_orderkey") % 5 == 0, F.lit("./")).otherwise(F.concat(F.lit("o\\"), "l_orderkey"))
    lines = A.table(spark, d, "lineitem").select(spelled.alias("path"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).cast("long").alias("hits"))
    canonical = lines.filter("path LIKE '%7'").select("path").distinct().withColumn("canon", F.concat(F.lit("/w/"), F.substring("path", 3, 99)))
    return matching.path_index(lines, canonical)


def resolved_paths(spark, d):
    q = C.page_paths(spark, d)
    index = q.filter("id % 3 = 0").select(F.lit("suffix").alias("tier"), F.element_at(F.split("path", "/"), -1).alias("key")).filter("key <> ''")
    index = index.unionByName(q.filter("id % 4 = 0").select(F.lit("exact").alias("tier"), F.col("path").alias("key")))
    return matching.resolved_paths(q.withColumn("canon", F.when(F.col("id") % 2 == 0, F.col("path"))), index).select("id", "tier", "key")


def lcov_files(spark, d):
    """Files of reports, of which some have no lines."""
    o = A.table(spark, d, "orders").select("o_orderkey")
    body = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("DA:1,1\n")
    text = F.concat(F.lit("TN:\nSF:o"), F.col("o_orderkey").cast("string"), F.lit("\n"), body, F.lit("end_of_record\n"))
    reports = o.groupBy((F.col("o_orderkey") % 64).cast("string").alias("report")).agg(F.array_join(F.collect_list(text), "").alias("text"))
    files, lines = lcov.files(reports), lcov.parsed(reports)
    return files.join(lines.groupBy("path").agg(F.count("*").alias("lines")), "path", "left").select("path", F.coalesce("lines", F.lit(0)).alias("lines"))


def cache_header(spark, d):
    f = C.file_rows(spark, d)
    n = F.col("length")
    head = {"format": F.when(n % 5 == 0, 1).otherwise(2), "version": F.lit("1.0"), "program": F.lit("p"), "weight": F.when(n % 3 == 0, 0.5).otherwise(1.0)}
    return lcov.incremental(f, f.withColumns(head), {"format": 2, "version": "1.0", "program": "p", "weight": 1.0}).select("path")


def exclude_bases(spark, d):
    """User globs are tried below the workspace too, member globs below the walked root only."""
    f = A.functions(spark, d)
    below = scope.below_deepest(F.col("file"), ROOTS)
    return f.select("ord", scope.excluded_by(below, F.col("file"), ["n1[0-4].rs", "src/**"], ["src/{HOUSEHOLD,FURNITURE}/n?.rs"]).alias("glob"))


def baseline_kept(spark, d):
    allowed = matching.allowed(F.col("file"), F.col("name"), C.ALLOW)
    return scope.baseline_kept(A.baseline(spark, d), ROOTS, ["MACHINERY/*1.rs", "n[23].rs", "gone/**"], allowed).select("ord", "file")


def member_rows(spark, d):
    f = A.functions(spark, d).select(F.col("ord").alias("id"), "file")
    moved = F.when(F.col("id") % 4 == 0, F.concat(F.lit("/ci/build/"), "file")).otherwise(F.col("file"))
    return f.select("id", moved.alias("file"))


def members(spark):
    rows = [("root", "", False), ("build", "src/BUILDING", True), ("deep", "src/BUILDING/n1.rs", False), ("auto", "src/AUTOMOBILE", False), ("tail", "AUTOMOBILE/n2.rs", True), ("house", "src/HOUSEHOLD", True)]
    return spark.createDataFrame(rows, "name string, dir string, selected boolean")


def member_scope(spark, d):
    return scope.member_scope(member_rows(spark, d), members(spark)).select("id")


def nested_excludes(spark, d):
    f = A.functions(spark, d)
    dirs = f.select(F.concat(F.lit("src/"), "crate").alias("dir")).unionByName(f.filter("ord % 10 = 0").select(F.col("file").alias("dir"))).distinct()
    return scope.nested_excludes(dirs.select(F.col("dir").alias("name"), "dir"))


def changed_rows(spark, d):
    return delta.changed_only(C.compared(spark, d)[0]).select("ord", "status")


def baseline_rebase(spark, d):
    b = A.baseline(spark, d).withColumn("file", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("/abs/"), "file")).otherwise(F.col("file")))
    return delta.rebased(b, "/w/").select("ord", "file")


def human_cap_delta(spark, d):
    return ranking.pinned(C.compared(spark, d)[0], 100.0).select("ord", "status", "crap")


def file_order(spark, d):
    first = ranking.ordered(A.entries(spark, d), "file").limit(100)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("file", "name", "line", "ord"))).select("rank", "ord")


def summary_by_file(spark, d):
    return ranking.summary(A.entries(spark, d), C.THRESHOLD, "file").select("total", "worst_file", "worst_name", "worst_crap")


def baseline_read(spark, d):
    """A recorded run, written as envelopes and read back without loss."""
    e = A.entries(spark, d).select("file", F.col("name").alias("function"), "line", F.col("cc").alias("cyclomatic"), "coverage", "crap", "crate", "ord")
    parts = recorded.entry_json(e).groupBy(F.pmod("ord", F.lit(16)).alias("part")).agg(F.concat(F.lit('{"version": "1", "unknown": [1], "entries": ['), F.array_join(F.collect_list("json"), ","), F.lit("]}")).alias("value"))
    folder = shared.folder(spark)
    parts.repartition("part").write.partitionBy("part").text(folder)  # an envelope a file
    return recorded.entries(recorded.envelope(spark, folder)).select("file", "function", "line", "cyclomatic", "coverage", "crap", "crate")


def span_text(spark, d):
    rows = A.table(spark, d, "documents").withColumns({"start_line": F.lit(1), "end_line": F.least(F.lit(2), F.size(F.split("text", "\n")))})
    return recorded.span_text(rows).select("doc_id", "body")


def sources(spark, d):
    """Rust text of orders: a condition with a call that can panic for each large line, else a stub; a test and a nested function, which do not count."""
    i = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_shipdate")
    stmt = F.when(F.col("l_quantity") >= 10, "    if a && b { c.unwrap(); }\n").otherwise("    todo!(\"if x || y {}\");\n")
    item = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_shipdate", stmt.alias("s"))))
    body = F.array_join(F.transform(item, lambda x: x["s"]), "")
    tail = "    fn inner() { if z {} }\n}\n#[test]\nfn t() { if a {} }\n"
    one = i.groupBy("l_orderkey").agg(F.concat(F.lit("fn f"), F.first("l_orderkey").cast("string"), F.lit("(a: bool) {\n"), body, F.lit(tail)).alias("text"))
    return one.groupBy(F.concat(F.lit("g"), (F.col("l_orderkey") % 200).cast("string"), F.lit(".rs")).alias("file")).agg(F.array_join(F.collect_list("text"), "").alias("text"))


def code_functions(spark, d):
    f = code.measured(code.parsed(sources(spark, d)), 0.5)
    return f.select("file", "name", "cc", (F.col("end_line") - F.col("start_line")).cast("long").alias("length"), *[F.col(f"signals.{s}").alias(s) for s in ("nesting", "bumps", "bool_ops", "stubs", "panics")])


def code_shapes(spark, d):
    """How many functions have an equal set of shapes: those of an equal row of statements."""
    s = code.shapes(sources(spark, d)).filter("name <> 'inner'")
    return s.groupBy("shapes", "node_count").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("sets")).select("n", "sets")


def pair_order(spark, d):
    p = similarity.pairs(A.shapes(spark, d), 0.82)
    first = similarity.pair_order(p).limit(50)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "first", "second"))).select("rank", "first", "second")


def pair_groups(spark, d):
    o = A.table(spark, d, "orders")
    held = o.filter("o_orderkey % 5 <> 0").select(F.col("o_custkey").alias("grp"), (F.col("o_orderkey") % 500).alias("member"))
    pairs = held.alias("a").join(held.alias("b"), "grp").filter("a.member < b.member AND (a.member + b.member) % 7 = 0").select(F.col("a.member").alias("first"), F.col("b.member").alias("second")).distinct()
    return similarity.group_of_pairs(pairs, held)


def triage_asks(spark, d):
    return triage.ask_set(C.novelty(spark, d), True).select("grp", "status")


def scope_two_sides(spark, d):
    return coverage.scope(A.functions(spark, d).filter("ord % 9 <> 0"), A.lines(spark, d).filter("path NOT LIKE '%3'"))


RESOLVED = """WITH q AS (SELECT page_id AS id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
  k AS (SELECT DISTINCT string_split(path, '/')[-1] AS key FROM q WHERE id % 3 = 0 AND string_split(path, '/')[-1] <> ''),
  p AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS c FROM q), x AS (SELECT DISTINCT path FROM q WHERE id % 4 = 0)
  SELECT p.id, CASE WHEN id % 2 = 0 AND x.path IS NOT NULL THEN 'exact' WHEN k.key IS NOT NULL THEN 'suffix' END AS tier,
  CASE WHEN id % 2 = 0 AND x.path IS NOT NULL THEN x.path ELSE k.key END AS key FROM p LEFT JOIN x ON p.path = x.path LEFT JOIN k ON c[-1] = k.key"""
MEMBERS = f"""WITH {A.FUNCTIONS}, r AS (SELECT ord AS id, CASE WHEN ord % 4 = 0 THEN '/ci/build/' || file ELSE file END AS file FROM f)
  SELECT id FROM r WHERE CASE WHEN id % 4 <> 0 THEN (starts_with(file, 'src/BUILDING/') AND file <> 'src/BUILDING/n1.rs') OR starts_with(file, 'src/HOUSEHOLD/')
  ELSE (contains(file, 'src/BUILDING/') AND NOT contains(file, 'src/BUILDING/n1.rs')) OR contains(file, 'src/HOUSEHOLD/') OR (contains(file, 'AUTOMOBILE/n2.rs')) END"""
CODE = """WITH i AS (SELECT l_orderkey AS o, count(*) AS n, count(*) FILTER (l_quantity >= 10) AS k FROM lineitem GROUP BY 1)
  SELECT 'g' || (o % 200) || '.rs' AS file, 'f' || o AS name, 1::DOUBLE + 2 * k AS cc, (n + 2)::BIGINT AS length, (k > 0)::BIGINT AS nesting, 0::BIGINT AS bumps,
  (k > 0)::BIGINT AS bool_ops, (n - k)::BIGINT AS stubs, k::BIGINT AS panics FROM i"""
PAIRS = C.ORACLES["jaccard_pairs"]
ORACLES = {
    "path_index": """WITH x AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN './o' || l_orderkey WHEN l_orderkey % 5 = 0 THEN './' ELSE 'o\\' || l_orderkey END AS path, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS hits FROM lineitem),
      y AS (SELECT CASE WHEN path LIKE '%7' THEN 'exact' ELSE 'suffix' END AS tier, CASE WHEN path LIKE '%7' THEN '/w/' || substr(path, 3) WHEN path LIKE './%' THEN substr(path, 3) ELSE replace(path, '\\', '/') END AS key, line, hits FROM x)
      SELECT tier, key, line, sum(hits)::BIGINT AS hits FROM y WHERE key <> '' GROUP BY 1, 2, 3""",
    "resolved_paths": RESOLVED,
    "lcov_files": "SELECT 'o' || o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS lines FROM orders",
    "cache_header": "SELECT lang || '/' || source || '/' || doc_id AS path FROM documents WHERE length(text) % 5 = 0 OR length(text) % 3 = 0",
    "exclude_bases": f"""WITH {A.FUNCTIONS}, g AS (SELECT *, CASE WHEN starts_with(file, 'src/MACHINERY/') THEN substr(file, 15) ELSE substr(file, 5) END AS below FROM f)
      SELECT ord, CASE WHEN regexp_full_match(below, 'n1[0-4][.]rs') THEN 'n1[0-4].rs' WHEN regexp_full_match(file, 'src/(HOUSEHOLD|FURNITURE)/n[^/][.]rs') THEN 'src/{{HOUSEHOLD,FURNITURE}}/n?.rs' END AS glob FROM g""",
    "baseline_kept": f"""WITH {A.DELTA} SELECT ord, file FROM b WHERE NOT (starts_with(file, 'src/MACHINERY/') AND regexp_full_match(file, '.*/n[23][.]rs'))
      AND NOT regexp_full_match(file, 'old/MACHINERY/[^/]*1[.]rs') AND NOT starts_with(file, 'gone/') AND NOT (file LIKE '%/MACHINERY/n2.rs' OR name LIKE 'fn\\_1%' ESCAPE '\\')""",
    "member_scope": MEMBERS,
    "nested_excludes": f"""WITH {A.FUNCTIONS}, m AS (SELECT DISTINCT 'src/' || crate AS dir FROM f UNION SELECT DISTINCT file FROM f WHERE ord % 10 = 0)
      SELECT a.dir AS name, substr(b.dir, length(a.dir) + 2) || '/**' AS glob FROM m a JOIN m b ON starts_with(b.dir, a.dir || '/')""",
    "changed_rows": f"WITH {A.DELTA} SELECT ord, status FROM delta WHERE status <> 'unchanged'",
    "baseline_rebase": f"WITH {A.DELTA} SELECT ord, CASE WHEN ord % 2 = 0 THEN '/abs/' || file ELSE '/w/' || file END AS file FROM b",
    "human_cap_delta": f"""WITH {A.DELTA}, rest AS (SELECT * FROM delta WHERE crap <= 100 AND status <> 'regressed' ORDER BY crap DESC, file, name, line, ord LIMIT 10)
      SELECT ord, status, crap FROM delta WHERE crap > 100 OR status = 'regressed' UNION ALL SELECT ord, status, crap FROM rest""",
    "file_order": f"WITH {C.ROWS} SELECT row_number() OVER (ORDER BY file, name, line, ord)::INTEGER AS rank, ord FROM e ORDER BY rank LIMIT 100",
    "summary_by_file": f"""WITH {C.ROWS}, w AS (SELECT * FROM e ORDER BY file, name, line, ord LIMIT 1) SELECT (SELECT count(*)::BIGINT FROM e) AS total, file AS worst_file, name AS worst_name, crap AS worst_crap FROM w""",
    "baseline_read": f"WITH {C.ROWS} SELECT file, name AS function, line, cc AS cyclomatic, coverage, crap, crate FROM e",
    "span_text": "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS body FROM documents",
    "code_functions": CODE,
    "code_shapes": """WITH i AS (SELECT l_orderkey AS o, string_agg(CASE WHEN l_quantity >= 10 THEN 'a' ELSE 'b' END, '' ORDER BY l_linenumber, l_partkey, l_quantity, l_shipdate) AS p FROM lineitem GROUP BY 1),
      g AS (SELECT p, count(*) AS n FROM i GROUP BY 1) SELECT n::BIGINT AS n, count(*)::BIGINT AS sets FROM g GROUP BY 1""",
    "pair_order": f"SELECT row_number() OVER (ORDER BY score DESC, first, second)::INTEGER AS rank, first, second FROM ({PAIRS}) ORDER BY rank LIMIT 50",
    "pair_groups": """WITH h AS (SELECT DISTINCT o_custkey AS grp, o_orderkey % 500 AS member FROM orders WHERE o_orderkey % 5 <> 0)
      SELECT a.member AS first, b.member AS second, min(grp) AS grp FROM h a JOIN h b USING (grp) WHERE a.member < b.member AND (a.member + b.member) % 7 = 0 GROUP BY 1, 2""",
    "triage_asks": f"SELECT grp, status FROM ({C.ORACLES['novelty']}) WHERE status <> 'unchanged'",
    "scope_two_sides": f"""WITH {A.FUNCTIONS}, a AS (SELECT DISTINCT path FROM f WHERE ord % 9 <> 0), b AS (SELECT DISTINCT path FROM l WHERE path NOT LIKE '%3'), j AS (SELECT a.path AS x, b.path AS y FROM a FULL JOIN b ON a.path = b.path)
      SELECT count(x)::BIGINT AS analysed, count(y)::BIGINT AS reported, count(*) FILTER (x = y)::BIGINT AS matched, count(*) FILTER (y IS NULL)::BIGINT AS source_only, count(*) FILTER (x IS NULL)::BIGINT AS report_only,
      (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT x FROM j WHERE y IS NULL ORDER BY x LIMIT 10)) AS examples, (SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT y FROM j WHERE x IS NULL ORDER BY y LIMIT 10)) AS report_examples FROM j""",
}


def queries() -> dict:
    return {name: globals()[name] for name in ORACLES}
