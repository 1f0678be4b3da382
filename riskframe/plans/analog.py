"""The analytical relations, built from the star-schema tables: an order is a function, its line items are its lines."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import coverage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") >= 10).alias("decisions"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.concat(F.lit("src/"), "c_mktsegment", F.lit("/n"), F.col("c_nationkey").cast("string"), F.lit(".rs")).alias("file"),
        F.concat(F.lit("fn_"), (F.col("o_orderkey") % 97).cast("string")).alias("name"), (F.col("o_orderkey") % 50 + 1).cast("long").alias("line"), F.col("c_mktsegment").alias("crate"), F.lit(1).alias("start_line"), F.lit(7).alias("end_line"),
        (F.lit(1.0) + F.coalesce("decisions", F.lit(0))).alias("cc"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    hits = F.sum(F.when(F.col("l_returnflag") == "R", 0).otherwise(1))
    return items.groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"), F.col("l_linenumber").alias("line")).agg(hits.alias("hits"))


def entries(spark: SparkSession, sf_dir: str, policy: str = "pessimistic", first: int = 1, last: int = 7) -> DataFrame:
    f = functions(spark, sf_dir).withColumns({"start_line": F.lit(first), "end_line": F.lit(last)})
    scored = coverage.span_coverage(f, lines(spark, sf_dir))
    assumed = scoring.assumed(F.col("coverage"), policy)
    return scored.withColumn("crap", scoring.crap(F.col("cc"), assumed)).filter("crap IS NOT NULL")


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded run: fewer lines, some files renamed, some lines shifted, some functions elsewhere or not there yet."""
    old = table(spark, sf_dir, "lineitem").filter("l_shipdate < TIMESTAMP'1998-06-01 00:00:00'").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") >= 10).alias("decisions"))
    rows = functions(spark, sf_dir).drop("cc").join(old, F.col("ord") == F.col("l_orderkey"), "left").filter("ord % 7 <> 0")
    solo = F.col("ord") % 500 == 1
    file = F.when(solo, F.concat(F.lit("gone/x"), F.col("ord").cast("string"), F.lit(".py"))).when(F.col("file").rlike("n[0-9]*5[.]"), F.concat(F.lit("old/"), F.substring("file", 5, 1000))).otherwise(F.col("file"))
    cc = F.lit(1.0) + F.coalesce("decisions", F.lit(0))
    return rows.select(file.alias("file"), solo_name().alias("name"), F.when(F.col("ord") % 6 == 0, F.col("line") + 100).otherwise(F.col("line")).alias("line"), (cc * cc + cc).alias("crap"), "ord")


def solo_name():
    return F.when(F.col("ord") % 500 == 1, F.concat(F.lit("solo_"), F.col("ord").cast("string"))).otherwise(F.col("name"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = functions(spark, sf_dir).filter("ord % 11 <> 0")
    return rows.select("file", solo_name().alias("name"), "line", (F.col("cc") * F.col("cc") + F.col("cc")).alias("crap"), "ord")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct non-empty lines of each document."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("shape"))
    return rows.filter("shape <> ''")


#: The same relations in DuckDB.
FUNCTIONS = """
f AS (SELECT o_orderkey AS ord, 'o' || o_orderkey AS path, 'src/' || c_mktsegment || '/n' || c_nationkey || '.rs' AS file, 'fn_' || (o_orderkey % 97) AS name,
  (o_orderkey % 50 + 1)::BIGINT AS line, c_mktsegment AS crate, 1::DOUBLE + coalesce(d, 0) AS cc
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_quantity >= 10) AS d FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
l AS (SELECT 'o' || l_orderkey AS path, l_linenumber AS line, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS hits FROM lineitem GROUP BY 1, 2)
"""


def scored_sql(first: int = 1, last: int = 7, policy: str = "coalesce(coverage, 0::DOUBLE)") -> str:
    return f"""{FUNCTIONS},
c AS (SELECT path, count(*) FILTER (line BETWEEN {first} AND {last}) AS n, count(*) FILTER (line BETWEEN {first} AND {last} AND hits > 0) AS k FROM l GROUP BY 1),
s AS (SELECT f.*, CASE WHEN c.path IS NULL THEN NULL WHEN n = 0 THEN 100::DOUBLE ELSE k::DOUBLE / n * 100::DOUBLE END AS coverage FROM f LEFT JOIN c ON f.path = c.path),
u AS (SELECT *, 1::DOUBLE - ({policy}) / 100::DOUBLE AS u FROM s),
e AS (SELECT *, cc * cc * (u * u * u) + cc AS crap FROM u WHERE u IS NOT NULL)
"""


DELTA = f"""{FUNCTIONS},
old AS (SELECT l_orderkey, count(*) FILTER (l_quantity >= 10) AS d FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1),
b AS (SELECT CASE WHEN ord % 500 = 1 THEN 'gone/x' || ord || '.py' WHEN regexp_matches(file, 'n[0-9]*5[.]') THEN 'old/' || substr(file, 5) ELSE file END AS file,
  CASE WHEN ord % 500 = 1 THEN 'solo_' || ord ELSE name END AS name, CASE WHEN ord % 6 = 0 THEN line + 100 ELSE line END AS line,
  (1::DOUBLE + coalesce(d, 0)) * (1::DOUBLE + coalesce(d, 0)) + (1::DOUBLE + coalesce(d, 0)) AS crap, ord FROM f LEFT JOIN old ON ord = l_orderkey WHERE ord % 7 <> 0),
cur AS (SELECT file, CASE WHEN ord % 500 = 1 THEN 'solo_' || ord ELSE name END AS name, line, cc * cc + cc AS crap, ord FROM f WHERE ord % 11 <> 0),
lastb AS (SELECT file, name, line, arg_max(crap, ord) AS crap FROM b GROUP BY 1, 2, 3),
p1 AS (SELECT cur.*, lastb.crap AS base FROM cur JOIN lastb USING (file, name, line)),
n1 AS (SELECT * FROM cur WHERE NOT EXISTS (SELECT 1 FROM lastb WHERE lastb.file = cur.file AND lastb.name = cur.name AND lastb.line = cur.line)),
r1 AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM cur WHERE b.file = cur.file AND b.name = cur.name AND b.line = cur.line)),
k AS (SELECT *, CASE WHEN x[-1] <> y[-1] THEN 0 WHEN x[-2] <> y[-2] THEN 1 WHEN len(x) < 3 OR len(y) < 3 OR x[-3] <> y[-3] THEN 2 ELSE 3 END AS k FROM
  (SELECT n1.ord AS ord, r1.ord AS bord, r1.crap AS base, string_split(n1.file, '/') AS x, string_split(r1.file, '/') AS y FROM n1 JOIN r1 ON n1.name = r1.name)),
t AS (SELECT *, max(k) OVER (PARTITION BY ord) AS mk, max(k) OVER (PARTITION BY bord) AS tk, count(*) OVER (PARTITION BY ord, k) AS mn, count(*) OVER (PARTITION BY bord, k) AS tn FROM k WHERE k >= 1),
p2 AS (SELECT ord, bord, base FROM t WHERE k = mk AND k = tk AND mn = 1 AND tn = 1),
n2 AS (SELECT * FROM n1 WHERE ord NOT IN (SELECT ord FROM p2)), r2 AS (SELECT * FROM r1 WHERE ord NOT IN (SELECT bord FROM p2)),
once AS (SELECT name FROM n2 GROUP BY 1 HAVING count(*) = 1 INTERSECT SELECT name FROM r2 GROUP BY 1 HAVING count(*) = 1),
p3 AS (SELECT n2.*, r2.crap AS base, r2.file AS prev FROM n2 JOIN r2 USING (name) WHERE name IN (SELECT name FROM once)),
removed AS (SELECT file, name, line, crap AS baseline_crap FROM r2 WHERE name NOT IN (SELECT name FROM once)),
every AS (SELECT *, NULL AS previous_file, 0 AS move FROM p1 UNION ALL SELECT n1.*, p2.base, NULL, 0 FROM n1 JOIN p2 USING (ord)
  UNION ALL SELECT file, name, line, crap, ord, base, prev, 1 FROM p3 UNION ALL SELECT n2.*, NULL, NULL, 0 FROM n2 WHERE name NOT IN (SELECT name FROM once)),
delta AS (SELECT file, name, line, crap, ord, base AS baseline_crap, previous_file::VARCHAR AS previous_file, CASE WHEN base IS NULL THEN 'new' WHEN crap - base > 0.01::DOUBLE THEN 'regressed'
  WHEN base - crap > 0.01::DOUBLE THEN 'improved' WHEN move = 1 THEN 'moved' ELSE 'unchanged' END AS status FROM every)
"""
