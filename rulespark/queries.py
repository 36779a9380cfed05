"""The query catalogue: rule programs over the driver's tables, each with a SQL counterpart.

A query takes (spark, sf_dir) and returns a frame with plain, aliased columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespark.functions import types as ty
from rulespark.operators.state import scratch, written
from rulespark.session.program import Program

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _micros(name: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.unix_micros(F.concat(F.col(name).cast("string"), F.lit("Z")).cast("timestamp"))


def _long(frame: DataFrame, name: str, places: int = 4):
    """A double rounded, so that the order of a sum does not show."""
    return frame.withColumn(name, F.round(name, places))


@query("""
SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
""")
def q01_sum_revenue(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = Program(spark, "revenue(N) += E * (1 - D) for line(S,E,D), N is nation(supplier(S)).")
    p.bind("line", t["lineitem"], ["l_suppkey", "l_extendedprice", "l_discount"], bag=True)
    p.bind("supplier", t["supplier"], ["s_suppkey"], "s_nationkey", unique=True)
    p.bind("nation", t["nation"], ["n_nationkey"], "n_name", unique=True)
    return _long(p.relation("revenue", "nation", "revenue"), "revenue", 2)


@query("""
SELECT c_mktsegment AS segment, min(c_acctbal) AS low, max(c_acctbal) AS high, round(avg(c_acctbal), 4) AS mean
FROM customer GROUP BY 1
""")
def q02_min_max_mean(spark, sf_dir):
    p = Program(spark, """
        low(S) min= B for cust(_,S,B).  high(S) max= B for cust(_,S,B).  mean(S) mean= B for cust(_,S,B).
        all(S, low(S), high(S), mean(S)).""")  # fmt: skip
    p.bind("cust", Tables(spark, sf_dir)["customer"], ["c_custkey", "c_mktsegment", "c_acctbal"], unique=True)
    return _long(p.relation("all", "segment", "low", "high", "mean").drop("value"), "mean")


@query("""
SELECT r_name AS region, round(product(1 + n_nationkey / 100.0), 6) AS product, CAST(product(n_nationkey + 1) AS BIGINT) AS whole
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1
""")
def q03_product(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = Program(spark, """
        product(R) *= 1 + K / 100.0 for nation(K,X), R is region(X).
        whole(R) *= K + 1 for nation(K,X), R is region(X).
        both(R, product(R), whole(R)).""")  # fmt: skip
    p.bind("nation", t["nation"], ["n_nationkey", "n_regionkey"], unique=True)
    p.bind("region", t["region"], ["r_regionkey"], "r_name", unique=True)
    return _long(p.relation("both", "region", "product", "whole").drop("value"), "product", 6)


@query("""
SELECT l_suppkey AS supplier, bool_or(l_quantity > 49) AS any_big, bool_and(l_discount < 0.1) AS all_small
FROM lineitem GROUP BY 1
""")
def q04_bool_all_any(spark, sf_dir):
    p = Program(spark, """
        any(S) |= Q > 49 for line(S,Q,_).  every(S) &= D < 0.1 for line(S,_,D).
        both(S, any(S), every(S)).""")  # fmt: skip
    p.bind("line", Tables(spark, sf_dir)["lineitem"], ["l_suppkey", "l_quantity", "l_discount"], bag=True)
    return p.relation("both", "supplier", "any_big", "all_small").drop("value")


@query("SELECT DISTINCT o_custkey AS customer, true AS active FROM orders")
def q05_exists(spark, sf_dir):
    p = Program(spark, "active(C) :- order(_,C).")
    p.bind("order", Tables(spark, sf_dir)["orders"], ["o_orderkey", "o_custkey"], unique=True)
    return p.relation("active", "customer", "active")


@query("""
SELECT n_regionkey::BIGINT AS region, min(n_regionkey)::BIGINT AS same FROM nation GROUP BY 1
""")
def q06_unique_eq(spark, sf_dir):
    """Every nation says the same of its region; a conflict would make the item an error."""
    p = Program(spark, "same(R) = R for nation(_,R).")
    p.bind("nation", Tables(spark, sf_dir)["nation"], ["n_nationkey", "n_regionkey"], unique=True)
    return p.relation("same", "region", "same")


@query("""
SELECT CAST(n_regionkey AS BIGINT) AS region, count(DISTINCT n_name) > 1 AS conflict FROM nation GROUP BY 1
""")
def q06b_unique_conflict(spark, sf_dir):
    """Items whose aggregands differ are errors; here every region has several nations."""
    p = Program(spark, "one(R) = N for nation(R,N).")
    p.bind("nation", Tables(spark, sf_dir)["nation"], ["n_regionkey", "n_name"], bag=True)
    failed = p.evaluate().relations["one/1"].failed
    return failed.select(F.col("a0").alias("region"), F.col("message").like("%conflicting%").alias("conflict"))


@query("""
SELECT c_custkey AS customer, CASE WHEN coalesce(total, 0) > 1000000 THEN 'vip' ELSE 'standard' END AS tier
FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey
""")
def q07_last_rule_wins(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = Program(spark, """
        total(C) += V for order(_,C,V).
        tier(C) := "standard" for customer(C).
        tier(C) := "vip" for total(C) > 1000000.""")  # fmt: skip
    p.bind("order", t["orders"], ["o_orderkey", "o_custkey", "o_totalprice"], unique=True)
    p.bind("customer", t["customer"], ["c_custkey"], unique=True)
    return p.relation("tier", "customer", "tier")


@query("""
SELECT p_brand AS brand, min(p_retailprice) AS price, arg_min(p_partkey, (p_retailprice, p_partkey)) AS part
FROM part GROUP BY 1
""")
def q08_argmin_key(spark, sf_dir):
    p = Program(spark, "best(B) min= C with_key K for part(K,B,C).")
    p.bind("part", Tables(spark, sf_dir)["part"], ["p_partkey", "p_brand", "p_retailprice"], unique=True)
    return p.relation("best", "brand", "price", "part")


@query("""
SELECT user_id AS user, event_type AS majority FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k
  FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE k = 1
""")
def q09_majority(spark, sf_dir):
    p = Program(spark, "most(U) majority= T for event(U,T).")
    p.bind("event", Tables(spark, sf_dir)["events"], ["user_id", "event_type"], bag=True)
    return p.relation("most", "user", "majority")


@query("""
SELECT user_id AS user, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, CAST(count(*) AS BIGINT) AS events
FROM events GROUP BY 1
""")
def q10_set_bag(spark, sf_dir):
    p = Program(spark, "types(U) set= T for event(U,T).  all(U) bag= T for event(U,T).  both(U, types(U), all(U)).")
    p.bind("event", Tables(spark, sf_dir)["events"], ["user_id", "event_type"], bag=True)
    got = p.relation("both", "user", "types", "all")
    return got.select("user", F.array_join("types", ",").alias("types"), F.size("all").cast("long").alias("events"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS \"K\", n_name AS \"N\", r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def q11_query_bindings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = Program(spark)
    p.bind("nation", t["nation"], ["n_nationkey", "n_name"], "n_regionkey", unique=True)
    p.bind("region", t["region"], ["r_regionkey"], "r_name", unique=True)
    return p.query("region(nation(K,N))")


@query("SELECT event_type AS type, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def q12_count_distinct(spark, sf_dir):
    p = Program(spark, "seen(T,U) :- event(T,U).  users(T) += 1 for seen(T,_).")
    p.bind("event", Tables(spark, sf_dir)["events"], ["event_type", "user_id"], bag=True)
    return p.relation("users", "type", "users")


@query("SELECT sum(n_nationkey)::BIGINT AS total FROM nation WHERE n_nationkey < 0 HAVING count(*) > 0")
def q13_global_empty(spark, sf_dir):
    """An aggregation without keys over no rows has no item."""
    p = Program(spark, "total += K for nation(K), K < 0.")
    p.bind("nation", Tables(spark, sf_dir)["nation"], ["n_nationkey"], unique=True)
    return p.relation("total/0", "total")


@query("""
SELECT o_custkey AS customer, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 2000000
""")
def q14_having(spark, sf_dir):
    p = Program(spark, "total(C) += V for order(_,C,V).  rich(C) := total(C) for total(C) > 2000000.")
    p.bind("order", Tables(spark, sf_dir)["orders"], ["o_orderkey", "o_custkey", "o_totalprice"], unique=True)
    return _long(p.relation("rich", "customer", "total"), "total", 2)


_BIGRAM = """
SELECT a.l_partkey AS first, b.l_partkey AS second, CAST(count(*) AS BIGINT) AS n
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2
"""


@query(_BIGRAM)
def q15_bigram(spark, sf_dir):
    p = Program(spark, "bigram(U,V) += 1 for word(O,T,U), word(O,T+1,V).")
    p.bind("word", Tables(spark, sf_dir)["lineitem"], ["l_orderkey", "l_linenumber", "l_partkey"], bag=True)
    return p.relation("bigram", "first", "second", "n")


@query("""
WITH w AS (SELECT user_id AS u, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
uni AS (SELECT e, count(*) AS n FROM w GROUP BY 1),
bi AS (SELECT a.e AS x, b.e AS y, count(*) AS n FROM w a JOIN w b ON a.u = b.u AND b.t = a.t + 1 GROUP BY 1, 2)
SELECT x AS first, y AS second, round((bi.n + 0.5) / (uni.n + 0.5), 9) AS p FROM bi JOIN uni ON x = e
""")
def q16_lang_model(spark, sf_dir):
    events = Tables(spark, sf_dir)["events"]
    p = Program(spark, """
        prior := 0.5.
        seen(E) += 1 for step(_,_,E).
        follows(E,G) += 1 for step(U,T,E), step(U,T+1,G).
        p(E,G) := (follows(E,G) + prior) / (seen(E) + prior).""")  # fmt: skip
    p.bind("step", _sequence(events), ["user_id", "t", "event_type"], unique=True)
    return _long(p.relation("p", "first", "second", "p"), "p", 9)


def _sequence(events: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.withColumn("t", F.row_number().over(order).cast("long"))


@query("""
SELECT a.event_id AS first, b.event_id AS second FROM events a JOIN events b
ON a.user_id = b.user_id AND a.ts < b.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 600000000 AND a.event_type = 'purchase'
""")
def q17_theta_overlap(spark, sf_dir):
    """Range join: pairs within ten minutes of each other."""
    events = Tables(spark, sf_dir)["events"].withColumn("us", _micros("ts"))
    p = Program(spark, """
        near(A,B) :- S < T, T - S <= 600000000, event(A,U,S,"purchase"), event(B,U,T,_).""")  # fmt: skip
    p.bind("event", events, ["event_id", "user_id", "us", "event_type"], unique=True)
    return p.relation("near", "first", "second").drop("value")


@query("""
SELECT c_custkey AS customer, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
""")
def q18_value_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = Program(spark, "region(C) = Name for N is customer(C), R is nation(N), Name is name(R).")
    p.bind("customer", t["customer"], ["c_custkey"], "c_nationkey", unique=True)
    p.bind("nation", t["nation"], ["n_nationkey"], "n_regionkey", unique=True)
    p.bind("name", t["region"], ["r_regionkey"], "r_name", unique=True)
    return p.relation("region/1", "customer", "region")


@query("""
SELECT w AS word, CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) AS w FROM documents) GROUP BY 1
""")
def q19_unnest_tokens(spark, sf_dir):
    p = Program(spark, 'count(W) += 1 for doc(_,T), W in split(T, "[ \\\\t\\\\n\\\\r\\\\f\\\\x0B]+").')
    p.bind("doc", Tables(spark, sf_dir)["documents"], ["doc_id", "text"], unique=True)
    return p.relation("count", "word", "n")


@query("SELECT n_name AS nation, r_name AS region FROM nation, region")
def q20_cross(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = Program(spark, "pair_of(N,R) :- nation(N), region(R).")
    p.bind("nation", t["nation"], ["n_name"], unique=True)
    p.bind("region", t["region"], ["r_name"], unique=True)
    return p.relation("pair_of", "nation", "region").drop("value")


@query("SELECT CAST(sum(n_nationkey) * sum(n_nationkey) AS BIGINT) AS pairs FROM nation")
def q21_selfjoin_diag(spark, sf_dir):
    p = Program(spark, "pairs += b(X) * b(Y).")
    p.bind("b", Tables(spark, sf_dir)["nation"], ["n_name"], "n_nationkey", unique=True)
    return p.relation("pairs/0", "pairs")


@query("""
SELECT event_id AS purchase, prior.us AS at, prior.e AS event FROM (
  SELECT a.event_id, max((epoch_us(b.ts), b.event_id)) AS m FROM events a JOIN events b
  ON a.user_id = b.user_id AND b.ts < a.ts WHERE a.event_type = 'purchase' GROUP BY 1),
  LATERAL (SELECT m[1] AS us, m[2] AS e) AS prior
""")
def q22_asof(spark, sf_dir):
    """As-of join: the latest earlier event of the same user, by max= with the event as key."""
    events = Tables(spark, sf_dir)["events"].withColumn("us", _micros("ts"))
    p = Program(spark, 'prior(P) max= T with_key E for event(P,U,S,"purchase"), event(E,U,T,_), T < S.')
    p.bind("event", events, ["event_id", "user_id", "us", "event_type"], unique=True)
    return p.relation("prior", "purchase", "at", "event")


@query("SELECT s_suppkey AS supplier, s_nationkey::BIGINT AS nation, s_acctbal AS balance FROM supplier")
def q23_destructure(spark, sf_dir):
    p = Program(spark, """
        packed(S) := &at(N, [B, B + 1]) for supplier(S,N,B).
        unpacked(S,N,B) :- at(N, [B|_]) is packed(S).""")  # fmt: skip
    p.bind("supplier", Tables(spark, sf_dir)["supplier"], ["s_suppkey", "s_nationkey", "s_acctbal"], unique=True)
    return p.relation("unpacked", "supplier", "nation", "balance").drop("value")


@query("""
SELECT p_partkey AS part, p_size::BIGINT - 25 AS shifted, (p_size - 25) - 7 * CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS rest,
  (p_size - 25) - (-7) * CAST(floor((p_size - 25) / -7.0) AS BIGINT) AS rest_negative, CAST(pow(p_size, 3) AS BIGINT) AS cube,
  abs(p_size - 25)::BIGINT AS size, xor(p_size::BIGINT, 5) AS bits, round(sqrt(p_size) + ln(p_size) + exp(p_size / 50.0) + log(10, p_retailprice), 6) AS mixed
FROM part
""")
def q24_scalar_math(spark, sf_dir):
    p = Program(spark, """
        out(P, D, mod(D, 7), mod(D, -7), S ** 3, abs(D), S ^ 5, sqrt(S) + log(S) + exp(S / 50) + log(C, 10))
          :- part(P,S,C), D is S - 25.""")  # fmt: skip
    p.bind("part", Tables(spark, sf_dir)["part"], ["p_partkey", "p_size", "p_retailprice"], unique=True)
    got = p.relation("out", "part", "shifted", "rest", "rest_negative", "cube", "size", "bits", "mixed").drop("value")
    return _long(got, "mixed", 6)


@query("""
SELECT c_custkey AS customer, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS number,
  c_name || '/' || c_mktsegment AS label FROM customer
""")
def q25_casts(spark, sf_dir):
    p = Program(spark, """
        out(C, int(B), int(D), N + "/" + S) :- customer(C,N,S,B), [_,D] is split(N, "[^0-9]+").""")  # fmt: skip
    p.bind("customer", Tables(spark, sf_dir)["customer"], ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"], unique=True)
    return p.relation("out", "customer", "whole", "number", "label").drop("value")


@query("""
SELECT l_returnflag AS flag, l_linestatus AS status, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2
UNION ALL SELECT l_returnflag, '*', count(*) FROM lineitem GROUP BY 1 UNION ALL SELECT '*', '*', count(*) FROM lineitem
""")
def q26_rollup_rules(spark, sf_dir):
    p = Program(spark, """
        n(F,S) += 1 for line(F,S).
        n(F,"*") += n(F,S) for S != "*", F != "*".
        n("*","*") += n(F,"*") for F != "*".""")  # fmt: skip
    p.bind("line", Tables(spark, sf_dir)["lineitem"], ["l_returnflag", "l_linestatus"], bag=True)
    return p.relation("n", "flag", "status", "n")


@query("""
SELECT c_nationkey::BIGINT AS nation, 'either' AS kind, CAST(count(*) AS BIGINT) AS n
FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1
UNION ALL SELECT DISTINCT c_nationkey::BIGINT, 'both', 1 FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT DISTINCT k::BIGINT, 'any', 1 FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
""")
def q27_union_intersect(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = Program(spark, """
        either(N) += 1 for customer(_,N).  either(N) += 1 for supplier(_,N).
        c(N) :- customer(_,N).  s(N) :- supplier(_,N).
        both(N) :- c(N), s(N).  any(N) :- c(N).  any(N) :- s(N).
        out(N,"either") += either(N).  out(N,"both") += 1 for both(N).  out(N,"any") += 1 for any(N).""")  # fmt: skip
    p.bind("customer", t["customer"], ["c_custkey", "c_nationkey"], unique=True)
    p.bind("supplier", t["supplier"], ["s_suppkey", "s_nationkey"], unique=True)
    return p.relation("out", "nation", "kind", "n")


_EDGES = """
edges AS (SELECT a.l_partkey AS a, b.l_partkey AS b, CAST(min(round(p_retailprice)) AS BIGINT) AS w
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  JOIN part ON p_partkey = b.l_partkey GROUP BY 1, 2)
"""


@query(f"""
WITH RECURSIVE {_EDGES},
path(node, d) USING KEY (node) AS (
  SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT)
  UNION
  SELECT node, d FROM (
    SELECT e.b AS node, min(p.d + e.w) AS d FROM path p JOIN edges e ON p.node = e.a GROUP BY 1) n
  WHERE d < coalesce((SELECT r.d FROM recurring.path r WHERE r.node = n.node), 9223372036854775807))
SELECT node, d AS distance FROM path
""")
def q28_sssp(spark, sf_dir):
    """Shortest paths from part 1, semi-naive."""
    t = Tables(spark, sf_dir)
    p = Program(spark, """
        edge(A,B) min= W for word(O,L,A), word(O,L+1,B), W is price(B).
        path(1) min= 0.
        path(B) min= path(A) + edge(A,B).""")  # fmt: skip
    p.bind("word", t["lineitem"], ["l_orderkey", "l_linenumber", "l_partkey"], bag=True)
    p.bind("price", t["part"].withColumn("price", F.round("p_retailprice").cast("long")), ["p_partkey"], "price", unique=True)
    return p.relation("path", "node", "distance")


@query("""
WITH RECURSIVE edges AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT a AS first, b AS second FROM reach
""")
def q29_reach(spark, sf_dir):
    """Transitive closure over the orders of the whole table."""
    p = Program(spark, """
        edge(A,B) :- word(O,L,A), word(O,L+1,B).
        reach(A,B) :- edge(A,B).
        reach(A,C) :- reach(A,B), edge(B,C).""")  # fmt: skip
    p.bind("word", Tables(spark, sf_dir)["lineitem"], ["l_orderkey", "l_linenumber", "l_partkey"], bag=True)
    return p.relation("reach", "first", "second").drop("value")


@query("""
WITH RECURSIVE f(x, a, b) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT)
  UNION ALL SELECT x + 1, b, a + b FROM f WHERE x + 1 < 20) SELECT x, a AS fib FROM f
""")
def q30_bounded_fib(spark, sf_dir):
    p = Program(spark, "f(1) += 1.  f(2) += 1.  f(X) += f(X-1) + f(X-2) for X < lim, X > 2.  lim := 20.")
    return p.relation("f", "x", "fib")


@query("SELECT n_regionkey::BIGINT AS region, CAST(2 * count(*) AS DOUBLE) AS total FROM nation GROUP BY 1")
def q31_geometric(spark, sf_dir):
    """A series per group, to its fixpoint."""
    p = Program(spark, "a(R) += 1 for nation(_,R).  a(R) += a(R) / 2.")
    p.bind("nation", Tables(spark, sf_dir)["nation"], ["n_nationkey", "n_regionkey"], unique=True)
    return _long(p.relation("a", "region", "total"), "total", 6)


@query("""
WITH w AS (SELECT user_id AS u, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
s AS (SELECT u, t, CASE e WHEN 'purchase' THEN 'P' WHEN 'view' THEN 'V' ELSE 'X' END AS x FROM w),
runs AS (SELECT u, t, t - row_number() OVER (PARTITION BY u ORDER BY t) AS run FROM s WHERE x <> 'X')
SELECT u AS user, t AS start, t + 1 AS stop, x AS symbol FROM s
UNION ALL SELECT a.u, a.t, b.t + 1, 'A' FROM runs a JOIN runs b ON a.u = b.u AND a.run = b.run AND a.t <= b.t
""")
def q32_cky(spark, sf_dir):
    """Chart parsing over all positions of each user's events."""
    sequence = _sequence(Tables(spark, sf_dir)["events"]).withColumn("t", F.col("t") - 1)
    p = Program(spark, """
        rewrite("P","purchase").  rewrite("V","view").
        symbol(U,T,X) :- word(U,T,W), rewrite(X,W).
        phrase("X",U,T,T+1) :- W != "purchase", W != "view", word(U,T,W).
        phrase(X,U,T,T+1) :- symbol(U,T,X).
        phrase("A",U,I,K) :- phrase("P",U,I,K).
        phrase("A",U,I,K) :- phrase("V",U,I,K).
        phrase("A",U,I,K) :- phrase("A",U,I,J), phrase("A",U,J,K).""")  # fmt: skip
    p.bind("word", sequence, ["user_id", "t", "event_type"], unique=True)
    got = p.relation("phrase", "symbol", "user", "start", "stop")
    return got.select("user", "start", "stop", "symbol")


@query("""
WITH RECURSIVE w AS (SELECT user_id AS u, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
n AS (SELECT u, t, len(e) % 3 + 1 AS k FROM w),
a(u, t, x, y) AS (SELECT u, t, CAST(k AS BIGINT), CAST(1 AS BIGINT) FROM n WHERE t = 1
  UNION ALL SELECT a.u, n.t, CAST((a.x * 2 + a.y) * n.k % 1000003 AS BIGINT), CAST((a.x + a.y * 3) % 1000003 AS BIGINT)
  FROM a JOIN n ON a.u = n.u AND n.t = a.t + 1)
SELECT u AS user, t, x AS warm, y AS cold FROM a
""")
def q33_hmm_forward(spark, sf_dir):
    """Forward weights along all of each user's events, modulo 1,000,003 so that none overflows.

    Events after the first go in chunks of 256. ``over`` is the matrix of a chunk, ``trail`` its weights
    from those it starts with; both pass down the chunk's list. Where sequences have several chunks,
    products over W chunks, W a power of two, are folded from two of half the length, and a chunk's
    start takes one product for each bit of its number: rounds grow with the length's logarithm.
    """
    sequence = _sequence(Tables(spark, sf_dir)["events"]).withColumn("k", (F.length("event_type") % 3 + 1).cast("long"))
    sequence = sequence.withColumn("n", F.col("t") - 1).withColumn("c", F.floor((F.col("n") - 1) / 256))
    sequence = written(sequence.select("user_id", "n", "c", "k"), 2).frame
    p = Program(spark, """
        :- backchain over/5.
        over([], A, B, C, D) = &m(A,B,C,D).
        over([pair(_,K)|T], A, B, C, D) = over(T, mod((2*A+B)*K,1000003), mod(A+3*B,1000003), mod((2*C+D)*K,1000003), mod(C+3*D,1000003)).
        :- backchain trail/4.
        trail([], _X, _Y, L) = L.
        trail([pair(N,K)|T], X, Y, L) = trail(T, V, W, [&at(N,V,W)|L]) for V is mod((2*X+Y)*K,1000003), W is mod(X+3*Y,1000003).
        part(U,C) bag= pair(N,K) for obs(U,N,C,K), N > 0.
        initial(U) = K for obs(U,0,_,K).
        later(U,C,W) :- chunk(U,C,W), C > 0.
        link(U,C) = over(part(U,C-1),1,0,0,1) for later(U,C,_).
        product(U,1,C,"h","h") += X for m(X,_,_,_) is link(U,C).
        product(U,1,C,"h","c") += X for m(_,X,_,_) is link(U,C).
        product(U,1,C,"c","h") += X for m(_,_,X,_) is link(U,C).
        product(U,1,C,"c","c") += X for m(_,_,_,X) is link(U,C).
        product(U,2*W,C,R,S) += block(U,W,C-W,R,X) * block(U,W,C,X,S) for mod(C,2*W) == 0.
        block(U,W,C,R,S) := mod(product(U,W,C,R,S), 1000003).
        weight(U,0,"h") += initial(U).
        weight(U,0,"c") += 1 for _ is initial(U).
        weight(U,C,S) += alpha(U,C-W,R) * block(U,W,C,R,S) for later(U,C,W).
        alpha(U,C,S) := mod(weight(U,C,S), 1000003).
        out(U,1,alpha(U,0,"h"),alpha(U,0,"c")).
        out(U,N+1,V,W) :- Ks is part(U,C), X is alpha(U,C,"h"), Y is alpha(U,C,"c"), P in trail(Ks,X,Y,[&at(256*C,X,Y)]), at(N,V,W) is P.""")  # fmt: skip
    p.bind("obs", sequence, ["user_id", "n", "c", "k"], unique=True)
    starts = sequence.where("n > 0 and (n - 1) % 256 = 0").withColumn("low", F.col("c").bitwiseAND(-F.col("c")))
    p.bind("chunk", starts, ["user_id", "c", "low"], unique=True)
    return p.relation("out", "user", "t", "warm", "cold").drop("value")


@query("""
SELECT a.l_suppkey AS row, b.p_size::BIGINT AS col, CAST(sum(CAST(a.q AS BIGINT) * b.p_partkey) AS BIGINT) AS cell
FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) a JOIN part b ON a.l_partkey = b.p_partkey GROUP BY 1, 2
""")
def q34_matrix_mult(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lines = t["lineitem"].withColumn("q", F.col("l_quantity").cast("long"))
    p = Program(spark, "left(I,J) += Q for line(I,J,Q).  product(I,K) += left(I,J) * right(J,K).")
    p.bind("line", lines, ["l_suppkey", "l_partkey", "q"], bag=True)
    p.bind("right", t["part"], ["p_partkey", "p_size"], "p_partkey", unique=True)
    return p.relation("product", "row", "col", "cell")


@query("""
SELECT p_partkey AS part, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'medium' ELSE 'small' END AS grade,
  CAST(p_size * 2 + 1 AS BIGINT) AS code FROM part
""")
def q35_backchain_fn(spark, sf_dir):
    """User functions with alternatives, inlined as columns."""
    p = Program(spark, """
        :- backchain grade/1.
        grade(S) := "small".
        grade(S) := "medium" for S > 20.
        grade(S) := "large" for S > 40.
        :- backchain code/1.
        code(S) = twice(S) + 1.
        :- backchain twice/1.
        twice(S) = S * 2.
        out(P, grade(S), code(S)) :- part(P,S).""")  # fmt: skip
    p.bind("part", Tables(spark, sf_dir)["part"], ["p_partkey", "p_size"], unique=True)
    return p.relation("out", "part", "grade", "code").drop("value")


@query("""
SELECT l_returnflag AS flag, l_shipdate::DATE::VARCHAR AS day, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 9) AS share
FROM lineitem GROUP BY 1, l_shipdate::DATE
""")
def q36_ratio_to_total(spark, sf_dir):
    lines = Tables(spark, sf_dir)["lineitem"].withColumn("day", F.col("l_shipdate").cast("date").cast("string"))
    p = Program(spark, "c(F,D) += Q for line(F,D,Q).  n(F) += c(F,_).  p(F,D) := c(F,D) / n(F).")
    p.bind("line", lines, ["l_returnflag", "day", "l_quantity"], bag=True)
    return _long(p.relation("p", "flag", "day", "share"), "share", 9)


@query("""
SELECT o_custkey AS customer, CAST(count(*) + 10 * count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS score FROM orders GROUP BY 1
""")
def q37_incremental(spark, sf_dir):
    """Rules added and retracted after their first state was read; the state is that of the rules which remain."""
    p = Program(spark, "score(C) += 1 for order(_,C,_).  score(C) += 100 for order(_,C,_).")
    p.bind("order", Tables(spark, sf_dir)["orders"], ["o_orderkey", "o_custkey", "o_orderstatus"], unique=True)
    p.relation("score").agg(F.sum("value")).first()
    p.retract(1)
    p.add('score(C) += 10 for order(_,C,"F").')
    return p.relation("score", "customer", "score")


@query("""
SELECT l_orderkey AS order_key, CAST(max(l_linenumber) AS BIGINT) AS last FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1
""")
def q38_semi_join(spark, sf_dir):
    """An existential relation joined back."""
    t = Tables(spark, sf_dir)
    p = Program(spark, """
        urgent(O) :- order(O,"1-URGENT").
        last(O) max= L for line(O,L), urgent(O).""")  # fmt: skip
    p.bind("order", t["orders"], ["o_orderkey", "o_orderpriority"], unique=True)
    p.bind("line", t["lineitem"], ["l_orderkey", "l_linenumber"], bag=True)
    return p.relation("last", "order_key", "last")


@query("""
SELECT c_custkey AS customer, CAST(coalesce(n, 0) AS BIGINT) AS orders
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey
""")
def q39_default_value(spark, sf_dir):
    """The outer-join idiom: a zero for each key, then the contributions."""
    t = Tables(spark, sf_dir)
    p = Program(spark, "n(C) += 0 for customer(C).  n(C) += 1 for order(_,C).")
    p.bind("order", t["orders"], ["o_orderkey", "o_custkey"], unique=True)
    p.bind("customer", t["customer"], ["c_custkey"], unique=True)
    return p.relation("n", "customer", "orders")


@query("SELECT i AS n, j AS member FROM (SELECT unnest(range(1, 6)) AS i), LATERAL (SELECT unnest(range(0, i)) AS j)")
def q40_range_generator(spark, sf_dir):
    p = Program(spark, "out(N,M) :- N in range(1,6), M in range(N).")
    return p.relation("out", "n", "member").drop("value")


@query("SELECT p_partkey AS part, p_brand IN ('Brand#1', 'Brand#12', 'Brand#25') AS chosen FROM part")
def q41_membership(spark, sf_dir):
    p = Program(spark, 'chosen(P) := B in ["Brand#1", "Brand#12", "Brand#25"] for part(P,B).')
    p.bind("part", Tables(spark, sf_dir)["part"], ["p_partkey", "p_brand"], unique=True)
    return p.relation("chosen", "part", "chosen")


@query("SELECT p_partkey AS part, upper(substr(p_type, 1, 3)) AS code FROM part")
def q42_registered_function(spark, sf_dir):
    """A Python function by name, in Arrow batches."""
    p = Program(spark)
    p.register("code_of", lambda s: s[:3].upper(), "str")
    p.add('code(P) := pycall("code_of", T) for part(P,T).')
    p.bind("part", Tables(spark, sf_dir)["part"], ["p_partkey", "p_type"], unique=True)
    return p.relation("code", "part", "code")


@query("SELECT c_nationkey::BIGINT AS nation, string_agg(c_mktsegment, '' ORDER BY c_mktsegment) AS joined FROM customer GROUP BY 1")
def q43_string_sum(spark, sf_dir):
    """+= on strings, over all customers."""
    p = Program(spark, "joined(N) += S for customer(_,N,S).")
    p.bind("customer", Tables(spark, sf_dir)["customer"], ["c_custkey", "c_nationkey", "c_mktsegment"], unique=True)
    return p.relation("joined", "nation", "joined")


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, 1.0 / n_nationkey AS inverse FROM nation WHERE n_nationkey <> 0")
def q44_errors_drop_groundings(spark, sf_dir):
    """Division by zero loses that grounding alone; it is reported by errors()."""
    p = Program(spark, "inverse(N) := 1 / N for nation(N).")
    p.bind("nation", Tables(spark, sf_dir)["nation"], ["n_nationkey"], unique=True)
    return p.relation("inverse", "nation", "inverse")


@query("SELECT p_size::BIGINT AS size, true AS repeated FROM part GROUP BY 1 HAVING count(*) FILTER (p_partkey = p_size) > 0")
def q45_repeated_variable(spark, sf_dir):
    """A variable twice in one pattern is an equality."""
    p = Program(spark, "repeated(X) :- part(X,X).")
    p.bind("part", Tables(spark, sf_dir)["part"], ["p_partkey", "p_size"], unique=True)
    return p.relation("repeated", "size", "repeated")


def _text(frame: DataFrame, *columns, name: str) -> str:
    """A written text of one line a row; its path."""
    path = scratch(frame.sparkSession, name)
    frame.select(F.concat_ws("", *columns).alias("value")).write.text(path)
    return path


@query("SELECT CAST(n_nationkey AS VARCHAR) AS nation, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def q46_load_tsv(spark, sf_dir):
    """Lines of fields: a true item each."""
    path = _text(Tables(spark, sf_dir)["nation"], "n_nationkey", F.lit("\t"), "n_name", F.lit("\t"), "n_regionkey", name="tsv")
    p = Program(spark, "out(K,N,R) :- row(_,K,N,R).")
    p.load(f'row = tsv("{path}")')
    return p.relation("out", "nation", "name", "region").drop("value")


@query("""
SELECT CAST(0 AS BIGINT) AS col, CAST(sum(p_partkey) AS BIGINT) AS total, CAST(max(p_partkey) AS BIGINT) AS top FROM part
UNION ALL SELECT 1, CAST(sum(p_size) AS BIGINT), CAST(max(p_size) AS BIGINT) FROM part
""")
def q47_load_matrix(spark, sf_dir):
    """Numbers in rows and columns, folded by column."""
    path = _text(Tables(spark, sf_dir)["part"], "p_partkey", F.lit("  "), "p_size", name="matrix")
    p = Program(spark, "total(J) += cell(_,J).  top(J) max= cell(_,J).  out(J,total(J),top(J)).")
    p.load(f'cell = matrix("{path}", astype=int)')
    return p.relation("out", "col", "total", "top").drop("value")


@query("SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def q48_load_sexpr(spark, sf_dir):
    """Nested lists taken apart by patterns."""
    path = _text(Tables(spark, sf_dir)["nation"], F.lit('(nation "'), "n_name", F.lit('" (in '), "n_regionkey", F.lit("))"), name="sexpr")
    p = Program(spark, 'out(N,R) :- ["nation",N,["in",R]] is tree(_).')
    p.load(f'tree = sexpr("{path}")')
    return _texts(p, "name", "region")


def _texts(p: Program, *names: str) -> DataFrame:
    """Untyped arguments that are strings, as strings."""
    return p.relation("out", *names).select(*(ty.decoded(F.col(n), "str").alias(n) for n in names))


@query("SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def q49_saved_program(spark, sf_dir):
    """A program and its loaded trees, saved and restored."""
    path = _text(Tables(spark, sf_dir)["nation"], F.lit('(nation "'), "n_name", F.lit('" (in '), "n_regionkey", F.lit("))"), name="sexpr")
    p = Program(spark, 'out(N,R) :- ["nation",N,["in",R]] is tree(_).')
    p.load(f'tree = sexpr("{path}")')
    at = scratch(spark, "program")
    p.save(at)
    return _texts(Program.restore(spark, at), "name", "region")


@query("""
SELECT n_nationkey::BIGINT AS nation, CASE WHEN n_nationkey <= 3 THEN 9223372036854775804 + n_nationkey END AS sum,
  CASE WHEN n_nationkey <= 4 THEN CAST(pow(n_nationkey, 30) AS BIGINT) END AS power
FROM nation WHERE n_nationkey <= 4
""")
def q50_overflow_drops_groundings(spark, sf_dir):
    """Integers beyond 64 bits lose their grounding alone."""
    p = Program(spark, "sum(N) := 9223372036854775804 + N for nation(N).  power(N) := N ** 30 for nation(N).")
    p.bind("nation", Tables(spark, sf_dir)["nation"], ["n_nationkey"], unique=True)
    return p.relation("sum", "nation", "sum").join(p.relation("power", "nation", "power"), "nation", "full")


@query("SELECT c_nationkey::BIGINT AS nation, repeat('#', CAST(count(*) AS INTEGER)) AS bar FROM customer GROUP BY 1")
def q51_string_repetition(spark, sf_dir):
    p = Program(spark, 'n(N) += 1 for customer(_,N).  bar(N) := "#" * n(N).')
    p.bind("customer", Tables(spark, sf_dir)["customer"], ["c_custkey", "c_nationkey"], unique=True)
    return p.relation("bar", "nation", "bar")


@query("""
SELECT p_partkey AS part, (p_size > 20 AND NOT p_size = 30) OR p_size = 7 AS chosen, p_size = 30 OR p_brand = 'Brand#1' AS other,
  p_size <> 7 AND p_brand <> 'Brand#1' AS neither FROM part
""")
def q52_boolean_operators(spark, sf_dir):
    p = Program(spark, """
        chosen(P) := (S > 20) & !(S == 30) | (S == 7) for part(P,S,_).
        other(P) := (S == 30) | (B == "Brand#1") for part(P,S,B).
        neither(P) := (S != 7) & (B != "Brand#1") for part(P,S,B).
        out(P,chosen(P),other(P),neither(P)).""")  # fmt: skip
    p.bind("part", Tables(spark, sf_dir)["part"], ["p_partkey", "p_size", "p_brand"], unique=True)
    return p.relation("out", "part", "chosen", "other", "neither").drop("value")


@query("SELECT n_nationkey::BIGINT AS nation, CAST(n_nationkey * 30 * (n_nationkey * 30 - 1) / 2 AS BIGINT) AS total FROM nation")
def q53_list_recursion(spark, sf_dir):
    """Sums of lists by recursion over their tails, up to 720 goals deep."""
    p = Program(spark, ":- backchain total/1.  total([]) = 0.  total([H|T]) = H + total(T).  out(N) := total(range(N * 30)) for nation(N).")
    p.bind("nation", Tables(spark, sf_dir)["nation"], ["n_nationkey"], unique=True)
    return p.relation("out", "nation", "total")


@query("SELECT o_custkey AS customer, CAST(count(*) AS BIGINT) AS orders, CAST(max(o_orderkey) AS BIGINT) AS last FROM orders GROUP BY 1")
def q54_inserted_rows(spark, sf_dir):
    """Rows that come in batches, one for each status; totals are read in between."""
    orders = Tables(spark, sf_dir)["orders"]
    p = Program(spark, "n(C) += 1 for order(_,C).  last(C) max= O for order(O,C).  out(C,n(C),last(C)).")
    of = lambda status: orders.where(status)
    p.bind("order", of("o_orderstatus = 'F'"), ["o_orderkey", "o_custkey"], unique=True)
    p.relation("n").agg(F.sum("value")).first()
    p.insert("order", of("o_orderstatus = 'O'"))
    p.insert("order", of("o_orderstatus not in ('F', 'O') or o_orderstatus is null"))
    return p.relation("out", "customer", "orders", "last").drop("value")


@query("SELECT p_partkey AS part, CAST(p_size * p_size + 1 AS BIGINT) AS code FROM part")
def q55_late_backchaining(spark, sf_dir):
    """A predicate defined after the rule that calls it."""
    p = Program(spark, "code(P) = f(S) for part(P,S).")
    p.bind("part", Tables(spark, sf_dir)["part"], ["p_partkey", "p_size"], unique=True)
    p.add(":- backchain f/1.  f(X) = X * X + 1.")
    return p.relation("code", "part", "code")


@query("SELECT p_partkey AS part, true AS within FROM part")
def q56_uniform(spark, sf_dir):
    """A number drawn for each part lies within its bounds."""
    p = Program(spark, "within(P) := (U >= 2) & (U < 5) for part(P), U is uniform(2,5).")
    p.bind("part", Tables(spark, sf_dir)["part"], ["p_partkey"], unique=True)
    return p.relation("within", "part", "within")


@query("SELECT c_custkey AS customer FROM customer WHERE c_nationkey = 7")
def q57_value_lookup(spark, sf_dir):
    """Items by their value."""
    p = Program(spark, "out(C) :- 7 is home(C).")
    p.bind("home", Tables(spark, sf_dir)["customer"], ["c_custkey"], "c_nationkey", unique=True)
    return p.relation("out", "customer").drop("value")


@query("SELECT n_regionkey::BIGINT AS region, CAST(count(*) AS BIGINT) AS bindings FROM nation GROUP BY 1")
def q58_dict(spark, sf_dir):
    """dict=: the bindings of the other variables, one entry for each nation of a region."""
    p = Program(spark, "of(R) dict= N for nation(N,R).  out(R) += 1 for _ in of(R).")
    p.bind("nation", Tables(spark, sf_dir)["nation"], ["n_nationkey", "n_regionkey"], unique=True)
    return p.relation("out", "region", "bindings")


@query("""
WITH RECURSIVE near(o, a, b, n) AS (
  SELECT l_orderkey, l_linenumber, l_linenumber + 1, 1 FROM lineitem a WHERE EXISTS (
    SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
  UNION SELECT o, a, b + 1, n + 1 FROM near JOIN lineitem ON l_orderkey = o AND l_linenumber = b + 1)
SELECT CAST(o AS BIGINT) AS order_key, CAST(a AS BIGINT) AS first, CAST(b AS BIGINT) AS second FROM near
""")
def q59_reach_within_orders(spark, sf_dir):
    """Transitive closure of the lines that follow each other, in each order of the whole table."""
    p = Program(spark, """
        step(O,L,L+1) :- line(O,L), line(O,L+1).
        reach(O,A,B) :- step(O,A,B).
        reach(O,A,C) :- reach(O,A,B), step(O,B,C).""")  # fmt: skip
    p.bind("line", Tables(spark, sf_dir)["lineitem"], ["l_orderkey", "l_linenumber"], unique=True)
    return p.relation("reach", "order_key", "first", "second").drop("value")


@query("SELECT p_partkey AS part, true AS equal, p_size = 7 AS alike FROM part WHERE p_size = 7")
def q60_unification(spark, sf_dir):
    """`=` binds or fails, where `==` compares: what fails has no value."""
    p = Program(spark, "equal(P) := S = 7 for part(P,S).  alike(P) := S == 7 for part(P,S).  out(P,equal(P),alike(P)).")
    p.bind("part", Tables(spark, sf_dir)["part"], ["p_partkey", "p_size"], unique=True)
    return p.relation("out", "part", "equal", "alike").drop("value")
