"""Queries of many patterns of each kind, long values, and sets larger than a plan's constants, each with its SQL.

Patterns are made by a rule from numbers; the SQL makes the same ones as a table and joins the events with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.deploy import shared_dir
from evmatch.operators.flatten import ExactFlattener
from evmatch.operators.history import PatternHistory
from evmatch.operators.registry import PatternSet
from evmatch.operators.store import PatternStore
from evmatch.queries import CUST, EVENT, LINE, ORDER, ORACLES, PART, add, orders_with_items, table
from evmatch.sources.events import spread

MANY = 10_000

# ---------------------------------------------------------------- one field, many patterns of a kind

#: three digits somewhere in a customer's number, the last of it elsewhere
WILDCARDS = {f"w{n}": {"c_name": [{"wildcard": f"Cust*{n % 1000:03d}*{n // 1000}"}]} for n in range(MANY)}


@add("wildcards_10000", "SELECT c_custkey, 'w' || n AS pattern_id FROM customer, range(10000) t(n) WHERE c_name LIKE 'Cust%' || lpad((n % 1000)::VARCHAR, 3, '0') || '%' || (n // 1000)")
def wildcards_10000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.of(WILDCARDS).match_long(spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")), CUST)


def ranges(many: int) -> dict[str, object]:
    """Overlapping ranges of prices, closed or open at each end by turns."""
    at = lambda n: 1000 + (n * 7919 % 400_000)
    return {f"r{n}": {"o_totalprice": [{"numeric": [">=" if n % 2 else ">", at(n), "<" if n % 3 else "<=", at(n) + n % 97]}]} for n in range(many)}


def _ranges_sql(many: int) -> str:
    return f"""
WITH r AS (SELECT n, 1000 + (n * 7919 % 400000) AS lo, n % 97 AS w FROM range({many}) t(n))
SELECT o_orderkey, 'r' || n AS pattern_id FROM orders JOIN r ON o_totalprice >= lo AND o_totalprice <= lo + w
WHERE (n % 2 = 1 OR o_totalprice > lo) AND (n % 3 = 0 OR o_totalprice < lo + w)"""


@add("ranges_10000", _ranges_sql(MANY))
def ranges_10000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.of(ranges(MANY)).match_long(table(spark, sf_dir, "orders"), ORDER)


@add("ranges_100000", _ranges_sql(10 * MANY))
def ranges_100000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond a plan's constants: terms are a table."""
    return PatternSet.of(ranges(10 * MANY)).match_long(spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")), ORDER)


#: networks of several lengths within each other, v4 and v6
BLOCKS = {f"b{n}": {"ip": [{"cidr": f"10.{n % 7}.{n // 40 % 256}.0/{16 + n % 13}" if n % 2 else f"2001:db8:{n % 5:x}:{n // 40:x}::/{40 + n % 29}"}]} for n in range(MANY)}


@add(
    "cidr_10000",
    """
WITH a AS (SELECT c_custkey, c_custkey % 2 = 1 AS four, c_custkey % 7 AS x, c_custkey % 256 AS y, c_custkey * 31 % 256 AS z, c_custkey % 5 AS g, c_custkey % 251 AS h FROM customer),
 k AS (SELECT n, n % 2 = 1 AS four, CASE WHEN n % 2 = 1 THEN 16 + n % 13 ELSE 40 + n % 29 END AS bits, n % 7 AS x, n // 40 % 256 AS y, n % 5 AS g, n // 40 AS h FROM range(10000) t(n))
SELECT c_custkey, 'b' || n AS pattern_id FROM a JOIN k ON a.four = k.four
WHERE CASE WHEN a.four THEN ((10::BIGINT << 24) + (a.x << 16) + (a.y << 8) + a.z) >> (32 - bits) = ((10::BIGINT << 24) + (k.x << 16) + (k.y << 8)) >> (32 - bits)
 ELSE ((a.g::BIGINT << 16) + a.h) << 4 >> (68 - bits) = ((k.g::BIGINT << 16) + k.h) << 4 >> (68 - bits) END""",
)
def cidr_10000(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    part = lambda c: c.cast("string")
    four = F.concat_ws(".", F.lit("10"), part(key % 7), part(key % 256), part(key * 31 % 256))
    six = F.concat(F.lit("2001:db8:"), F.lower(F.hex(key % 5)), F.lit(":"), F.lower(F.hex(key % 251)), F.lit(":0:0:0:1"))
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.when(key % 2 == 1, four).otherwise(six).alias("ip"))
    return PatternSet.of(BLOCKS).match_long(rows, CUST)


#: one equality and one exclusion each; what an order's priority excludes decides
WITHOUT = {f"x{n}": {"o_custkey": [n], "o_orderpriority": [{"anything-but": ["1-URGENT", "5-LOW"] if n % 2 else f"{n % 5 + 1}-HIGH"}]} for n in range(MANY)}


@add("anything_but_10000", "SELECT o_orderkey, 'x' || o_custkey AS pattern_id FROM orders WHERE o_custkey < 10000 AND CASE WHEN o_custkey % 2 = 1 THEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') ELSE o_orderpriority <> (o_custkey % 5 + 1) || '-HIGH' END")
def anything_but_10000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.of(WITHOUT).match_long(table(spark, sf_dir, "orders"), ORDER, plan="row")


#: a word in capitals, with one character of three that fold together in some
FOLDED = {f"i{n}": {"t": [{"equals-ignore-case": f"KÜNSTLER {n} ΣΟΦΟΣ"}]} for n in range(MANY)}


@add("ignore_case_10000", "SELECT p_partkey, 'i' || (p_partkey * 7) AS pattern_id FROM part WHERE p_partkey * 7 < 10000 AND p_partkey % 3 > 0")
def ignore_case_10000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case; a third of the values has the Kelvin sign or a final sigma, which are no partners of K and Σ."""
    key, n = F.col("p_partkey"), (F.col("p_partkey") * 7).cast("string")
    word = F.when(key % 3 > 0, F.lit("künstler ")).when(key % 2 == 0, F.lit("\u212aünstler ")).otherwise(F.lit("künstler "))
    end = F.when((key % 3 == 0) & (key % 2 == 1), F.lit(" σοφος")).otherwise(F.lit(" σοφοσ"))
    rows = spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.concat(word, n, end).alias("t"))
    return PatternSet.of(FOLDED).match_long(rows, PART, plan="row")


# ---------------------------------------------------------------- many values of one pattern


@add("exact_list_100000", "SELECT l_orderkey, l_linenumber, 'odd' AS pattern_id FROM lineitem WHERE l_orderkey % 2 = 1 AND l_orderkey < 200000")
def exact_list_100000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.of({"odd": {"l_orderkey": list(range(1, 200_000, 2))}}).match_long(table(spark, sf_dir, "lineitem"), LINE)


@add("has_matches_1000", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 1 AND 1000")
def has_matches_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter at the scan, then a semi join."""
    return PatternSet.of({f"c{n}": {"o_custkey": [n]} for n in range(1, 1001)}).matching(table(spark, sf_dir, "orders")).select("o_orderkey")


@add("has_matches_1000_fields", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 1 AND 1000 AND o_orderstatus = substr('FOP', (o_custkey % 3 + 1)::INT, 1)")
def has_matches_1000_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.of({f"c{n}": {"o_custkey": [n], "o_orderstatus": ["FOP"[n % 3]]} for n in range(1, 1001)}).matching(table(spark, sf_dir, "orders")).select("o_orderkey")


# ---------------------------------------------------------------- arrays

#: flag and quantity of one item, and an order's status
IN_ARRAYS = {f"a{n}": {"items": {"flag": ["ANR"[n % 3]], "qty": [n % 50 + 1], "status": [{"anything-but": "F"}] if n % 4 == 0 else ["F", "O"]}, "o_orderstatus": ["FOP"[n % 7 % 3]]} for n in range(1000)}


@add(
    "array_1000_patterns",
    """
WITH p AS (SELECT n, substr('ANR', (n % 3 + 1)::INT, 1) AS flag, n % 50 + 1 AS qty, substr('FOP', (n % 7 % 3 + 1)::INT, 1) AS status FROM range(1000) t(n))
SELECT DISTINCT o_orderkey, 'a' || n AS pattern_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN p ON p.flag = l_returnflag AND p.qty = l_quantity AND p.status = o_orderstatus
WHERE n % 4 <> 0 OR l_linestatus <> 'F'""",
)
def array_1000_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.of(IN_ARRAYS).match_long(orders_with_items(spark, sf_dir), ORDER)


# ---------------------------------------------------------------- long values

LONG = {
    "or": {"v": [{"regexp": "(a|b)*c"}]},
    "letters": {"v": [{"regexp": "(~p{L}|~d)+"}]},
    "nested": {"v": [{"regexp": "((ab)*|c)*"}]},
    "twice": {"v": [{"regexp": "(a|ab|b)*d?"}]},
}


@add(
    "regexp_long_values",
    """
SELECT s_suppkey, unnest(CASE s_suppkey % 5 WHEN 0 THEN ['or', 'letters', 'nested'] WHEN 1 THEN ['letters', 'nested', 'twice'] WHEN 2 THEN ['letters', 'twice']
 WHEN 3 THEN ['letters'] ELSE []::VARCHAR[] END) AS pattern_id FROM supplier""",
)
def regexp_long_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of 100,000 characters: of a backtracking matcher each would end in a stack overflow, or never."""
    rows = spread(table(spark, sf_dir, "supplier").select("s_suppkey"))
    end = F.element_at(F.array(*map(F.lit, ("c", "", "d", "é1", "-"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return PatternSet.of(LONG).match_long(rows.select("s_suppkey", F.concat(F.repeat(F.lit("ab"), 50_000), end).alias("v")), ["s_suppkey"])


#: samples of the dialect: a regexp of ours, the column of ``part`` it is for, and the same for SQL's matcher
SAMPLES = (
    ("small|large", "p_name", "never"), ("(small|large) .*", "p_name", "(small|large) .*"), ("[^s]+ .{3,5}", "p_name", "[^s]+ .{3,5}"), ("~w+ ~w+", "p_name", r"\w+ \w+"), ("~w+~s~w+", "p_name", r"\w+\s\w+"),
    ("(~w+~s?)*", "p_name", r"(\w+\s?)*"), ("[a-m]+ [n-z]~w*", "p_name", r"[a-m]+ [n-z]\w*"), (".*(a|e|i)(n|r|l).*", "p_name", ".*(a|e|i)(n|r|l).*"), ("([^aeiou]*[aeiou]){3}[^aeiou]*", "p_name", "([^aeiou]*[aeiou]){3}[^aeiou]*"),
    ("(.)*ing", "p_name", ".*ing"), ("[a-z ]{10}", "p_name", "[a-z ]{10}"), ("[a-z ]{8,10}", "p_name", "[a-z ]{8,10}"), ("[a-z ]{12,}", "p_name", "[a-z ]{12,}"), ("~p{Ll}+~p{Zs}~p{Ll}+", "p_name", "[a-z]+ [a-z]+"),
    ("~p{L}*~P{L}~p{L}*", "p_name", "[a-z]* [a-z]*"), ("~i~c* ~i~c*", "p_name", "[a-z]+ [a-z]+"), ("Brand#~d{2}", "p_brand", "Brand#[0-9]{2}"), ("Brand#(1|2)?3", "p_brand", "Brand#[12]?3"), ("Brand#[1-35][^1-3]", "p_brand", "Brand#[1-35][^1-3]"),
    ("(?:Brand)#1(1|2|3)|Brand#5.", "p_brand", "Brand#1[123]|Brand#5."), ("~D+~d~d?", "p_brand", "[^0-9]+[0-9][0-9]?"), ("[A-Za-z]+[#~-]~d+", "p_brand", "[A-Za-z]+[#-][0-9]+"), ("Brand#1+", "p_brand", "Brand#1+"), ("B.*?#.*?4", "p_brand", "B.*#.*4"),
    ("[~p{Lu}~d]+", "p_type", "[A-Z0-9]+"), ("~p{IsBasicLatin}{5}", "p_type", ".{5}"), ("(S|P)(T|R|M)(A|O)(N|M|L).*", "p_type", "(S|P)(T|R|M)(A|O)(N|M|L).*"), ("((S|L)~p{Lu}+|PROMO)", "p_type", "[SL][A-Z]+|PROMO"), ("~I*", "p_type", "never"), ("~S{4,6}", "p_type", ".{4,6}"),
)


@add("regexp_samples", " UNION ALL ".join(f"SELECT p_partkey, 's{n}' AS pattern_id FROM part WHERE regexp_full_match({c}, '{sql}')" for n, (_, c, sql) in enumerate(SAMPLES)))
def regexp_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.of({f"s{n}": {c: [{"regexp": source}]} for n, (source, c, _) in enumerate(SAMPLES)}).match_long(table(spark, sf_dir, "part"), PART)


# ---------------------------------------------------------------- malformed events

#: what becomes of an event's text, and whether it is one strict JSON object with the type in ``a``
FORMS = (
    ("'{\"a\":\"' || event_type || '\"}'", True), ("'{\"a\":\"' || event_type || '\",}'", False), ("'{\"a\":[\"' || event_type || '\",]}'", False), ("'{\"a\":\"' || event_type || '\"} x'", False), ("'{\"a\":\"' || event_type || '\\\\q\"}'", False),
    ("'{\"n\":01,\"a\":\"' || event_type || '\"}'", False), ("'{\"n\":-,\"a\":\"' || event_type || '\"}'", False), ("'{\"n\":1.,\"a\":\"' || event_type || '\"}'", False), ("'[{\"a\":\"' || event_type || '\"}]'", False), ("' {\"a\" : [ \"' || event_type || '\" ] } '", True),
    ("'{\"n\":NaN,\"a\":\"' || event_type || '\"}'", False), ("'{\"n\":1e5,\"a\":\"' || event_type || '\"}'", True), ("'{\"n\":{},\"a\":\"' || event_type || '\"}'", True), ("''", False),
)


@add("strict_events_rows", f"SELECT event_id, good, CASE WHEN good AND event_type = 'click' THEN 'c' ELSE '' END AS ids FROM (SELECT *, event_id % {len(FORMS)} IN ({', '.join(str(n) for n, (_, ok) in enumerate(FORMS) if ok)}) AS good FROM events)")
def strict_events_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``events`` in one of the forms: a bad event is a row with an error."""
    text = F.element_at(F.array(*(F.expr(form) for form, _ in FORMS)), (F.col("event_id") % len(FORMS) + 1).cast("int"))
    got = PatternSet.of({"c": {"a": ["click"]}}, flattener=ExactFlattener()).match(table(spark, sf_dir, "events").select("event_id", text.alias("event")))
    return got.select("event_id", F.col("_event_error").isNull().alias("good"), F.array_join("matches", ",").alias("ids"))


# ---------------------------------------------------------------- patterns over time

SECOND = 1_000_000
#: 2024-01-01 in microseconds, and a day
YEAR, DAY = 1_704_067_200 * SECOND, 86_400 * SECOND


def history() -> PatternHistory:
    """For each day of the year a threshold of its own, valid for two days; one pattern for all the year, replaced
    after fifteen days; and one that is deleted after ten days and comes again after twenty."""
    made = PatternHistory.of((f"day{n}", {"event_type": ["purchase"], "value": [{"numeric": [">", n % 90]}]}, YEAR + n * DAY, YEAR + (n + 2) * DAY) for n in range(366))
    made.add_pattern("all", {"event_type": ["click"]}, YEAR)
    made.replace_patterns("all", {"event_type": [{"prefix": "s"}]}, YEAR + 15 * DAY)
    made.add_pattern("pause", {"event_type": ["view"]}, YEAR)
    made.delete_patterns("pause", YEAR + 10 * DAY)
    return made.add_pattern("pause", {"event_type": ["view"]}, YEAR + 20 * DAY)


MATCH_AS_OF = """
WITH e AS (SELECT *, floor((epoch_us(ts) - 1704067200000000) / 86400000000)::BIGINT AS d FROM events)
SELECT event_id, 'day' || n AS pattern_id FROM e, unnest([d - 1, d]) u(n) WHERE event_type = 'purchase' AND n BETWEEN 0 AND 365 AND value > n % 90
UNION ALL SELECT event_id, 'all' FROM e WHERE d >= 0 AND CASE WHEN d < 15 THEN event_type = 'click' ELSE event_type LIKE 's%' END
UNION ALL SELECT event_id, 'pause' FROM e WHERE event_type = 'view' AND (d BETWEEN 0 AND 9 OR d >= 20)"""


@add("match_as_of", MATCH_AS_OF)
def match_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history().match_long(table(spark, sf_dir, "events"), EVENT, "ts")


@add("match_as_of_stream", MATCH_AS_OF)
def match_as_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream over the table's files, run to its end into Parquet, and read back."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    query = history().match_long(stream, EVENT, "ts").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("event_id long, pattern_id string").parquet(f"{out}/rows")


# ---------------------------------------------------------------- patterns of a table, compiled in tasks


def new_store(spark: SparkSession) -> PatternStore:
    return PatternStore.create(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _pattern(id: str, **fields: Column) -> list[Column]:
    """``id`` before the row's key, and the JSON of a pattern whose lists are texts of their own."""
    text = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{name}": ['), x, F.lit("]")) for name, x in fields.items())), F.lit("}"))
    return [F.concat(F.lit(id), F.col("c_custkey").cast("string")).alias("pattern_id"), text.alias("pattern_json")]


STORE_OF_CUSTOMERS = """
SELECT o_orderkey, 'c' || c_custkey AS pattern_id FROM orders JOIN customer ON o_custkey = c_custkey
WHERE CASE WHEN c_nationkey <> 3 THEN o_totalprice > c_acctbal * 20 ELSE c_custkey % 2 = 0 AND o_orderpriority <> '1-URGENT' END"""


@add("store_of_customers", STORE_OF_CUSTOMERS)
def store_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern of every customer; those of one nation are deleted, and half of them come again as others."""
    customers, key = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    store = new_store(spark)
    limit = F.concat(F.lit('{"numeric": [">", '), (F.col("c_acctbal") * 20).cast("string"), F.lit("]}"))
    store.add_patterns(customers.select(*_pattern("c", o_custkey=key, o_totalprice=limit)))
    some = customers.filter("c_nationkey = 3")
    store.delete_patterns(some.select(*_pattern("c")))
    store.add_patterns(some.filter("c_custkey % 2 = 0").select(*_pattern("c", o_custkey=key, o_orderpriority=F.lit('{"anything-but": "1-URGENT"}'))))
    return store.match_long(table(spark, sf_dir, "orders"), ORDER)


STORE_OF_PARTS = """
SELECT DISTINCT o_orderkey, 'p' || p_partkey AS pattern_id FROM orders JOIN part ON o_totalprice >= 20 * p_retailprice AND o_totalprice < 20 * p_retailprice + 20
WHERE o_orderpriority LIKE '%' || substr('AEIOU', (p_size % 5 + 1)::INT, 1) || '%' OR o_orderpriority LIKE '3%'"""


@add("store_of_parts", STORE_OF_PARTS)
def store_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two patterns of every part under one id: overlapping ranges, with a wildcard or a beginning."""
    price = F.col("p_retailprice") * 20
    span = F.concat(F.lit('{"numeric": [">=", '), price.cast("string"), F.lit(', "<", '), (price + 20).cast("string"), F.lit("]}"))
    parts = table(spark, sf_dir, "part").withColumn("c_custkey", F.col("p_partkey"))
    vowel = F.concat(F.lit('{"wildcard": "*'), F.get(F.split(F.lit("AEIOU"), ""), (F.col("p_size") % 5).cast("int")), F.lit('*"}'))
    store = new_store(spark)
    store.add_patterns(parts.select(*_pattern("p", o_totalprice=span, o_orderpriority=vowel)).union(parts.select(*_pattern("p", o_totalprice=span, o_orderpriority=F.lit('{"prefix": "3"}')))))
    return store.match_long(table(spark, sf_dir, "orders"), ORDER)


#: fixed values: patterns that are rejected, but for the last, in the order of a customer's key
MALFORMED = ['{"c_name": ["x"]', '{"c_name": "x"}', '{"c_name": [["x"]]}', '{"c_name": [{"prefix": 1}]}', '{"c_name": [{"numeric": [">"]}]}', '{"c_name": [{"regexp": "(x"}]}', '{"c_name": [{"near": "x"}]}', '{"c_name": [{"cidr": "10.0.0.0/40"}]}', '{"c_name": [{"anything-but": []}]}', '{"c_name": ["x"]}']


@add("store_rejected", "SELECT 'c' || c_custkey AS pattern_id FROM customer WHERE c_custkey % 10 < 9")
def store_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine customers in ten bring a malformed pattern."""
    texts = F.array(*map(F.lit, MALFORMED))
    store = new_store(spark)
    store.add_patterns(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("pattern_id"), F.get(texts, F.col("c_custkey") % 10).alias("pattern_json")))
    return store.rejected().select("pattern_id")


__all__ = ["ORACLES"]
