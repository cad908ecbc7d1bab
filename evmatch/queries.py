"""Named queries over the driver's tables, each with the SQL that says the same.

A query gives (key, pattern_id) rows; its SQL a WHERE for each pattern.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evmatch.deploy import shared_dir
from evmatch.operators.flatten import ExactFlattener, TypedFlattener, VariantFlattener
from evmatch.operators.registry import PatternSet, ValueMatcher
from evmatch.sources.events import as_event, parquet
from evmatch.streaming.match import match_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet(spark, f"{sf_dir}/{name}.parquet")


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return put


def simple(name: str, source: str, key: list[str], patterns: dict[str, object], wheres: dict[str, str], prepare: Callable[[DataFrame], DataFrame] | None = None, columns: str = "*", **options: object) -> None:
    """One table, typed columns unless another flattener is named."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return PatternSet.of(patterns, **options).match_long(prepare(df) if prepare else df, key)

    keys = ", ".join(key)
    sql = " UNION ALL ".join(f"SELECT {keys}, '{i}' AS pattern_id FROM (SELECT {columns} FROM {source}) WHERE {w}" for i, w in wheres.items())
    add(name, sql)(query)


ORDER, LINE, PART, CUST, EVENT = ["o_orderkey"], ["l_orderkey", "l_linenumber"], ["p_partkey"], ["c_custkey"], ["event_id"]

# exact values
simple("exact_string", "orders", ORDER, {"f": {"o_orderstatus": ["F"]}}, {"f": "o_orderstatus = 'F'"})
simple("exact_in", "events", EVENT, {"cv": {"event_type": ["click", "view"]}}, {"cv": "event_type IN ('click', 'view')"})
simple("exact_number", "part", PART, {"s15": {"p_size": [15]}}, {"s15": "p_size = 15"})
simple("number_text_forms", "part", PART, {"a": '{"p_size":[1.5e1]}', "b": '{"p_size":[15.000, 0.000016e6]}'}, {"a": "p_size = 15", "b": "p_size IN (15, 16)"})
simple("number_as_text", "part", PART, {"t": {"p_size": ["15"]}}, {"t": "p_size = 15"})
simple("json_props_number", "events", EVENT, {"k": {"k": [69]}}, {"k": "CAST(json_extract(props, '$.k') AS BIGINT) = 69"}, flattener=VariantFlattener("props"))
simple("json_props_number_exact", "events", EVENT, {"k": {"k": [69, {"numeric": ["<", 5]}]}}, {"k": "CAST(json_extract(props, '$.k') AS BIGINT) = 69 OR CAST(json_extract(props, '$.k') AS BIGINT) < 5"}, flattener=ExactFlattener("props"))
_nullable = lambda df: df.select("event_id", F.nullif("event_type", F.lit("error")).alias("e"), (F.col("value") > 10).alias("big"))
NULLABLE = "event_id, nullif(event_type, 'error') AS e, value > 10 AS big"
simple("literal_null", "events", EVENT, {"n": {"e": [None]}}, {"n": "e IS NULL"}, _nullable, NULLABLE, flattener=TypedFlattener(nulls=True))
simple("literal_bool", "events", EVENT, {"t": {"big": [True]}, "f": {"big": [False]}}, {"t": "big", "f": "NOT big"}, _nullable, NULLABLE)
# existence
simple("exists_true", "events", EVENT, {"x": {"e": [{"exists": True}]}}, {"x": "e IS NOT NULL"}, _nullable, NULLABLE)
simple("exists_false", "events", EVENT, {"x": {"e": [{"exists": False}]}}, {"x": "e IS NULL"}, _nullable, NULLABLE)
simple("exists_null_counts", "events", EVENT, {"x": {"e": [{"exists": True}]}}, {"x": "true"}, lambda df: as_event(_nullable(df), nulls=True), NULLABLE, flattener=ExactFlattener())
simple("exists_or_value", "events", EVENT, {"x": {"e": [{"exists": False}, "click"]}}, {"x": "e IS NULL OR e = 'click'"}, _nullable, NULLABLE)
# parts of strings
simple("prefix", "part", PART, {"p": {"p_name": [{"prefix": "small"}]}, "all": {"p_name": [{"prefix": ""}]}}, {"p": "starts_with(p_name, 'small')", "all": "p_name IS NOT NULL"})
simple("suffix", "part", PART, {"s": {"p_name": [{"suffix": "ring"}]}}, {"s": "ends_with(p_name, 'ring')"})
simple("wildcard", "part", PART, {"a": {"p_name": [{"wildcard": "s*l r*g"}]}, "b": {"p_name": [{"wildcard": "*all*"}]}, "c": {"p_name": [{"wildcard": "*"}]}}, {"a": "p_name LIKE 's%l r%g'", "b": "p_name LIKE '%all%'", "c": "p_name IS NOT NULL"})
_starred = lambda df: df.select("p_partkey", F.concat("p_name", F.lit("*\\")).alias("n"))
simple("wildcard_escape", "part", PART, {"e": {"n": [{"wildcard": "small*\\*\\\\"}]}}, {"e": "starts_with(n, 'small') AND ends_with(n, '*\\')"}, _starred, "p_partkey, p_name || '*\\' AS n")
simple("shellstyle", "pages", ["page_id"], {"s": {"url": [{"shellstyle": "http*.example.*"}]}, "q": {"url": [{"shellstyle": "*?page=*"}]}}, {"s": "url LIKE 'http%.example.%'", "q": "url LIKE '%?page=%'"})
simple("shellstyle_26_patterns", "part", PART, {f"p_{c}": {"p_name": [{"shellstyle": f"{c}*"}]} for c in "abcdefghijklmnopqrstuvwxyz"}, {f"p_{c}": f"starts_with(p_name, '{c}')" for c in "abcdefghijklmnopqrstuvwxyz"})
simple("ignore_case", "documents", ["doc_id"], {"en": {"lang": [{"equals-ignore-case": "EN"}]}, "k": {"lang": [{"equals-ignore-case": "K"}]}}, {"en": "lower(lang) = 'en'", "k": "lang = 'k'"})
# negation
simple("anything_but_str", "events", EVENT, {"a": {"event_type": [{"anything-but": ["click", "view"]}]}, "b": {"e2": [{"anything-but": "x"}]}}, {"a": "event_type NOT IN ('click', 'view')"})
simple("anything_but_num", "part", PART, {"a": {"p_size": [{"anything-but": [1, 2, 3]}]}, "b": {"p_name": [{"anything-but": 404}]}}, {"a": "p_size NOT IN (1, 2, 3)", "b": "p_name IS NOT NULL"})
# numbers
simple("numeric_gt", "lineitem", LINE, {"g": {"l_quantity": [{"numeric": [">", 45]}]}}, {"g": "l_quantity > 45"})
simple("numeric_range", "events", EVENT, {"r": {"value": [{"numeric": [">=", 10, "<", 20.5]}]}}, {"r": "value >= 10 AND value < 20.5"})
simple("numeric_eq", "lineitem", LINE, {"e": {"l_quantity": [{"numeric": ["=", 17]}]}}, {"e": "l_quantity = 17"})
simple("numeric_last_wins", "lineitem", LINE, {"l": {"l_quantity": [{"numeric": [">", 45, ">", 10, "<=", 12]}]}, "none": {"l_quantity": [{"numeric": []}]}}, {"l": "l_quantity > 10 AND l_quantity <= 12"})
simple("numeric_not_on_text", "part", PART, {"x": {"p_name": [{"numeric": [">", 0]}]}, "s": {"p_size": [{"numeric": [">", 49]}]}}, {"s": "p_size > 49"})
simple("numeric_10_ranges", "events", EVENT, {f"r{n}": {"value": [{"numeric": [">=", 10 * n, "<", 10 * n + 10]}]} for n in range(10)}, {f"r{n}": f"value >= {10 * n} AND value < {10 * n + 10}" for n in range(10)})
# addresses
_v4 = lambda df: df.select("c_custkey", F.concat(F.lit("10.0."), F.pmod("c_custkey", F.lit(4)).cast("string"), F.lit("."), F.pmod("c_custkey", F.lit(300)).cast("string")).alias("ip"))
simple("cidr_v4", "customer", CUST, {"a": {"ip": [{"cidr": "10.0.1.77/24"}]}, "b": {"ip": [{"cidr": "10.0.0.0/14"}]}}, {"a": "c_custkey % 4 = 1 AND c_custkey % 300 < 256", "b": "c_custkey % 300 < 256"}, _v4)
_v6 = lambda df: df.select("c_custkey", F.concat(F.lit("2001:db8:0:0:"), F.lower(F.hex(F.pmod("c_custkey", F.lit(512)))), F.lit(":0:0:1")).alias("ip"))
simple("cidr_v6", "customer", CUST, {"a": {"ip": [{"cidr": "2001:db8::/32"}]}, "b": {"ip": [{"cidr": "2001:db8::/72"}]}, "c": {"ip": [{"cidr": "2001:DB8:0:0:00ff::/80"}]}}, {"a": "true", "b": "c_custkey % 512 < 256", "c": "c_custkey % 512 = 255"}, _v6)
# regexps
simple("regexp_class", "part", PART, {"c": {"p_brand": [{"regexp": "Brand#[1-3][^0-4]"}]}}, {"c": "regexp_full_match(p_brand, 'Brand#[1-3][^0-4]')"})
simple("regexp_alt", "orders", ORDER, {"a": {"o_orderpriority": [{"regex": "1-URGENT|(2|3)-(HIGH|MEDIUM)"}]}}, {"a": "regexp_full_match(o_orderpriority, '1-URGENT|(2|3)-(HIGH|MEDIUM)')"})
simple("regexp_quant", "customer", CUST, {"q": {"c_name": [{"regexp": "Customer#0{2,6}[1-9]~d?~d{1,2}"}]}}, {"q": "regexp_full_match(c_name, 'Customer#0{2,6}[1-9][0-9]?[0-9]{1,2}')"})
simple("regexp_dot", "part", PART, {"d": {"p_brand": [{"regexp": ".+#.2"}]}}, {"d": "regexp_full_match(p_brand, '.+#.2')"})
simple("regexp_escape", "pages", ["page_id"], {"e": {"url": [{"regexp": "https?://[a-z~.]+~.example~.(com|net)/.*"}]}}, {"e": r"regexp_full_match(url, 'https?://[a-z.]+\.example\.(com|net)/.*')"})
simple("regexp_category", "customer", CUST, {"u": {"c_mktsegment": [{"regexp": "~p{Lu}{8}"}]}, "n": {"c_name": [{"regexp": "~p{L}+#~p{Nd}+"}]}, "b": {"c_mktsegment": [{"regexp": "~p{IsBasicLatin}*"}]}}, {"u": "regexp_full_match(c_mktsegment, '[A-Z]{8}')", "n": "regexp_full_match(c_name, '[A-Za-z]+#[0-9]+')", "b": "true"})
PRIORITY = "o_orderpriority"
simple("lookahead", "orders", ORDER, {"p": {PRIORITY: [{"regexp": "1-(?=URGENT)"}]}, "n": {PRIORITY: [{"regexp": "1-(?!URGENT)"}]}}, {"p": f"{PRIORITY} = '1-URGENT'", "n": f"{PRIORITY} <> '1-URGENT'"})
simple("lookbehind", "orders", ORDER, {"p": {PRIORITY: [{"regexp": "(?<=5-)LOW"}]}, "n": {PRIORITY: [{"regexp": "(?<!5-)LOW"}]}}, {"p": f"{PRIORITY} = '5-LOW'", "n": f"{PRIORITY} <> '5-LOW'"})
# combinations
simple("and_fields", "orders", ORDER, {"x": {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "5-LOW"], "o_totalprice": [{"numeric": ["<", 100000]}]}}, {"x": "o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice < 100000"})
simple("or_fields", "lineitem", LINE, {"x": {"l_returnflag": ["A", {"prefix": "R"}], "l_quantity": [1, 2, {"numeric": [">", 49]}]}}, {"x": "l_returnflag IN ('A', 'R') AND (l_quantity IN (1, 2) OR l_quantity > 49)"})
simple("or_patterns_same_id", "orders", ORDER, {"x": [{"o_orderstatus": ["F"]}, {"o_orderpriority": ["1-URGENT"]}]}, {"x": "o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'"})
simple("empty_list_and_pattern", "orders", ORDER, {"l": {"o_orderstatus": ["P"], "o_orderkey": []}, "none": {}}, {"l": "o_orderstatus = 'P'"})
simple("exact_100_patterns", "lineitem", LINE, {f"k{n}": {"l_partkey": [n]} for n in range(1, 101)}, {"x": "true"})
ORACLES["exact_100_patterns"] = "SELECT l_orderkey, l_linenumber, 'k' || l_partkey AS pattern_id FROM lineitem WHERE l_partkey BETWEEN 1 AND 100"
MIXED_1000 = {f"p{n}": {"l_partkey": [n], "l_returnflag": ["A", "R"]} if n % 2 else {"l_partkey": [n]} for n in range(1, 1001)}
simple("mixed_1000_patterns", "lineitem", LINE, MIXED_1000, {"x": "true"})
ORACLES["mixed_1000_patterns"] = "SELECT l_orderkey, l_linenumber, 'p' || l_partkey AS pattern_id FROM lineitem WHERE l_partkey BETWEEN 1 AND 1000 AND (l_partkey % 2 = 0 OR l_returnflag IN ('A', 'R'))"
PREFIX_100 = {f"c{n:02d}": {"c_name": [{"prefix": f"Customer#0000000{n:02d}"}]} for n in range(100)}
simple("prefix_100_patterns", "customer", CUST, PREFIX_100, {"x": "true"})
ORACLES["prefix_100_patterns"] = "SELECT c_custkey, 'c' || substr(c_name, 17, 2) AS pattern_id FROM customer WHERE c_name LIKE 'Customer#0000000__%'"
DIVERSE = {f"d{n}": {"p_size": [n % 50 + 1], "p_type": [{"wildcard": "*S*"}, {"suffix": "D"}], "p_name": [{"exists": True}, {"anything-but": ["x"]}], "missing": [{"exists": False}]} for n in range(60)}
simple("diverse_60_patterns", "part", PART, DIVERSE, {f"d{n}": f"p_size = {n % 50 + 1} AND (p_type LIKE '%S%' OR p_type LIKE '%D')" for n in range(60)})


def orders_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items are dealt by order as they are: lists made before that hold one item mostly, and take a sort of their own."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity").repartition("l_orderkey")
    items = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("qty"))).alias("items"))
    return table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", "items")


def with_items(name: str, patterns: dict[str, object], sql: str, **options: object) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return PatternSet.of(patterns, **options).match_long(orders_with_items(spark, sf_dir), ORDER)

    add(name, sql)(query)


@add("nested_path", "SELECT o_orderkey, 'b' AS pattern_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND o_orderstatus = 'O'")
def nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.struct(F.col("c_mktsegment").alias("segment")).alias("market"), F.col("c_acctbal").alias("balance")).alias("customer"))
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return PatternSet.of({"b": {"customer": {"market": {"segment": ["BUILDING"]}, "balance": [{"numeric": [">", 0]}]}, "o_orderstatus": ["O"]}}).match_long(orders, ORDER)


#: of the array rule, and of JSON rows
SAME_ELEMENT = {"a": {"items": {"flag": ["R"], "status": ["F"]}}, "b": {"items": {"flag": ["A"], "status": ["O"], "qty": [{"numeric": ["<", 10]}]}, "o_orderstatus": ["F", "O"]}}
JSON_ROWS = {"x": {"l_returnflag": ["R"], "l_quantity": [{"numeric": [">=", 40, "<", 45]}]}}

with_items("array_any", {"a": {"items": {"qty": [{"numeric": [">", 49]}]}}}, "SELECT o_orderkey, 'a' AS pattern_id FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
with_items("array_same_element", SAME_ELEMENT, "SELECT o_orderkey, 'a' AS pattern_id FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F') UNION ALL SELECT o_orderkey, 'b' FROM orders o WHERE o_orderstatus IN ('F', 'O') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A' AND l_linestatus = 'O' AND l_quantity < 10)")


@add("array_cross_element_rejected", "SELECT o_orderkey, 'cross' AS pattern_id FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F')")
def array_cross_element_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders where each field holds in some element but no one element has both."""
    rows = orders_with_items(spark, sf_dir)
    both = PatternSet.of({"both": {"items": {"flag": ["R"], "status": ["F"]}}, "flag": {"items": {"flag": ["R"]}}, "status": {"items": {"status": ["F"]}}}).match(rows)
    has = lambda x: F.array_contains("matches", x)
    return both.filter(has("flag") & has("status") & ~has("both")).select("o_orderkey", F.lit("cross").alias("pattern_id"))


@add("array_in_row", ORACLES["array_same_element"])
def array_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of many patterns with arrays, inside the row."""
    return PatternSet.of(SAME_ELEMENT).match_long(orders_with_items(spark, sf_dir), ORDER, plan="row")


@add("array_join_plan", ORACLES["array_same_element"])
def array_join_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.of(SAME_ELEMENT).match_long(orders_with_items(spark, sf_dir), ORDER, plan="join")


@add("delete_then_match", "SELECT o_orderkey, 'f' AS pattern_id FROM orders WHERE o_orderstatus = 'F'")
def delete_then_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = PatternSet.of({"f": {"o_orderstatus": ["F"]}, "o": {"o_orderstatus": ["O"]}})
    patterns.delete_patterns("o")
    return patterns.match_long(table(spark, sf_dir, "orders"), ORDER)


THREE = {"f": {"o_orderstatus": ["F"]}, "u": {"o_orderpriority": ["1-URGENT"]}, "p": {"o_totalprice": [{"numeric": [">", 250000]}]}}


@add("has_matches", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' OR o_totalprice > 250000")
def has_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.of(THREE).matching(table(spark, sf_dir, "orders")).select("o_orderkey")


@add("count_matches", "SELECT o_orderkey, CAST((o_orderstatus = 'F')::INT + (o_orderpriority = '1-URGENT')::INT + (o_totalprice > 250000)::INT AS INTEGER) AS n_matches FROM orders")
def count_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.of(THREE).count_column(table(spark, sf_dir, "orders")).select("o_orderkey", "n_matches")


@add("matches_array", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'f' END, CASE WHEN o_totalprice > 250000 THEN 'p' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'u' END) AS ids FROM orders")
def matches_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.of(THREE).match(table(spark, sf_dir, "orders")).select("o_orderkey", F.array_join("matches", ",").alias("ids"))


@add("flatten_count", "SELECT o_orderkey, CAST((SELECT 2 * count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS INTEGER) AS n_leaves FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def flatten_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PatternSet.of({"a": {"items": {"flag": ["R"], "qty": [1]}}}).leaf_count(orders_with_items(spark, sf_dir)).select("o_orderkey", "n_leaves")


@add("value_matcher", "SELECT p_partkey, concat_ws(',', CASE WHEN p_name = 'small ring' THEN 'exact' END, CASE WHEN p_name LIKE 'small%' THEN 'pre' END, CASE WHEN p_name LIKE '%r%g' THEN 'shell' END) AS ids FROM part")
def value_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ValueMatcher().add_string("exact", "small ring").add_prefix("pre", "small").add_shellstyle("shell", "*r*g")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(values.column(F.col("p_name")), ",").alias("ids"))


@add("json_rows_exact", "SELECT l_orderkey, l_linenumber, 'x' AS pattern_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40 AND l_quantity < 45")
def json_rows_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return PatternSet.of(JSON_ROWS, flattener=ExactFlattener()).match_long(as_event(rows), LINE)


@add("json_rows_variant", ORACLES["json_rows_exact"])
def json_rows_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return PatternSet.of(JSON_ROWS, flattener=VariantFlattener()).match_long(as_event(rows), LINE)


@add("malformed_events", "SELECT event_id, event_id % 3 = 0 AS bad, CASE WHEN event_id % 3 <> 0 AND event_type = 'click' THEN 'c' ELSE '' END AS ids FROM events")
def malformed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_event(table(spark, sf_dir, "events").select("event_id", "event_type"))
    cut = rows.withColumn("event", F.when(F.col("event_id") % 3 == 0, F.expr("substring(event, 1, length(event) - 1)")).otherwise(F.col("event")))
    got = PatternSet.of({"c": {"event_type": ["click"]}}, flattener=ExactFlattener()).match(cut)
    return got.select("event_id", F.col("_event_error").isNotNull().alias("bad"), F.array_join("matches", ",").alias("ids"))


@add("pattern_table_round_trip", ORACLES["delete_then_match"])
def pattern_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = PatternSet.of({"f": {"o_orderstatus": ["F"]}, "o": {"o_orderstatus": ["O"]}})
    patterns.delete_patterns("o")
    return PatternSet.from_table(patterns.to_table(spark)).match_long(table(spark, sf_dir, "orders"), ORDER)


@add("stream_equals_batch", "SELECT event_id, 'p' AS pattern_id FROM events WHERE event_type = 'purchase' AND value > 50")
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the table's files, run to its end into Parquet, and read back."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    patterns = PatternSet.of({"p": {"event_type": ["purchase"], "value": [{"numeric": [">", 50]}]}})
    query = match_stream(stream, patterns, EVENT).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("event_id long, pattern_id string").parquet(f"{out}/rows")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with line items, several patterns, the array rule included."""
    return QUERIES["array_same_element"](spark, sf_dir)
