"""The driver's queries on schema keywords. Each check builds a JSON document from a table's row, validates it with one
schema, and has the same verdict in SQL on the raw columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.validator import Validator
from skein.sources.ndjson import lines_of


@dataclass(frozen=True)
class Check:
    """One keyword on one table: key is the row's key, doc a Spark expression for its JSON text, sql the same verdict for
    DuckDB. With group, the
    rows of a key are gathered into `items` first."""

    table: str
    key: str
    doc: str
    schema: Any
    sql: str
    schemas: Any = None
    group: str | None = None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        if self.group:
            df = df.groupBy(self.key).agg(F.expr(self.group).alias("items"))
        v = Validator(self.schema, self.schemas)
        return df.select(*[F.col(k) for k in self.key.split(", ")], v.is_valid(F.expr(self.doc)).alias("ok"))

    def duckdb(self) -> str:
        if self.group:
            return f"SELECT {self.key}, {self.sql} AS ok FROM {self.table} GROUP BY {self.key}"
        return f"SELECT {self.key}, {self.sql} AS ok FROM {self.table}"


def doc(**fields: str) -> str:
    """to_json drops NULL fields, so that a field can be absent."""
    return "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + "))"


def props(required: list[str] | None = None, **fields: Any) -> dict[str, Any]:
    return {"type": "object", "properties": fields, **({"required": required} if required else {})}


ORDER = doc(key="o_orderkey", status="o_orderstatus", price="o_totalprice", priority="o_orderpriority")
#: low exists for cheap orders, high for dear ones, both between.
BAND = doc(key="o_orderkey", low="CASE WHEN o_totalprice < 200000 THEN o_totalprice END", high="CASE WHEN o_totalprice > 100000 THEN o_totalprice END", done="CASE WHEN o_orderstatus = 'F' THEN true END")
LOW, HIGH, DONE = "(o_totalprice < 200000)", "(o_totalprice > 100000)", "(o_orderstatus = 'F')"
LINES = "to_json(items)"
QUANTITIES = "sort_array(collect_list(cast(l_quantity as int)))"
FLAGGED = "sort_array(collect_list(l_returnflag))"
NATION = {"$id": "https://example.org/nation", "type": "integer", "minimum": 5, "maximum": 20}

CHECKS = {
    "v_type": Check("events", "event_id", "props", props(k={"type": "integer"}, required=["k"]), "json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'INTEGER')"),
    "v_type_union": Check("events", "event_id", doc(v="CASE WHEN event_type = 'click' THEN 'x' END", w="value"), props(v={"type": ["number", "null"]}, w={"type": ["number", "string"]}), "event_type <> 'click'"),
    "v_type_integer_value": Check("part", "p_partkey", doc(v="p_retailprice"), props(v={"type": "integer"}), "p_retailprice = floor(p_retailprice)"),
    "v_minimum_maximum": Check("events", "event_id", "props", props(k={"type": "integer", "minimum": 10, "maximum": 90}, required=["k"]), "cast(json_extract_string(props, '$.k') AS int) BETWEEN 10 AND 90"),
    "v_exclusive_bounds": Check("orders", "o_orderkey", ORDER, props(price={"exclusiveMinimum": 1000, "exclusiveMaximum": 200000}), "o_totalprice > 1000 AND o_totalprice < 200000"),
    "v_multiple_of": Check("part", "p_partkey", doc(size="p_size"), props(size={"multipleOf": 5}), "p_size % 5 = 0"),
    "v_enum": Check("orders", "o_orderkey", ORDER, props(priority={"enum": ["1-URGENT", "2-HIGH", "5-LOW", 3, None]}), "o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')"),
    "v_const": Check("lineitem", "l_orderkey, l_linenumber", doc(flag="l_returnflag"), props(flag={"const": "R"}), "l_returnflag = 'R'"),
    "v_min_max_length": Check("documents", "doc_id", doc(text="text"), props(text={"minLength": 50, "maxLength": 2000}), "length(text) BETWEEN 50 AND 2000"),
    "v_pattern": Check("customer", "c_custkey", doc(name="c_name"), props(name={"pattern": "^Customer#0000000[0-4]"}), "regexp_matches(c_name, '^Customer#0000000[0-4]')"),
    "v_format_date": Check("orders", "o_orderkey", doc(d="CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"), props(d={"format": "date"}), "o_orderkey % 3 <> 0"),
    "v_format_date_time": Check("events", "event_id", doc(d="CASE WHEN event_type = 'view' THEN cast(ts as string) ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END"), props(d={"format": "date-time"}), "event_type <> 'view'"),
    "v_format_uri": Check("pages", "page_id", doc(url="url"), props(url={"format": "uri"}), "regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:')"),
    "v_format_email": Check("customer", "c_custkey", doc(m="CASE WHEN c_nationkey < 12 THEN concat(lower(c_mktsegment), '@example.org') ELSE concat('@', c_name) END"), props(m={"format": "email"}), "c_nationkey < 12"),
    "v_format_ipv4": Check("part", "p_partkey", doc(a="concat('10.0.', cast(p_size as string), '.', cast(p_partkey % 300 as string))"), props(a={"format": "ipv4"}), "p_partkey % 300 <= 255"),
    "v_format_uuid": Check("customer", "c_custkey", doc(u="concat_ws('-', substr(md5(c_name), 1, 8), upper(substr(md5(c_name), 9, 4)), substr(md5(c_name), 13, 4), substr(md5(c_name), 17, 4), substr(md5(c_name), 21, CASE WHEN c_nationkey < 12 THEN 12 ELSE 11 END))"), props(u={"format": "uuid"}), "c_nationkey < 12"),
    "v_format_time": Check("orders", "o_orderkey", doc(t="concat(lpad(cast(o_orderkey % 30 as string), 2, '0'), ':', lpad(cast(o_orderkey % 70 as string), 2, '0'), CASE WHEN o_orderkey % 3 = 0 THEN ':07Z' WHEN o_orderkey % 3 = 1 THEN ':59.25-03:30' ELSE ':00' END)"), props(t={"format": "time"}), "o_orderkey % 30 < 24 AND o_orderkey % 70 < 60"),
    "v_format_duration": Check("part", "p_partkey", doc(d="CASE p_size % 5 WHEN 0 THEN concat('P', p_size, 'DT', p_size, 'H') WHEN 1 THEN concat('PT', p_size, '.5S') WHEN 2 THEN 'P' WHEN 3 THEN concat(p_size, 'D') ELSE concat('P', p_size, 'T') END"), props(d={"format": "duration"}), "p_size % 5 < 2"),
    "v_format_uri_reference": Check("customer", "c_custkey", doc(u="CASE c_nationkey % 4 WHEN 0 THEN concat('../', c_name, '?q=1#top') WHEN 1 THEN concat('/a b/', c_name) WHEN 2 THEN '' ELSE 'https://example.org/x' END"), props(u={"format": "uri-reference"}), "c_nationkey % 4 IN (0, 3)"),
    "v_format_ipv6": Check("part", "p_partkey", doc(a="CASE p_size % 4 WHEN 0 THEN concat('2001:db8::', hex(p_size)) WHEN 1 THEN concat('fe80::', p_size, '.1') WHEN 2 THEN concat(hex(p_size), ':1') ELSE '1:2:3:4:5:6:7:8' END"), props(a={"format": "ipv6"}), "p_size % 4 IN (0, 3)"),
    "v_format_hostname": Check("customer", "c_custkey", doc(h="CASE c_nationkey % 3 WHEN 0 THEN concat('host-', c_custkey, '.Example.org') WHEN 1 THEN concat('-h', c_custkey) ELSE concat(repeat('a', 45 + c_nationkey), '.org') END"), props(h={"format": "hostname"}), "c_nationkey % 3 = 0 OR (c_nationkey % 3 = 2 AND 45 + c_nationkey <= 63)"),
    "v_format_unknown": Check("orders", "o_orderkey", ORDER, props(status={"format": "no-such-format", "maxLength": 1}), "length(o_orderstatus) <= 1"),
    "v_annotations": Check("orders", "o_orderkey", ORDER, {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "order", "$comment": "x", "examples": [1], "deprecated": True, "properties": {"price": {"description": "dear", "minimum": 100000, "readOnly": True}}}, "o_totalprice >= 100000"),
    "v_large_integers": Check("orders", "o_orderkey", doc(n="9007199254740990 + o_orderkey % 6"), props(n={"type": "integer", "minimum": 9007199254740991, "exclusiveMaximum": 9007199254740995, "not": {"enum": [9007199254740992, 9007199254740994]}}), "o_orderkey % 6 IN (1, 3)"),
    "v_unique_large": Check("orders", "o_orderkey", "concat('[9007199254740992,', 9007199254740992 + o_orderkey % 3, ',9007199254740994.0]')", {"uniqueItems": True, "items": {"type": "integer"}}, "o_orderkey % 3 = 1"),
    "v_required": Check("orders", "o_orderkey", BAND, {"required": ["low", "high"]}, f"{LOW} AND {HIGH}"),
    "v_properties": Check("orders", "o_orderkey", BAND, props(low={"minimum": 5000}, high={"maximum": 400000}), f"(NOT {LOW} OR o_totalprice >= 5000) AND (NOT {HIGH} OR o_totalprice <= 400000)"),
    "v_additional_false": Check("orders", "o_orderkey", BAND, {"properties": {"key": {}, "low": {}}, "additionalProperties": False}, f"NOT {HIGH} AND NOT {DONE}"),
    "v_additional_schema": Check("orders", "o_orderkey", BAND, {"properties": {"key": {}, "done": {}}, "additionalProperties": {"type": "number", "maximum": 150000}}, f"(NOT {LOW} AND NOT {HIGH}) OR o_totalprice <= 150000"),
    "v_pattern_properties": Check("orders", "o_orderkey", BAND, {"patternProperties": {"^(low|high)$": {"minimum": 50000}, "^d": {"const": False}}}, f"((NOT {LOW} AND NOT {HIGH}) OR o_totalprice >= 50000) AND NOT {DONE}"),
    "v_property_names": Check("orders", "o_orderkey", BAND, {"propertyNames": {"maxLength": 3, "pattern": "^[a-z]+$"}}, f"NOT {HIGH} AND NOT {DONE}"),
    "v_min_max_properties": Check("orders", "o_orderkey", BAND, {"minProperties": 3, "maxProperties": 3}, f"1 + {LOW}::int + {HIGH}::int + {DONE}::int = 3"),
    "v_dependent_required": Check("orders", "o_orderkey", BAND, {"dependentRequired": {"done": ["low"], "high": ["done"]}}, f"(NOT {DONE} OR {LOW}) AND (NOT {HIGH} OR {DONE})"),
    "v_dependent_schemas": Check("orders", "o_orderkey", BAND, {"dependentSchemas": {"done": {"required": ["high"], "properties": {"high": {"minimum": 150000}}}}}, f"NOT {DONE} OR ({HIGH} AND o_totalprice >= 150000)"),
    "v_items": Check("lineitem", "l_orderkey", LINES, {"type": "array", "items": {"minimum": 5, "maximum": 45}}, "bool_and(cast(l_quantity AS int) BETWEEN 5 AND 45)", group=QUANTITIES),
    "v_prefix_items": Check("lineitem", "l_orderkey", LINES, {"prefixItems": [{"maximum": 10}], "items": {"minimum": 3}}, "min(cast(l_quantity AS int)) <= 10 AND coalesce(list_sort(list(cast(l_quantity AS int)))[2], 3) >= 3", group=QUANTITIES),
    "v_contains_min_max": Check("lineitem", "l_orderkey", LINES, {"contains": {"minimum": 40}, "minContains": 1, "maxContains": 2}, "count(*) FILTER (cast(l_quantity AS int) >= 40) BETWEEN 1 AND 2", group=QUANTITIES),
    "v_unique_items": Check("lineitem", "l_orderkey", LINES, {"uniqueItems": True, "items": {"type": "string"}}, "count(*) = count(DISTINCT l_returnflag)", group=FLAGGED),
    "v_min_max_items": Check("lineitem", "l_orderkey", LINES, {"minItems": 2, "maxItems": 4}, "count(*) BETWEEN 2 AND 4", group=FLAGGED),
    "v_all_of": Check("orders", "o_orderkey", ORDER, {"allOf": [props(price={"minimum": 50000}), props(status={"enum": ["O", "F"]})]}, "o_totalprice >= 50000 AND o_orderstatus IN ('O', 'F')"),
    "v_any_of": Check("orders", "o_orderkey", ORDER, {"anyOf": [props(price={"maximum": 50000}), props(status={"const": "P"})]}, "o_totalprice <= 50000 OR o_orderstatus = 'P'"),
    "v_one_of": Check("orders", "o_orderkey", ORDER, {"oneOf": [props(price={"maximum": 150000}), props(status={"const": "O"})]}, "(o_totalprice <= 150000)::int + (o_orderstatus = 'O')::int = 1"),
    "v_not": Check("orders", "o_orderkey", ORDER, {"not": props(status={"const": "F"})}, "o_orderstatus <> 'F'"),
    "v_if_then_else": Check("orders", "o_orderkey", ORDER, {"if": props(status={"const": "F"}), "then": props(price={"minimum": 100000}), "else": props(price={"maximum": 200000})}, "CASE WHEN o_orderstatus = 'F' THEN o_totalprice >= 100000 ELSE o_totalprice <= 200000 END"),
    "v_boolean_schema": Check("orders", "o_orderkey", BAND, {"properties": {"done": False, "key": True}}, f"NOT {DONE}"),
    "v_ref_local": Check("customer", "c_custkey", doc(n="c_nationkey", m="c_nationkey + 2"), {"$defs": {"n": {"type": "integer", "maximum": 15}}, "properties": {"n": {"$ref": "#/$defs/n"}, "m": {"$ref": "#/properties/n"}}}, "c_nationkey + 2 <= 15"),
    "v_ref_cross": Check("customer", "c_custkey", doc(n="c_nationkey"), props(n={"$ref": "https://example.org/nation"}), "c_nationkey BETWEEN 5 AND 20", schemas=[NATION]),
    "v_draft7_dependencies": Check("orders", "o_orderkey", BAND, {"$schema": "http://json-schema.org/draft-07/schema#", "definitions": {"big": {"minimum": 120000}}, "properties": {"high": {"$ref": "#/definitions/big"}}, "dependencies": {"done": ["high"], "low": {"maxProperties": 3}}}, f"(NOT {HIGH} OR o_totalprice >= 120000) AND (NOT {DONE} OR {HIGH}) AND (NOT {LOW} OR 2 + {HIGH}::int + {DONE}::int <= 3)"),
    "v_unevaluated_props": Check("orders", "o_orderkey", BAND, {"properties": {"key": {}}, "anyOf": [{"properties": {"low": {"maximum": 150000}}, "required": ["low"]}, {"properties": {"high": {}}, "required": ["high"]}], "unevaluatedProperties": False}, f"NOT {DONE} AND (({LOW} AND o_totalprice <= 150000) OR {HIGH}) AND (NOT {LOW} OR o_totalprice <= 150000)"),
    "v_unevaluated_items": Check("lineitem", "l_orderkey", LINES, {"allOf": [{"prefixItems": [True]}], "prefixItems": [True, True], "contains": {"maximum": 9}, "minContains": 0, "unevaluatedItems": False}, "count(*) <= greatest(2, count(*) FILTER (cast(l_quantity AS int) <= 9))", group=QUANTITIES),
}

TREE = {"type": "object", "properties": {"n": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#"}}}, "required": ["n"], "additionalProperties": False}
EVENT = props(required=["k"], k={"type": "integer", "minimum": 50})
ROLE = props(status={"type": "string"}, price={"type": "number"}, role={"default": "user"}) | {"additionalProperties": False}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e_errors_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of a customer record, one row each."""
    v = Validator(props(required=["segment"], balance={"minimum": 0}, segment={"enum": ["BUILDING", "MACHINERY"]}, name={"maxLength": 17, "pattern": "[02468]$"}))
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(doc(balance="c_acctbal", segment="CASE WHEN c_nationkey <> 3 THEN c_mktsegment END", name="c_name")).alias("value"))
    return df.select("c_custkey", F.explode(v.errors("value")).alias("e")).select("c_custkey", "e.keyword", "e.instancePath", "e.schemaPath", "e.params", "e.message")


def m_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Validator(props(status={"type": "string"}, low={"default": 0}, tier={"default": "basic"}))
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(doc(status="o_orderstatus", low="CASE WHEN o_totalprice < 200000 THEN 1 END")).alias("value"))
    out = v.transformed("value")
    return df.select("o_orderkey", out.alias("value")).select("o_orderkey", F.get_json_object("value", "$.status").alias("status"), F.get_json_object("value", "$.low").cast("int").alias("low"), F.get_json_object("value", "$.tier").alias("tier"))


def m_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings to numbers, integers and booleans, and a number to a string, on typed columns."""
    v = Validator(props(size={"type": "integer"}, half={"type": "integer"}, price={"type": "number"}, flag={"type": "boolean"}, key={"type": "string"}), coerce_types=True)
    df = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"), F.concat(F.col("p_size").cast("string"), F.lit(".5")).alias("half"), F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".25 ")).alias("price"), F.when(F.col("p_size") > 25, "true").otherwise("0").alias("flag"), F.col("p_partkey").alias("key"))
    return v.transform_columns(df)


def m_coerce_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Validator(props(size={"type": "integer"}, flag={"type": "boolean"}, key={"type": "string"}), coerce_types=True)
    df = _table(spark, sf_dir, "part").select("p_partkey", F.expr(doc(size="cast(p_size as string)", flag="if(p_size > 25, '1', 'false')", key="p_partkey")).alias("value"))
    return df.select("p_partkey", v.transformed("value").alias("value"))


def m_remove_additional(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Validator(ROLE, remove_additional=True)
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(doc(status="o_orderstatus", extra="o_orderkey", role="CASE WHEN o_totalprice > 100000 THEN 'admin' END")).alias("value"))
    return df.select("o_orderkey", v.transformed("value").alias("value"))


def d_count_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Validator(EVENT).count_valid(_table(spark, sf_dir, "events"), "props")


def d_valid_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    return df.groupBy("event_type").agg(F.count_if(Validator(EVENT).is_valid("props")).alias("valid"), F.count("*").alias("total"))


def d_filter_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Validator(EVENT).filter_valid(_table(spark, sf_dir, "events"), "props").select("event_id", "props")


def d_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = Validator(EVENT).split_valid(_table(spark, sf_dir, "events"), "props")
    return bad.select("event_id", F.get("errors", F.lit(0))["keyword"].alias("keyword"), F.size("errors").alias("n"))


def d_ndjson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one NDJSON buffer with empty lines, then a verdict for each line."""
    parts = F.sort_array(F.collect_list(F.struct("event_id", "props")))
    buffers = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(parts, lambda e: F.concat(e["props"], F.lit("\n"))), "\n").alias("buffer"))
    return lines_of(buffers, "buffer", "user_id").select("user_id", "line_no", Validator(EVENT).is_valid("value").alias("ok"))


def d_typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's own columns, tested without JSON; the scan gets the predicates."""
    df = _table(spark, sf_dir, "orders")
    v = Validator(props(required=["o_orderkey"], o_orderstatus={"type": "string", "enum": ["F", "O"]}, o_totalprice={"type": "number", "minimum": 1000, "exclusiveMaximum": 250000}, o_orderpriority={"type": "string", "minLength": 5}))
    return df.where(v.row_valid(df)).select("o_orderkey", "o_orderstatus")


def s_standard_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select("event_id", Validator(EVENT).standard("props").alias("r"))
    return df.select("event_id", F.to_json("r.value").alias("value"), F.get(F.get("r.issues", F.lit(0))["path"], F.lit(0)).alias("path"))


def r_recursive_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of nations; a recursive schema runs on the interpreter."""
    text = "concat('{\"n\":', c_nationkey, ',\"kids\":[{\"n\":', if(c_acctbal < 0, '\"x\"', '1'), ',\"kids\":[]},{\"n\":2}]}')"
    return _table(spark, sf_dir, "customer").select("c_custkey", Validator(TREE).is_valid(F.expr(text)).alias("ok"))


def r_container_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers compare by value, whatever the key order and the numbers' spelling."""
    v = Validator(props(v={"enum": [{"a": [1, 2.0], "b": "F"}, [1, [2]]]}))
    text = "concat('{\"v\":{\"b\":\"', o_orderstatus, '\",\"a\":[1.0,', if(o_totalprice > 100000, '2', '3'), ']}}')"
    return _table(spark, sf_dir, "orders").select("o_orderkey", v.is_valid(F.expr(text)).alias("ok"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: check.spark for name, check in CHECKS.items()} | {
    f.__name__: f
    for f in (e_errors_exploded, m_defaults, m_coerce, m_coerce_json, m_remove_additional, d_count_valid, d_valid_by_group, d_filter_valid, d_rejected, d_ndjson_lines, d_typed_rows, s_standard_result, r_recursive_ref, r_container_const)
}

GOOD = "cast(json_extract_string(props, '$.k') AS int) >= 50"
ORACLE_SQL = {name: check.duckdb() for name, check in CHECKS.items()} | {
    "e_errors_exploded": """
        SELECT c_custkey, 'required' AS keyword, '' AS "instancePath", '#/required' AS "schemaPath", '{"missingProperty":"segment"}' AS params, 'must have required property ''segment''' AS message FROM customer WHERE c_nationkey = 3
        UNION ALL SELECT c_custkey, 'minimum', '/balance', '#/properties/balance/minimum', '{"comparison":">=","limit":0}', 'must be >= 0' FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT c_custkey, 'enum', '/segment', '#/properties/segment/enum', '{"allowedValues":["BUILDING","MACHINERY"]}', 'must be equal to one of the allowed values' FROM customer WHERE c_nationkey <> 3 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
        UNION ALL SELECT c_custkey, 'maxLength', '/name', '#/properties/name/maxLength', '{"limit":17}', 'must NOT have more than 17 characters' FROM customer WHERE length(c_name) > 17
        UNION ALL SELECT c_custkey, 'pattern', '/name', '#/properties/name/pattern', '{"pattern":"[02468]$"}', 'must match pattern "[02468]$"' FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')""",
    "m_defaults": "SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_totalprice < 200000 THEN 1 ELSE 0 END::int AS low, 'basic' AS tier FROM orders",
    "m_coerce": "SELECT p_partkey, p_size::bigint AS size, NULL::bigint AS half, p_size + 0.25::double AS price, p_size > 25 AS flag, p_partkey::varchar AS key FROM part",
    "m_coerce_json": "SELECT p_partkey, '{\"size\":' || p_size || ',\"flag\":' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || ',\"key\":\"' || p_partkey || '\"}' AS value FROM part",
    "m_remove_additional": "SELECT o_orderkey, '{\"status\":\"' || o_orderstatus || '\",\"role\":\"' || CASE WHEN o_totalprice > 100000 THEN 'admin' ELSE 'user' END || '\"}' AS value FROM orders",
    "d_count_valid": f"SELECT count(*) FILTER (WHERE {GOOD}) AS valid, count(*) AS total FROM events",
    "d_valid_by_group": f"SELECT event_type, count(*) FILTER (WHERE {GOOD}) AS valid, count(*) AS total FROM events GROUP BY event_type",
    "d_filter_valid": f"SELECT event_id, props FROM events WHERE {GOOD}",
    "d_rejected": f"SELECT event_id, 'minimum' AS keyword, 1::int AS n FROM events WHERE NOT {GOOD}",
    "d_ndjson_lines": f"SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::int AS line_no, {GOOD} AS ok FROM events",
    "d_typed_rows": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND o_totalprice < 250000 AND length(o_orderpriority) >= 5",
    "s_standard_result": f"SELECT event_id, CASE WHEN {GOOD} THEN replace(props, ' ', '') END AS value, CASE WHEN NOT {GOOD} THEN 'k' END AS path FROM events",
    "r_recursive_ref": "SELECT c_custkey, c_acctbal >= 0 AS ok FROM customer",
    "r_container_const": "SELECT o_orderkey, o_orderstatus = 'F' AND o_totalprice > 100000 AS ok FROM orders",
}
