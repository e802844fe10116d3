"""The driver's queries on error shapes: one row for each error of a document, against SQL that says which rows have it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalog import BAND, DONE, FLAGGED, HIGH, LINES, LOW, ORDER, QUANTITIES, doc, props
from skein.operators.validator import Validator


@dataclass(frozen=True)
class Errors:
    """schema's errors on documents made of a table's rows. found: for DuckDB (condition, keyword, instancePath, schemaPath,
    params, message); params and message are SQL texts if they start with a bracket."""

    table: str
    key: str
    doc: str
    schema: Any
    found: tuple[tuple[str, str, str, str, str, str], ...]
    group: str | None = None
    message: bool = True

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        if self.group:
            df = df.groupBy(self.key).agg(F.expr(self.group).alias("items"))
        found = df.select(self.key, F.explode_outer(Validator(self.schema).errors(F.expr(self.doc))).alias("e")).where("e IS NOT NULL")
        return found.select(self.key, *(f"e.{c}" for c in ("keyword", "instancePath", "schemaPath", "params", *(["message"] if self.message else []))))

    def duckdb(self) -> str:
        text = lambda t: t if t.startswith("(") else "'" + t.replace("'", "''") + "'"
        rows = self.table
        if self.group:
            rows = f"(SELECT {self.key}, list_sort(list(cast(l_quantity AS int))) AS q, list_sort(list(l_returnflag)) AS f FROM {self.table} GROUP BY {self.key})"
        parts = [f"""SELECT {self.key}, {text(k)} AS keyword, {text(at)} AS "instancePath", {text(path)} AS "schemaPath", {text(params)} AS params{f', {text(m)} AS message' if self.message else ''} FROM {rows} WHERE {cond}""" for cond, k, at, path, params, m in self.found]
        return " UNION ALL ".join(parts)


SIZE = "concat('{\"size\":', if(p_size > 25, concat('\"', p_size, '\"'), cast(p_size as string)), '}')"
FEW, MANY = "must NOT have fewer than {} {}", "must NOT have more than {} {}"
TWIN = "list_min([x for x in range(2, len(f) + 1) if f[x] = f[x - 1]])"

CASES = {
    "e_type": Errors("part", "p_partkey", SIZE, props(size={"type": "integer", "maximum": 20}), (("p_size > 25", "type", "/size", "#/properties/size/type", '{"type":"integer"}', "must be integer"), ("p_size BETWEEN 21 AND 25", "maximum", "/size", "#/properties/size/maximum", '{"comparison":"<=","limit":20}', "must be <= 20"))),
    "e_type_list": Errors("part", "p_partkey", SIZE, props(size={"type": ["boolean", "string"]}), (("p_size <= 25", "type", "/size", "#/properties/size/type", '{"type":"boolean, string"}', "must be boolean, string"),)),
    "e_bounds": Errors("part", "p_partkey", doc(size="p_size"), props(size={"exclusiveMinimum": 10, "exclusiveMaximum": 40, "multipleOf": 7}), (("p_size <= 10", "exclusiveMinimum", "/size", "#/properties/size/exclusiveMinimum", '{"comparison":">","limit":10}', "must be > 10"), ("p_size >= 40", "exclusiveMaximum", "/size", "#/properties/size/exclusiveMaximum", '{"comparison":"<","limit":40}', "must be < 40"), ("p_size % 7 <> 0", "multipleOf", "/size", "#/properties/size/multipleOf", '{"multipleOf":7}', "must be multiple of 7"))),
    "e_const_format": Errors("orders", "o_orderkey", ORDER, props(status={"const": "O"}, priority={"format": "ipv4", "minLength": 6}), (("o_orderstatus <> 'O'", "const", "/status", "#/properties/status/const", '{"allowedValue":"O"}', "must be equal to constant"), ("true", "format", "/priority", "#/properties/priority/format", '{"format":"ipv4"}', 'must match format "ipv4"'), ("length(o_orderpriority) < 6", "minLength", "/priority", "#/properties/priority/minLength", '{"limit":6}', FEW.format(6, "characters")))),
    "e_dependent_required": Errors("orders", "o_orderkey", BAND, {"dependentRequired": {"done": ["high", "low"]}}, ((f"{DONE} AND NOT {HIGH}", "required", "", "#/dependentRequired", '{"missingProperty":"high"}', "must have required property 'high'"), (f"{DONE} AND NOT {LOW}", "required", "", "#/dependentRequired", '{"missingProperty":"low"}', "must have required property 'low'"))),
    "e_array_sizes": Errors("lineitem", "l_orderkey", LINES, {"minItems": 3, "maxItems": 5}, (("len(f) < 3", "minItems", "", "#/minItems", '{"limit":3}', FEW.format(3, "items")), ("len(f) > 5", "maxItems", "", "#/maxItems", '{"limit":5}', MANY.format(5, "items"))), FLAGGED),
    "e_object_sizes": Errors("orders", "o_orderkey", BAND, {"minProperties": 3, "maxProperties": 3}, ((f"1 + {LOW}::int + {HIGH}::int + {DONE}::int < 3", "minProperties", "", "#/minProperties", '{"limit":3}', FEW.format(3, "properties")), (f"{LOW} AND {HIGH} AND {DONE}", "maxProperties", "", "#/maxProperties", '{"limit":3}', MANY.format(3, "properties")))),
    "e_unique_items": Errors("lineitem", "l_orderkey", LINES, {"uniqueItems": True}, ((f"{TWIN} IS NOT NULL", "uniqueItems", "", "#/uniqueItems", f"""('{{"i":' || {TWIN} - 2 || ',"j":' || {TWIN} - 1 || '}}')""", f"('must NOT have duplicate items (items ## ' || {TWIN} - 1 || ' and ' || {TWIN} - 2 || ' are identical)')"),), FLAGGED),
    "e_additional": Errors("orders", "o_orderkey", BAND, {"properties": {"key": {}, "low": {}}, "additionalProperties": False}, tuple((cond, "additionalProperties", "", "#/additionalProperties", f'{{"additionalProperty":"{k}"}}', "must NOT have additional properties") for k, cond in (("high", HIGH), ("done", DONE)))),
    "e_pattern_properties": Errors("orders", "o_orderkey", BAND, {"patternProperties": {"^(low|high)$": {"minimum": 150000}}}, tuple((f"{cond} AND o_totalprice < 150000", "pattern", "", "#/patternProperties", '{"pattern":"^(low|high)$"}', f"patternProperties: value invalid for key {k}") for k, cond in (("low", LOW), ("high", HIGH)))),
    "e_property_names": Errors("orders", "o_orderkey", BAND, {"propertyNames": {"maxLength": 3}}, ((HIGH, "maxLength", "", "#/propertyNames/maxLength", '{"limit":3}', MANY.format(3, "characters")), (DONE, "maxLength", "", "#/propertyNames/maxLength", '{"limit":3}', MANY.format(3, "characters")))),
    "e_contains": Errors("lineitem", "l_orderkey", LINES, {"contains": {"minimum": 40}, "minContains": 1, "maxContains": 2}, (("len([x for x in q if x >= 40]) < 1", "contains", "", "#/contains", '{"limit":1}', "contains: need at least 1 match(es)"), ("len([x for x in q if x >= 40]) > 2", "contains", "", "#/contains", '{"limit":2}', "contains: need at most 2 match(es)")), QUANTITIES),
    "e_items": Errors("lineitem", "l_orderkey", LINES, {"prefixItems": [{"maximum": 20}], "items": {"minimum": 0}, "maxItems": 40}, (("q[1] > 20", "maximum", "/0", "#/prefixItems/0/maximum", '{"comparison":"<=","limit":20}', "must be <= 20"),), QUANTITIES),
    "e_any_of": Errors("orders", "o_orderkey", ORDER, {"anyOf": [props(price={"maximum": 50000}), props(status={"const": "P"})]}, (("NOT (o_totalprice <= 50000 OR o_orderstatus = 'P')", "anyOf", "", "#/anyOf", "{}", "must match a schema in anyOf"),)),
    "e_one_of": Errors("orders", "o_orderkey", ORDER, {"oneOf": [props(price={"maximum": 150000}), props(status={"const": "O"})]}, (("(o_totalprice <= 150000)::int + (o_orderstatus = 'O')::int <> 1", "oneOf", "", "#/oneOf", "{}", "must match exactly one schema in oneOf"),)),
    "e_not": Errors("orders", "o_orderkey", ORDER, {"not": props(status={"const": "F"})}, (("o_orderstatus = 'F'", "not", "", "#/not", "{}", "must NOT be valid"),)),
    "e_then_else": Errors("orders", "o_orderkey", ORDER, {"if": props(status={"const": "F"}), "then": props(price={"minimum": 100000}), "else": props(price={"maximum": 200000})}, (("o_orderstatus = 'F' AND o_totalprice < 100000", "minimum", "/price", "#/then/properties/price/minimum", '{"comparison":">=","limit":100000}', "must be >= 100000"), ("o_orderstatus <> 'F' AND o_totalprice > 200000", "maximum", "/price", "#/else/properties/price/maximum", '{"comparison":"<=","limit":200000}', "must be <= 200000"))),
    "e_false_schema": Errors("orders", "o_orderkey", BAND, {"properties": {"done": False}}, ((DONE, "false schema", "/done", "#/properties/done", "{}", "boolean schema is false"),)),
    "e_unevaluated": Errors("orders", "o_orderkey", BAND, {"properties": {"key": {}}, "anyOf": [{"properties": {"low": {}}, "required": ["low"]}, {"properties": {"high": {}}, "required": ["high"]}], "unevaluatedProperties": False}, ((DONE, "unevaluatedProperties", "", "#/unevaluatedProperties", '{"unevaluatedProperty":"done"}', "must NOT have unevaluated properties"),)),
    "e_unevaluated_items": Errors("lineitem", "l_orderkey", LINES, {"prefixItems": [True, True], "unevaluatedItems": False}, (("len(q) > 2", "unevaluatedItems", "", "#/unevaluatedItems", '{"limit":2}', "must NOT have unevaluated items"),), QUANTITIES),
    "e_reference": Errors("customer", "c_custkey", doc(n="c_nationkey"), {"$defs": {"n": {"maximum": 15}}, "properties": {"n": {"$ref": "#/$defs/n"}}}, (("c_nationkey > 15", "maximum", "/n", "#/properties/n/maximum", '{"comparison":"<=","limit":15}', "must be <= 15"),)),
    # the message is the parser's own
    "e_syntax": Errors("events", "event_id", "if(event_type = 'click', concat(props, ' x'), props)", props(k={"minimum": 0}), (("event_type = 'click'", "syntax", "", "#", "{}", ""),), message=False),
}

RECORD = props(required=["segment"], balance={"minimum": 0}, segment={"enum": ["BUILDING", "MACHINERY"]}, name={"pattern": "[02468]$"})


def e_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first error of a customer record, in the fixed order of keywords."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.expr(doc(balance="c_acctbal", segment="CASE WHEN c_nationkey <> 3 THEN c_mktsegment END", name="c_name"))
    found = Validator(RECORD).errors(text, first=True)
    return df.select("c_custkey", F.explode(found).alias("e")).select("c_custkey", "e.keyword", "e.instancePath")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: case.spark for name, case in CASES.items()} | {"e_first_error": e_first_error}

ORACLE_SQL = {name: case.duckdb() for name, case in CASES.items()} | {
    "e_first_error": """
        SELECT c_custkey, keyword, CASE keyword WHEN 'required' THEN '' WHEN 'minimum' THEN '/balance' WHEN 'enum' THEN '/segment' ELSE '/name' END AS "instancePath"
        FROM (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'required' WHEN c_acctbal < 0 THEN 'minimum' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'enum'
              WHEN NOT regexp_matches(c_name, '[02468]$') THEN 'pattern' END AS keyword FROM customer) WHERE keyword IS NOT NULL""",
}
