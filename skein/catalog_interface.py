"""The driver's queries on the rest of the interface: texts and bytes, batches, files, schemas by row, references, specs,
nested changes and schema analysis."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import skein
from skein.catalog import EVENT, GOOD, NATION, ORDER, doc, props
from skein.operators.validator import Facade, Validator, bundle, load_bundle, valid_under, validate, version
from skein.plans.schema import SchemaError, evaluated
from skein.sources import harness
from skein.sources.ndjson import read_ndjson


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def d_bad_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that aren't one strict JSON value, seven kinds of them."""
    spoiled = ["props", "substr(props, 1, length(props) - 1)", "concat(props, ' x')", "concat(props, props)", "replace(props, '}', ',\"k\":1}')", "replace(props, '\"', '\\'')", "replace(props, ': ', ': 0')", "''"]
    text = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(spoiled)) + " END"
    return _table(spark, sf_dir, "events").select("event_id", Validator(EVENT).is_valid(F.expr(text)).alias("ok"))


def d_valid_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are parsed already."""
    return _table(spark, sf_dir, "events").select("event_id", Validator(EVENT).is_valid_variant(F.parse_json("props")).alias("ok"))


def d_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    return Validator(EVENT).validate(df).select("event_id", "result.valid", F.size("result.errors").alias("n"))


def d_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary texts, whole and by their first bytes."""
    v, raw = Validator(EVENT), F.col("props").cast("binary")
    df = _table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), F.concat(raw, F.lit(b"\x00{padding")).alias("padded"), F.octet_length("props").alias("size"))
    return df.select("event_id", v.is_valid("raw").alias("ok"), v.is_valid("padded").alias("padded_ok"), v.is_valid_prefix("padded", F.col("size")).alias("prefix_ok"))


def d_batch_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each user's batch are valid."""
    batches = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("props").alias("batch"))
    return batches.select("user_id", Validator(EVENT).count_in("batch").alias("valid"), F.size("batch").alias("total"))


def d_read_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written to files and read back by the source, the empty ones left out."""
    where = (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()).rstrip("/") + f"/ndjson-{uuid.uuid4().hex}"
    text = F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("\n"))).otherwise(F.col("props"))
    _table(spark, sf_dir, "events").select(text).write.text(where)
    return Validator(EVENT).count_valid(read_ndjson(spark, where))


def d_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of a table that is checked once."""
    good, bad = Validator(EVENT).split_valid(_table(spark, sf_dir, "events"), "props")
    return good.select("event_id", F.lit(0).alias("n")).union(bad.select("event_id", F.size("errors")))


def s_schema_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order under its own schema, compiled and checked in one go."""
    schema = "CASE WHEN o_orderstatus = 'F' THEN '{\"properties\":{\"price\":{\"minimum\":100000}}}' WHEN o_orderstatus = 'O' THEN '{\"properties\":{\"priority\":{\"enum\":[\"5-LOW\"]}}}' ELSE 'false' END"
    return _table(spark, sf_dir, "orders").select("o_orderkey", valid_under(F.expr(schema), F.expr(ORDER)).alias("ok"))


def _nation(v: Validator, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", v.is_valid(F.expr(doc(n="c_nationkey"))).alias("ok"))


def s_add_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Validator(props(n={"$ref": NATION["$id"]}))
    v.add_schema(NATION)
    return _nation(v, spark, sf_dir)


def s_schemas_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(Validator(props(n={"$ref": "nation"}), {"nation": {k: x for k, x in NATION.items() if k != "$id"}}), spark, sf_dir)


def s_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validator that is saved as JSON text and loaded."""
    v = Validator(props(n={"$ref": NATION["$id"]}), [NATION])
    return _nation(Validator.from_spec(json.dumps(v.spec())), spark, sf_dir)


def s_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three validators saved as one text, equal ones once."""
    low, high = Validator(props(n={"maximum": 9})), Validator(props(n={"minimum": 7}))
    made = load_bundle(bundle([low, high, Validator(props(n={"maximum": 9}))]))
    text = F.expr(doc(n="c_nationkey"))
    return _table(spark, sf_dir, "customer").select("c_custkey", *(v.is_valid(text).alias(f"ok{i}") for i, v in enumerate(made)))


def s_facade(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Facade().add_schema(NATION).compile(props(n={"$ref": NATION["$id"]}))
    return _table(spark, sf_dir, "customer").select("c_custkey", run.column(F.expr(doc(n="c_nationkey"))).alias("ok"))


def s_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(version()).alias("version"))


def s_one_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single values, checked on the driver."""
    cases = [("integer", "3"), ("integer", "3.5"), ("string", '"x"'), ("null", "nul"), ("array", "[1]")]
    return spark.createDataFrame([(k, t, validate({"type": k}, t)["valid"]) for k, t in cases], "kind string, value string, ok boolean")


def s_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of the line-delimited test protocol, one for each customer."""
    text = "concat('{\"cmd\":\"run\",\"seq\":', c_custkey, ',\"case\":{\"schema\":{\"maximum\":12},\"tests\":[{\"instance\":', c_nationkey, '},{\"instance\":\"x\"}]}}')"
    df = _table(spark, sf_dir, "customer").select("c_custkey", harness.answers(F.expr(text)).alias("answer"))
    return df.select("c_custkey", F.get_json_object("answer", "$.seq").cast("long").alias("seq"), F.get_json_object("answer", "$.results[0].valid").alias("first"), F.get_json_object("answer", "$.results[1].valid").alias("second"))


def m_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal, coercion and defaults two levels down."""
    inner = props(n={"type": "integer"}, on={"type": "boolean"}, unit={"default": "pc"}) | {"additionalProperties": False}
    v = Validator(props(part=inner, key={"type": "string"}), coerce_types=True, remove_additional=True)
    text = "concat('{\"part\":{\"n\":\"', p_size, '\",\"gone\":[1],\"on\":\"', if(p_size > 25, '1', 'no'), '\"},\"key\":', p_partkey, ',\"more\":null}')"
    return _table(spark, sf_dir, "part").select("p_partkey", v.transformed(F.expr(text)).alias("value"))


def p_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check always evaluates, by the schema alone."""
    schemas = {
        "plain": {"properties": {"a": {}, "b": {}}, "prefixItems": [{}]},
        "all": {"properties": {"a": {}}, "allOf": [{"properties": {"c": {}}, "prefixItems": [{}, {}]}]},
        "open": {"additionalProperties": {"type": "string"}, "items": True},
        "ref": {"$defs": {"d": {"properties": {"e": {}}}}, "$ref": "#/$defs/d"},
        "dynamic": {"properties": {"a": {}}, "anyOf": [{"properties": {"f": {}}}]},
    }
    found = {k: evaluated(Validator(s).node) for k, s in schemas.items()}
    rows = [(k, ",".join(sorted(e["props"])), e["items"], e["allProps"], e["allItems"], e["dynamic"]) for k, e in found.items()]
    return spark.createDataFrame(rows, "name string, props string, items int, all_props boolean, all_items boolean, dynamic boolean")


def r_unresolved_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that lead nowhere, refused when the schema is compiled."""
    rows = []
    for ref in ("#/$defs/here", "#/$defs/none", "urn:none", "https://example.org/nation", "#/properties/0"):
        try:
            rows.append((ref, Validator({"$defs": {"here": {"type": "integer"}}, "properties": {"n": {"$ref": ref}}}, [NATION]).node is not None))
        except SchemaError:
            rows.append((ref, False))
    return spark.createDataFrame(rows, "ref string, resolved boolean")


def r_mutual_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two schemas that refer to each other."""
    a = {"$id": "urn:even", "type": "object", "properties": {"n": {"type": "integer"}, "next": {"$ref": "urn:odd"}}, "required": ["n"]}
    b = {"$id": "urn:odd", "type": "object", "properties": {"s": {"type": "string"}, "next": {"$ref": "urn:even"}}, "required": ["s"]}
    text = "concat('{\"n\":1,\"next\":{\"s\":\"x\",\"next\":{\"', if(c_acctbal < 0, 'm', 'n'), '\":', c_nationkey, '}}}')"
    return _table(spark, sf_dir, "customer").select("c_custkey", Validator(a, [b]).is_valid(F.expr(text)).alias("ok"))


def t_transform_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults and removal on a table's own columns."""
    v = Validator(props(c_custkey={}, c_mktsegment={"type": "string"}, tier={"default": "basic"}) | {"additionalProperties": False}, remove_additional=True)
    return v.transform_columns(_table(spark, sf_dir, "customer"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (d_bad_json, d_valid_variant, d_result, d_bytes, d_batch_valid, d_read_ndjson, d_split, s_schema_by_row, s_add_schema, s_schemas_by_name, s_spec, s_bundle, s_facade, s_version, s_one_shot, s_harness, m_nested, p_evaluated, r_unresolved_ref, r_mutual_ref, t_transform_defaults)
}

IN_NATION = "SELECT c_custkey, c_nationkey BETWEEN 5 AND 20 AS ok FROM customer"
ORACLE_SQL = {
    "d_bad_json": f"SELECT event_id, event_id % 8 = 0 AND {GOOD} AS ok FROM events",
    "d_valid_variant": f"SELECT event_id, {GOOD} AS ok FROM events",
    "d_result": f"SELECT event_id, {GOOD} AS valid, (NOT {GOOD})::int AS n FROM events",
    "d_bytes": f"SELECT event_id, {GOOD} AS ok, false AS padded_ok, {GOOD} AS prefix_ok FROM events",
    "d_batch_valid": f"SELECT user_id, (count(*) FILTER (WHERE {GOOD}))::int AS valid, count(*)::int AS total FROM events GROUP BY user_id",
    "d_read_ndjson": f"SELECT count(*) FILTER (WHERE {GOOD}) AS valid, count(*) AS total FROM events",
    "d_split": f"SELECT event_id, (NOT {GOOD})::int AS n FROM events",
    "s_schema_by_row": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_totalprice >= 100000 WHEN 'O' THEN o_orderpriority = '5-LOW' ELSE false END AS ok FROM orders",
    "s_add_schema": IN_NATION,
    "s_schemas_by_name": IN_NATION,
    "s_spec": IN_NATION,
    "s_bundle": "SELECT c_custkey, c_nationkey <= 9 AS ok0, c_nationkey >= 7 AS ok1, c_nationkey <= 9 AS ok2 FROM customer",
    "s_facade": IN_NATION,
    "s_version": f"SELECT '{skein.__version__}' AS version",
    "s_one_shot": "SELECT * FROM (VALUES ('integer', '3', true), ('integer', '3.5', false), ('string', '\"x\"', true), ('null', 'nul', false), ('array', '[1]', true)) t(kind, value, ok)",
    "s_harness": "SELECT c_custkey, c_custkey AS seq, CASE WHEN c_nationkey <= 12 THEN 'true' ELSE 'false' END AS first, 'true' AS second FROM customer",
    "m_nested": "SELECT p_partkey, '{\"part\":{\"n\":' || p_size || ',\"on\":' || CASE WHEN p_size > 25 THEN 'true' ELSE '\"no\"' END || ',\"unit\":\"pc\"},\"key\":\"' || p_partkey || '\",\"more\":null}' AS value FROM part",
    "p_evaluated": "SELECT * FROM (VALUES ('plain', 'a,b', 1, false, false, false), ('all', 'a,c', 2, false, false, false), ('open', '', 0, true, true, false), ('ref', 'e', 0, false, false, false), ('dynamic', 'a', 0, false, false, true)) t(name, props, items, all_props, all_items, dynamic)",
    "r_unresolved_ref": "SELECT * FROM (VALUES ('#/$defs/here', true), ('#/$defs/none', false), ('urn:none', false), ('https://example.org/nation', true), ('#/properties/0', false)) t(ref, resolved)",
    "r_mutual_ref": "SELECT c_custkey, c_acctbal >= 0 AS ok FROM customer",
    "t_transform_defaults": "SELECT c_custkey, c_mktsegment, 'basic' AS tier FROM customer",
}
