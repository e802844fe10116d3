"""The validator: a schema compiled once, used as columns, as DataFrame operations and on single values."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterable, Mapping
from functools import cached_property, lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

import skein
from skein.functions import patterns
from skein.functions.values import BadJson, document, parse
from skein.operators import interpreter, mutate
from skein.operators.verdict import Test, accepts_text, verdict
from skein.plans import compile as plan
from skein.plans import typed
from skein.plans.schema import Compiler, Node, SchemaError, fingerprint, load, reach

ERROR = "struct<keyword:string,instancePath:string,schemaPath:string,params:string,message:string>"
ISSUE = "struct<message:string,path:array<string>>"
#: Keywords of plain record schemas.
PLAIN = frozenset("$schema $id $defs $comment title description default examples type enum const properties required minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern format".split())
#: Compiled schemas by their fingerprint, the latest ones.
_COMPILED: OrderedDict[str, Node] = OrderedDict()
MOST_COMPILED = 1024


def syntax(message: str) -> dict[str, str]:
    return {"keyword": "syntax", "instancePath": "", "schemaPath": "#", "params": "{}", "message": message}


def _text_errors(node: Node, text: str | None, test: Test | None = None) -> list[dict[str, str]]:
    """test: the node's verdict, which spares the valid the search for errors."""
    try:
        value = parse(text)
    except BadJson as e:
        return [syntax(str(e))]
    return [] if test and test(value) else interpreter.errors(node, value)


class Validator:
    """schema: JSON text, dict or boolean. schemas: other schemas to refer to, a list (each with $id) or a dict by name.

    Compiling is lazy, so add_schema works until the first use. coerce_types and remove_additional choose what
    transform does; defaults are always filled in there. Validation itself never changes a value. engine: auto takes
    column expressions where they can hold the check, else the interpreter on Arrow batches; column or interpreter
    force one. safe_patterns refuses patterns with a repetition inside a repetition, which the backtracking engines
    may take exponential time for."""

    def __init__(self, schema: Any, schemas: Iterable[Any] | Mapping[str, Any] | None = None, coerce_types: bool = False, remove_additional: bool = False, engine: str = "auto", safe_patterns: bool = False):
        self.schema = load(schema)
        self.registry: dict[str, Any] = {}
        self.safe_patterns = safe_patterns
        self.coerce_types, self.remove_additional, self.engine = coerce_types, remove_additional, engine
        if isinstance(schemas, Mapping):
            for name, s in schemas.items():
                s = load(s)
                self.registry[s.get("$id", name) if isinstance(s, dict) else name] = s
        else:
            for s in schemas or ():
                self.add_schema(s)

    def add_schema(self, schema: Any) -> None:
        if "node" in self.__dict__:
            raise SchemaError("schemas can only be added before the first use")
        schema = load(schema)
        if not isinstance(schema, dict) or not isinstance(schema.get("$id"), str):
            raise SchemaError("an added schema needs an $id")
        self.registry[schema["$id"]] = schema

    @cached_property
    def node(self) -> Node:
        key = fingerprint(self.schema, self.registry)
        root = _COMPILED.get(key) or Compiler(self.schema, self.registry).root
        _COMPILED[key] = root
        _COMPILED.move_to_end(key)
        while len(_COMPILED) > MOST_COMPILED:
            _COMPILED.popitem(last=False)
        if self.safe_patterns:
            for n in reach(root):
                for p in [n.get("pattern"), *(n.get("patternProperties") or {})]:
                    if isinstance(p, str) and patterns.nested_quantifier(p):
                        raise SchemaError(f"a repetition inside a repetition: {p!r}")
        return root

    @cached_property
    def as_columns(self) -> bool:
        """Whether the check runs as column expressions."""
        return self.engine == "column" or self.engine == "auto" and plan.expressible(self.node)

    @cached_property
    def _plain(self) -> bool:
        """Whether the check is a record's: with some others the planner leaves a Python function unplanned if the check is
        in its argument, so the error lists of those are looked for in all rows."""
        return self.as_columns and all(isinstance(n.raw, bool) or not set(n.raw) - PLAIN for n in reach(self.node))

    # Columns

    def is_valid(self, text: Column | str) -> Column:
        """Whether a string or binary column holds one valid JSON document; false for NULL and for bad JSON."""
        text = (F.col(text) if isinstance(text, str) else text).cast("string")
        if self.as_columns:
            return plan.let(document(text), lambda d: d.isNotNull() & plan.valid(self.node, d))
        node = self.node

        @arrow_udf("boolean")
        def check(texts: pa.Array) -> pa.Array:
            test = verdict(node)
            return pa.array([accepts_text(test, t) for t in texts.to_pylist()], pa.bool_())

        return check(text)

    def is_valid_prefix(self, buffer: Column | str, size: Column | int) -> Column:
        """The same for the first `size` bytes of a binary column."""
        buffer = F.col(buffer) if isinstance(buffer, str) else buffer
        return self.is_valid(F.substring(buffer.cast("binary"), F.lit(1), size if isinstance(size, Column) else F.lit(size)))

    def is_valid_variant(self, value: Column | str) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        if self.as_columns:
            return plan.let(value, lambda d: d.isNotNull() & plan.valid(self.node, d))
        return self.is_valid(F.to_json(value))

    def count_in(self, texts: Column | str) -> Column:
        """How many of an array of texts are valid."""
        texts = F.col(texts) if isinstance(texts, str) else texts
        if self.as_columns:
            return F.size(F.filter(texts, lambda t: self.is_valid(t)))
        node = self.node

        @arrow_udf("int")
        def count(batch: pa.Array) -> pa.Array:
            test = verdict(node)
            return pa.array([None if x is None else sum(accepts_text(test, t) for t in x) for x in batch.to_pylist()], pa.int32())

        return count(texts)

    def errors(self, text: Column | str, first: bool = False, invalid: bool = False) -> Column:
        """The list of errors, empty for a valid document. Under a plain record schema, valid rows don't reach the interpreter
        with their text; invalid says that there are none, so that the verdict isn't computed."""
        text = (F.col(text) if isinstance(text, str) else text).cast("string")
        node, known = self.node, self._plain or invalid
        kind = pa.list_(pa.struct([(n, pa.string()) for n in ("keyword", "instancePath", "schemaPath", "params", "message")]))

        @arrow_udf(f"array<{ERROR}>")
        def find(texts: pa.Array) -> pa.Array:
            test = None if known else verdict(node)
            return pa.array([[] if t is None else _text_errors(node, t, test) for t in texts.to_pylist()], kind)

        text = F.coalesce(text, F.lit(""))
        found = find(F.when(self.is_valid(text), F.lit(None)).otherwise(text) if self._plain and not invalid else text)
        return F.slice(found, 1, 1) if first else found

    def result(self, text: Column | str) -> Column:
        """struct<valid, errors>; valid is exactly that there is no error."""
        return plan_struct(self.errors(text))

    def standard(self, text: Column | str) -> Column:
        """struct<value, issues>, one of the two NULL."""
        text = (F.col(text) if isinstance(text, str) else text).cast("string")
        parts = lambda e: F.transform(F.slice(F.split(e["instancePath"], "/"), 2, 1000000), lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
        return F.element_at(
            F.transform(F.array(self.errors(text)), lambda e: F.struct(F.when(F.size(e) == 0, document(text)).alias("value"), F.when(F.size(e) > 0, F.transform(e, lambda x: F.struct(x["message"].alias("message"), parts(x).alias("path")))).alias("issues"))),
            1,
        )

    def transformed(self, text: Column | str) -> Column:
        """The document's text with undeclared properties removed, scalars coerced and defaults filled in, as chosen;
        NULL for bad JSON."""
        text = (F.col(text) if isinstance(text, str) else text).cast("string")
        node, coercion, removal = self.node, self.coerce_types, self.remove_additional

        @arrow_udf("string")
        def change(texts: pa.Array) -> pa.Array:
            out = []
            for t in texts.to_pylist():
                try:
                    out.append(json.dumps(mutate.transform(node, parse(t), True, coercion, removal), ensure_ascii=False, separators=(",", ":")))
                except BadJson:
                    out.append(None)
            return pa.array(out, pa.string())

        return change(text)

    # DataFrames

    def validate(self, df: DataFrame, column: str = "value", into: str = "result") -> DataFrame:
        return df.withColumn(into, self.result(column))

    def filter_valid(self, df: DataFrame, column: str = "value") -> DataFrame:
        return df.where(self.is_valid(column))

    def count_valid(self, df: DataFrame, column: str = "value") -> DataFrame:
        """One row: valid, total. Partial counts, no shuffle of documents."""
        return df.agg(F.count_if(self.is_valid(column)).alias("valid"), F.count("*").alias("total"))

    def split_valid(self, df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
        """The valid rows, and the others with their errors. Each side computes the verdict once; to compute it once for
        both, persist marked() and take its halves."""
        return self.halves(self.marked(df, column), column)

    def marked(self, df: DataFrame, column: str = "value", into: str = "is_valid") -> DataFrame:
        return df.withColumn(into, self.is_valid(column))

    def halves(self, marked: DataFrame, column: str = "value", by: str = "is_valid") -> tuple[DataFrame, DataFrame]:
        """Of rows with their verdict: the valid ones, and the others with their errors."""
        return marked.where(F.col(by)).drop(by), marked.where(~F.col(by)).drop(by).withColumn("errors", self.errors(column, invalid=True))

    def row_valid(self, df: DataFrame) -> Column:
        """Whether a row of df, as an object of its columns, is valid; SQL NULL is an absent property. Scalar columns
        are tested as they are, which scans can use; anything else goes through the row's JSON."""
        simple = typed.row_valid(self.node, df)
        return simple if simple is not None else self.is_valid(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))

    def transform_columns(self, df: DataFrame) -> DataFrame:
        return mutate.transform_columns(df, self.node, True, self.coerce_types, self.remove_additional)

    # Single values, on the driver

    def check(self, value: Any) -> dict[str, Any]:
        """{valid, errors} of a Python value; the value stays as it is."""
        found = interpreter.errors(self.node, value)
        return {"valid": not found, "errors": found}

    def check_json(self, text: str) -> dict[str, Any]:
        found = _text_errors(self.node, text)
        return {"valid": not found, "errors": found}

    def accepts(self, value: Any) -> bool:
        return interpreter.is_valid(self.node, value)

    def accepts_json(self, text: str | bytes) -> bool:
        try:
            return interpreter.is_valid(self.node, parse(text.decode() if isinstance(text, bytes) else text))
        except (BadJson, UnicodeDecodeError):
            return False

    def transform(self, value: Any) -> Any:
        return mutate.transform(self.node, value, True, self.coerce_types, self.remove_additional)

    def accepts_lines(self, buffer: str | bytes) -> list[bool]:
        """A verdict for each line that isn't empty."""
        lines = buffer.split(b"\n") if isinstance(buffer, bytes) else buffer.split("\n")
        return [self.accepts_json(x) for x in lines if x]

    # Persistence

    def spec(self) -> dict[str, Any]:
        """All that is needed to build this validator again, as JSON."""
        return {"version": skein.__version__, "key": fingerprint(self.schema, self.registry), "schema": self.schema, "schemas": self.registry, "options": {"coerce_types": self.coerce_types, "remove_additional": self.remove_additional}}

    @classmethod
    def from_spec(cls, spec: Mapping[str, Any] | str) -> Validator:
        spec = json.loads(spec) if isinstance(spec, str) else spec
        return cls(spec["schema"], spec["schemas"], **spec["options"])


def plan_struct(errors: Column) -> Column:
    return F.element_at(F.transform(F.array(errors), lambda e: F.struct((F.size(e) == 0).alias("valid"), e.alias("errors"))), 1)


def validate(schema: Any, value: Any) -> dict[str, Any]:
    """Compiles and checks in one go; a str is JSON text."""
    v = Validator(schema)
    return v.check_json(value) if isinstance(value, str) else v.check(value)


@lru_cache(256)
def _by_text(schema: str) -> Test:
    return verdict(Validator(schema).node)


def valid_under(schema: Column | str, text: Column | str) -> Column:
    """Whether each row's text is valid under the row's own schema text; NULL for a NULL schema. A task compiles each
    schema once and keeps the latest; a bad schema raises."""

    @arrow_udf("boolean")
    def check(schemas: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([None if s is None else t is not None and accepts_text(_by_text(s), t) for s, t in zip(schemas.to_pylist(), texts.to_pylist(), strict=True)], pa.bool_())

    return check(schema, text)


def batch_valid(schema: Any, texts: Iterable[str | bytes]) -> int:
    """How many of the texts are valid."""
    v = Validator(schema)
    return sum(v.accepts_json(t) for t in texts)


def version() -> str:
    return skein.__version__


def bundle(validators: Iterable[Validator]) -> str:
    """JSON text of several validators' specs; equal ones are kept once."""
    specs, order = {}, []
    for v in validators:
        s = v.spec()
        key = s["key"] + json.dumps(s["options"], sort_keys=True)
        specs.setdefault(key, s)
        order.append(list(specs).index(key))
    return json.dumps({"specs": list(specs.values()), "order": order}, ensure_ascii=False)


def load_bundle(text: str) -> list[Validator]:
    found = json.loads(text)
    made = [Validator.from_spec(s) for s in found["specs"]]
    return [made[i] for i in found["order"]]


class Facade:
    """A compile-and-call interface: compile gives a function of a value, with the last call's errors, and its column
    form."""

    def __init__(self, **options: Any):
        self.options, self.known, self.errors = options, {}, None

    def add_schema(self, schema: Any, key: str | None = None) -> Facade:
        schema = load(schema)
        self.known[key or schema["$id"]] = schema
        return self

    def compile(self, schema: Any):
        own = Validator(schema, self.known, **self.options)

        def run(value: Any) -> bool:
            found = own.check(value)
            run.errors = found["errors"] or None
            return found["valid"]

        run.errors, run.column = None, own.is_valid
        return run

    def get_schema(self, key: str):
        return self.compile(self.known[key]) if key in self.known else None

    def validate(self, schema: Any, value: Any) -> bool:
        run = self.get_schema(schema) if isinstance(schema, str) and schema in self.known else self.compile(schema)
        ok = run(value)
        self.errors = run.errors
        return ok
