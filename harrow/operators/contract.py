"""Data contracts: a small language of types, compiled to Column expressions over VARIANT.

A contract is a type (str, int, float, bool), ``dict`` (any object), ``Field``, ``[item]`` or ``Items(item)``, or a dict of
fields. ``errors`` finds what a record violates; ``tolerated`` drops the errors of lists most of whose items pass;
``validate_table`` treats the rows of a table as the items of one list; ``grouped`` and ``report`` summarise.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.regex import has, let

#: Share of a list's items that must pass; order in which kinds of errors are reported.
THRESHOLDS = {"strict": 1.0, "balanced": 0.8, "lenient": 0.5, "tolerant": 0.5}
KIND_ORDER = {"type": 0, "missing": 0, "null": 1, "structure": 2, "constraint": 3}
ERROR_TYPE = "array<struct<path:string,message:string,value:string,error_kind:string>>"
#: Items of an overlong list that are checked; groups and examples that a report shows.
CHECKED_ITEMS, SHOWN_GROUPS, EXAMPLES = 50, 10, 3


class ContractError(ValueError):
    """An invalid contract."""


@dataclass
class Field:
    """A scalar with constraints."""

    type_: type
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    enum: list[str] | None = None
    optional: bool = False


@dataclass
class Items:
    """A list with a number of items."""

    item: Any
    min_items: int | None = None
    max_items: int | None = None
    allow_empty: bool = False


@dataclass
class Record:
    """Parsed fields of an object: name -> (node, optional)."""

    fields: dict[str, tuple[Any, bool]]


@dataclass
class AnyObject:
    """An object of any fields."""


def parse(contract: Any) -> Field | Items | Record | AnyObject:
    """The checked tree of a contract; ContractError says what is wrong with it."""
    if isinstance(contract, dict):
        fields = {}
        for name, value in contract.items():
            if not isinstance(name, str):
                raise ContractError(f"Field names must be strings, got {type(name).__name__}")
            if not isinstance(value, (type, dict, list, Items, Field)):
                raise ContractError(f"Invalid value for field {name!r}: expected a type, Field(), Items(), dict or list, got {type(value).__name__} value {value!r}")
            fields[name] = (parse(value), isinstance(value, Field) and value.optional)
        return Record(fields)
    if isinstance(contract, list):
        if len(contract) != 1:
            raise ContractError(f"A list contract has exactly one element, the contract of its items; got {len(contract)}")
        return Items(parse(contract[0]))
    if isinstance(contract, Items):
        low, high = contract.min_items, contract.max_items
        for name, n in (("min_items", low), ("max_items", high)):
            if n is not None and n < 0:
                raise ContractError(f"'{name}' must be non-negative, got {n}")
        if low is not None and high is not None and low > high:
            raise ContractError(f"'min_items' ({low}) must be <= 'max_items' ({high})")
        return Items(parse(contract.item), low, high, contract.allow_empty)
    if isinstance(contract, Field):
        return _checked(contract)
    if contract in (str, int, float, bool):
        return Field(contract)
    if contract is dict:
        return AnyObject()
    if contract is list:
        raise ContractError("A contract can't be bare 'list': state the type of the items, as in [str] or Items({'title': str})")
    if isinstance(contract, (str, int, float)):
        raise ContractError(f"A contract is a type, not a value: {contract!r}. Did you mean {type(contract).__name__}?")
    raise ContractError(f"Invalid contract: expected a type (str, int, float, bool, dict), Field(), Items(), dict or list, got {type(contract).__name__}")


def _checked(f: Field) -> Field:
    name = getattr(f.type_, "__name__", f.type_)
    if f.type_ not in (str, int, float, bool):
        raise ContractError(f"Invalid type {name!r} for Field. Allowed types: str, int, float, bool." + (" Use Items() for lists." if f.type_ is list else ""))
    if f.type_ is str:
        if f.min is not None or f.max is not None:
            raise ContractError("'min'/'max' are not valid for str: use 'min_length'/'max_length'")
        if f.enum is not None:
            if not isinstance(f.enum, list) or not f.enum or not all(isinstance(v, str) for v in f.enum):
                raise ContractError("'enum' must be a list of strings and not be empty")
            if f.pattern is not None or f.min_length is not None or f.max_length is not None:
                raise ContractError("'enum' cannot be combined with 'pattern', 'min_length' or 'max_length': the allowed values are known")
        for n, v in (("min_length", f.min_length), ("max_length", f.max_length)):
            if v is not None and v < 0:
                raise ContractError(f"'{n}' must be non-negative, got {v}")
        if f.min_length is not None and f.max_length is not None and f.min_length > f.max_length:
            raise ContractError(f"'min_length' ({f.min_length}) must be <= 'max_length' ({f.max_length})")
    else:
        if f.min_length is not None or f.max_length is not None:
            raise ContractError(f"'min_length'/'max_length' are not valid for {name}. Use 'min'/'max'.")
        for n, v in (("pattern", f.pattern), ("enum", f.enum)):
            if v is not None:
                raise ContractError(f"'{n}' is not valid for {name!r}: it can only be used with 'str'")
        if f.min is not None and f.max is not None and f.min > f.max:
            raise ContractError(f"'min' ({f.min}) must be <= 'max' ({f.max})")
    return f


# ---- values ----------------------------------------------------------------------------------------------------------


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, INT, FLOAT or NULL, of a VARIANT."""
    named = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), "NULL")
        .when(named.startswith("OBJECT"), "OBJECT")
        .when(named.startswith("ARRAY"), "ARRAY")
        .when(named.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | named.rlike(r"^DECIMAL\(\d+,0\)$"), "INT")
        .when(named.isin("DOUBLE", "FLOAT") | named.startswith("DECIMAL"), "FLOAT")
        .otherwise(named)
    )


def items_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def type_name(v: Column) -> Column:
    """The type of a VARIANT in words."""
    kind = _kind(v)
    simple = F.create_map(*[F.lit(x) for pair in (("NULL", "null"), ("BOOLEAN", "boolean"), ("INT", "integer"), ("FLOAT", "float"), ("STRING", "string")) for x in pair])
    return (
        F.when(kind == "ARRAY", F.format_string("list with %d items", F.size(items_of(v))))
        .when(kind == "OBJECT", F.format_string("object with %d keys", F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))))
        .otherwise(F.coalesce(F.try_element_at(simple, kind), F.lower(kind)))
    )


def number_text(x: Column) -> Column:
    """A double as text, shortest form, with .0 for whole numbers and no exponent below 1e16."""
    plain = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when((F.abs(x) < 1e16) & ((F.abs(x) >= 1e-4) | (x == 0)), plain).otherwise(F.lower(x.cast("string")))


def display(v: Column) -> Column:
    """A VARIANT for people: null, a quoted string cut at 50, a number, or what it holds."""
    kind, text = _kind(v), F.try_variant_get(v, "$", "string")
    return (
        F.when(kind == "NULL", "null")
        .when(kind == "STRING", F.concat(F.lit('"'), cut(text), F.lit('"')))
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "True").otherwise("False"))
        .when(kind == "FLOAT", number_text(F.try_variant_get(v, "$", "double")))
        .when(kind.isin("ARRAY", "OBJECT"), F.concat(F.lit("<"), type_name(v), F.lit(">")))
        .otherwise(text)
    )


def cut(text: Column, n: int = 50) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


# ---- checks ----------------------------------------------------------------------------------------------------------


def _none() -> Column:
    return F.array().cast(ERROR_TYPE)


def _one(path: Column, message: Column, value: Column | None, kind: str) -> Column:
    shown = display(value) if value is not None else F.lit(None).cast("string")
    return F.array(F.struct(path.alias("path"), message.alias("message"), shown.alias("value"), F.lit(kind).alias("error_kind")))


def errors(record: Column, node: Any, path: Column | None = None) -> Column:
    """Errors of a VARIANT record against a parsed node, in order. A malformed record (null) is a null value."""
    here = F.struct(record.alias("v"), _kind(record).alias("kind"), (F.lit("") if path is None else path).alias("path"))
    return let(here, lambda s: _errors(s["v"], s["kind"], s["path"], node))


def _errors(v: Column, kind: Column, path: Column, node: Any) -> Column:
    if isinstance(node, Items):
        return _list_errors(v, kind, path, node)
    if isinstance(node, Record):
        parts = [_field_errors(v, path, name, child, optional) for name, (child, optional) in node.fields.items()]
        wrong = _one(path, F.concat(F.lit("expected an object, got "), type_name(v)), v, "type")
        return F.when(kind != "OBJECT", wrong).otherwise(F.concat(*parts) if parts else _none())
    if isinstance(node, AnyObject):
        return F.when(kind != "OBJECT", _one(path, F.concat(F.lit("expected an object, got "), type_name(v)), v, "type")).otherwise(_none())
    return _scalar_errors(v, kind, path, node)


def _at(path: Column, name: str) -> Column:
    return F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit("." + name)))


def _get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$['" + name.replace("'", "\\'") + "']", "variant")


def _field_errors(v: Column, path: Column, name: str, child: Any, optional: bool) -> Column:
    def judged(s: Column) -> Column:
        absent = F.when(s["v"].isNull(), _none() if optional else _one(s["path"], F.lit("missing required field"), None, "missing"))
        absent = absent.when(F.is_variant_null(s["v"]), _none() if optional else _one(s["path"], F.lit("field is null, but it is required"), None, "null"))
        return absent.otherwise(_errors(s["v"], s["kind"], s["path"], child))

    value = _get(v, name)
    return let(F.struct(value.alias("v"), _at(path, name).alias("path")), lambda x: let(F.struct(x["v"].alias("v"), _kind(x["v"]).alias("kind"), x["path"].alias("path")), judged))


def _list_errors(v: Column, kind: Column, path: Column, node: Items) -> Column:
    low, high = node.min_items, node.max_items

    def counted(items: Column) -> Column:
        n, parts = F.size(items), []
        if low is not None:
            words = F.concat(n.cast("string"), F.when(n == 1, " item").otherwise(" items"))
            parts.append(F.when(n < low, _one(path, F.concat(F.lit("returned "), words, F.lit(f", minimum is {low}")), None, "structure")).otherwise(_none()))
        if high is not None:
            parts.append(F.when(n > high, _one(path, F.format_string(f"returned %d items, maximum is {high}", n), None, "structure")).otherwise(_none()))
            items = F.when(n > high, F.slice(items, 1, CHECKED_ITEMS)).otherwise(items)
        parts.append(F.flatten(F.transform(items, lambda x, i: errors(x, node.item, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
        every = F.concat(*parts)
        return F.when(n == 0, _one(path, F.lit(f"list is empty, minimum is {low} {'item' if low == 1 else 'items'}"), None, "structure")).otherwise(every) if low else every

    chain = F.when(kind == "NULL", _one(path, F.lit("expected a list, got null. Your function returned None — make sure it has an explicit return statement."), None, "type"))
    return chain.when(kind != "ARRAY", _one(path, F.concat(F.lit("expected a list, got "), type_name(v)), v, "type")).otherwise(let(items_of(v), counted))


def _broken(node: Field, text: Column, number: Column, whole: Column | bool) -> list[tuple[Column, Column]]:
    """(condition, message) of each constraint of a scalar of the right type, whole telling integers."""
    rules = []
    if node.enum is not None:
        allowed = ", ".join(f'"{x}"' for x in node.enum)
        rules.append((~text.isin(*node.enum), F.concat(F.lit('value "'), cut(text), F.lit(f'" is not one of the allowed values: {allowed}'))))
    if node.min_length is not None:
        rules.append((F.length(text) < node.min_length, F.format_string(f"string has %d characters, minimum is {node.min_length}", F.length(text))))
    if node.max_length is not None:
        rules.append((F.length(text) > node.max_length, F.format_string(f"string has %d characters, maximum is {node.max_length}", F.length(text))))
    if node.pattern is not None:
        rules.append((~has(text, node.pattern), F.concat(F.lit('string "'), cut(text), F.lit(f'" does not match pattern {node.pattern}'))))
    if node.type_ in (int, float) and (node.min is not None or node.max is not None):
        sound = ~F.isnan(number)  # comparisons with NaN hold for neither bound
        low = sound & (number < node.min) if node.min is not None else F.lit(False)
        high = sound & (number > node.max) if node.max is not None else F.lit(False)
        said = number_text(number) if node.type_ is float or whole is False else text if whole is True else F.when(whole, text).otherwise(number_text(number))
        between = node.min is not None and node.max is not None
        rule = f"must be between {node.min} and {node.max}" if between else f"must be >= {node.min}" if node.min is not None else f"must be <= {node.max}"
        rules.append((low | high, F.concat(F.lit("value is "), said, F.lit(", " + rule))))
    return rules


def _scalar_errors(v: Column, kind: Column, path: Column, node: Field) -> Column:
    def checked(s: Column) -> Column:
        kind, text, number, parts = s["kind"], s["text"], s["number"], []
        whole = (kind == "FLOAT") & ~F.isnan(number) & (F.abs(number) < float("inf")) & (number == F.rint(number))
        fits = {str: kind == "STRING", bool: kind == "BOOLEAN", int: (kind == "INT") | whole, float: kind.isin("INT", "FLOAT")}[node.type_]

        for bad, message in _broken(node, text, number, kind == "INT"):
            parts.append(F.when(bad, F.array(F.struct(message.alias("message"), F.lit("constraint").alias("kind")))))
        empty = F.array().cast("array<struct<message:string,kind:string>>")
        wrong = F.array(F.struct(F.concat(F.lit(f"expected {node.type_.__name__}, got "), type_name(s["v"])).alias("message"), F.lit("type").alias("kind")))
        good = F.concat(*[F.coalesce(p, empty) for p in parts]) if parts else empty
        return F.when(~F.coalesce(fits, F.lit(False)), wrong).otherwise(good)

    here = F.struct(v.alias("v"), kind.alias("kind"), F.try_variant_get(v, "$", "string").alias("text"), F.try_variant_get(v, "$", "double").alias("number"))
    made = lambda m: F.struct(path.alias("path"), m["message"].alias("message"), display(v).alias("value"), m["kind"].alias("error_kind"))
    return F.transform(let(here, checked), made)


def root_errors(record: Column, node: Any) -> Column:
    """errors, and one for an empty list at the root unless the contract allows it."""
    found = errors(record, node)
    if isinstance(node, Items) and not node.allow_empty and not node.min_items:
        empty = _one(F.lit(""), F.lit("list is empty — the scraper must return at least one result"), None, "structure")
        found = F.when((_kind(record) == "ARRAY") & (F.size(items_of(record)) == 0), empty).otherwise(found)
    return found


def list_positions(record: Column, node: Any, path: Column | None = None) -> Column:
    """array<struct<path, n>>: every list that the contract knows of in a record, with its number of items."""
    path, none = F.lit("") if path is None else path, F.array().cast("array<struct<path:string,n:int>>")
    if isinstance(node, Items):

        def of(s: Column) -> Column:
            own = F.array(F.struct(s["path"].alias("path"), F.size(s["items"]).alias("n")))
            if not isinstance(node.item, (Items, Record)):
                return own
            inner = F.transform(s["items"], lambda x, i: list_positions(x, node.item, F.concat(s["path"], F.lit("["), i.cast("string"), F.lit("]"))))
            return F.concat(own, F.flatten(inner))

        items = F.coalesce(items_of(record), F.array().cast("array<variant>"))
        return let(F.struct(path.alias("path"), items.alias("items")), of)
    if isinstance(node, Record):
        parts = [list_positions(_get(record, name), child, _at(path, name)) for name, (child, _) in node.fields.items() if isinstance(child, (Items, Record))]
        return F.when(_kind(record) == "OBJECT", F.concat(*parts)).otherwise(none) if parts else none
    return none


def tolerated(found: Column, positions: Column, tolerance: str) -> Column:
    """The errors that remain when those of lists are dropped of whose items enough pass, longest paths first."""
    if tolerance == "strict":
        return found
    threshold = THRESHOLDS[tolerance]
    ordered = F.array_sort(F.transform(positions, lambda p, i: F.struct((-F.length(p["path"])).alias("rank"), i.alias("i"), p["path"].alias("path"), p["n"].alias("n"))))

    def step(errs: Column, p: Column) -> Column:
        pattern = F.when(p["path"] == "", r"^\[(\d+)\]").otherwise(F.concat(F.lit(r"\Q"), p["path"], F.lit(r"\E\[(\d+)\]")))
        index = lambda e: F.call_function("regexp_extract", e["path"], pattern, F.lit(1))
        failed = F.size(F.array_distinct(F.filter(F.transform(errs, index), lambda x: x != "")))
        return F.when((p["n"] > 0) & (failed > 0) & ((p["n"] - failed) / p["n"] >= threshold), F.filter(errs, lambda e: index(e) == "")).otherwise(errs)

    return F.aggregate(ordered, found.cast(ERROR_TYPE), step)


def grouped(rows: DataFrame) -> DataFrame:
    """Groups of errors (ord, path, message, value, error_kind) by path without indices and message: count, first
    position and up to three examples. Examples are thinned within partitions first, so a large group doesn't gather."""
    pattern = F.regexp_replace("path", r"\[\d+\]", "[*]").alias("pattern")
    example = F.struct("ord", "path", "value")
    first = rows.withColumn("salt", F.spark_partition_id()).groupBy(pattern, "message", "error_kind", "salt")
    some = first.agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(example)), 1, EXAMPLES).alias("examples"))
    whole = some.groupBy("pattern", "message", "error_kind").agg(F.sum("n").alias("count"), F.slice(F.array_sort(F.flatten(F.collect_list("examples"))), 1, EXAMPLES).alias("examples"))
    order = F.create_map(*[F.lit(x) for pair in KIND_ORDER.items() for x in pair])
    return whole.withColumn("kind_order", F.coalesce(F.try_element_at(order, F.col("error_kind")), F.lit(9))).withColumn("first_ord", F.col("examples")[0]["ord"])


def report(groups: DataFrame, node: Any = None, total_items: int | None = None) -> str:
    """The report of grouped errors as text: ten groups at most, by kind and number. Empty without errors."""
    n = groups.count()
    if not n:
        return ""
    shown = groups.orderBy("kind_order", F.desc("count"), "first_ord").limit(SHOWN_GROUPS).collect()
    optional = optional_paths(node) if node is not None else set()
    lines = [f"Schema validation failed ({n} {'error' if n == 1 else 'error types'}{f', showing first {SHOWN_GROUPS}' if n > SHOWN_GROUPS else ''}):\n"]
    for i, g in enumerate(shown, 1):
        path = g.examples[0].path if g["count"] == 1 else g.pattern
        if "[*]" in g.pattern:
            where = f" ({g['count']} of {total_items} items)" if total_items is not None else f" ({g['count']} {'item' if g['count'] == 1 else 'items'})"
        else:
            where = "" if g["count"] == 1 else f" ({g['count']} occurrences)"
        lines.append(f"  [{i}] {path} — {g.message}{where}" if path else f"  [{i}] {g.message[:1].upper()}{g.message[1:]}{where}")
        told = [f"{e.path} = {e.value}" for e in g.examples if e.value is not None]
        if told and path:
            lines.append("      Examples: " + (", ".join(told) if len(told) < 3 else ",\n                ".join(told)))
        if g.error_kind == "constraint" and g.pattern in optional:
            bad = list(dict.fromkeys(e.value for e in g.examples if e.value is not None))
            words = " and ".join(bad) if len(bad) < 3 else f"{', '.join(bad[:-1])}, and {bad[-1]}"
            lines.append("      Note: this field is optional — null is valid, but " + (f"{words} {'is' if len(bad) == 1 else 'are'} not." if bad else "the above values are not."))
    if n > SHOWN_GROUPS:
        lines.append(f"\n  ... and {n - SHOWN_GROUPS} more error types not shown.")
    return "\n".join(lines)


def optional_paths(node: Any, prefix: str = "") -> set[str]:
    """Paths of optional fields, with [*] for list indices."""
    if isinstance(node, Record):
        own = {n: f"{prefix}.{n}" if prefix else n for n in node.fields}
        return {own[n] for n, (_, optional) in node.fields.items() if optional}.union(*(optional_paths(child, own[n]) for n, (child, _) in node.fields.items()))
    return optional_paths(node.item, f"{prefix}[*]") if isinstance(node, Items) else set()


def validate_records(df: DataFrame, record: str, contract: Any, tolerance: str = "strict") -> DataFrame:
    """df with ``errors`` and ``passed``, for a column of JSON text or of VARIANT."""
    node = parse(contract)
    value = F.col(record) if dict(df.dtypes)[record] == "variant" else F.try_parse_json(record)
    found = tolerated(root_errors(value, node), list_positions(value, node), tolerance)
    return df.withColumn("errors", found).withColumn("passed", F.size("errors") == 0)


#: Kinds of the values of typed columns; columns of other types are checked as VARIANT.
COLUMN_KINDS = {"string": "STRING", "boolean": "BOOLEAN", "tinyint": "INT", "smallint": "INT", "int": "INT", "bigint": "INT", "float": "FLOAT", "double": "FLOAT"}
KIND_NAMES = {"STRING": "string", "BOOLEAN": "boolean", "INT": "integer", "FLOAT": "float"}


def _column_errors(c: Column, kind: str, path: Column, node: Field, optional: bool) -> list[tuple[Column, Column]]:
    """(condition, error) of a typed column, in order: what _field_errors says of the same value as VARIANT."""
    text, number, found = c.cast("string"), c.cast("double"), []
    shown = {"STRING": F.concat(F.lit('"'), cut(text), F.lit('"')), "BOOLEAN": F.when(c.cast("boolean"), "True").otherwise("False") if kind == "BOOLEAN" else text, "FLOAT": number_text(number) if kind == "FLOAT" else text, "INT": text}[kind]

    def add(bad: Column, message: Column, value: Column, error_kind: str) -> None:
        found.append((F.coalesce(bad, F.lit(False)), F.struct(path.alias("path"), message.alias("message"), value.alias("value"), F.lit(error_kind).alias("error_kind"))))

    if not optional:
        add(c.isNull(), F.lit("field is null, but it is required"), F.lit(None).cast("string"), "null")
    whole = ~F.isnan(number) & (F.abs(number) < float("inf")) & (number == F.rint(number)) if kind == "FLOAT" else F.lit(True)
    fits = {str: kind == "STRING", bool: kind == "BOOLEAN", int: kind in ("INT", "FLOAT"), float: kind in ("INT", "FLOAT")}[node.type_]
    good = F.lit(fits) & (whole if node.type_ is int else F.lit(True))
    if not fits or (node.type_ is int and kind == "FLOAT"):
        add(c.isNotNull() & ~good, F.lit(f"expected {node.type_.__name__}, got {KIND_NAMES[kind]}"), shown, "type")
    if fits:
        for bad, message in _broken(node, text, number, kind == "INT"):
            add(c.isNotNull() & good & bad, message, shown, "constraint")
    return found


def validate_table(df: DataFrame, contract: Any, ordinal: str) -> DataFrame:
    """Error rows (ord, path, message, value, error_kind) of a table as a list of objects, numbered by a unique column.

    Rows are checked where they are; an error's path begins with the row's number in brackets. Fields of plain types are
    checked by predicates on their columns, which reach the scan if there are no others; only rows that break one get
    messages. Fields of nested and other types are checked as VARIANT."""
    node = parse(contract)
    if isinstance(node, Items):
        node = node.item
    path, kinds = F.concat(F.lit("["), F.col(ordinal).cast("string"), F.lit("]")), {n: COLUMN_KINDS.get(t) for n, t in df.dtypes}
    parts, broken, plain = [], [], True
    for name, (child, optional) in node.fields.items():
        here = F.concat(path, F.lit("." + name))
        if name not in kinds:
            rules = [] if optional else [(F.lit(True), F.struct(here.alias("path"), F.lit("missing required field").alias("message"), F.lit(None).cast("string").alias("value"), F.lit("missing").alias("error_kind")))]
        elif isinstance(child, Field) and kinds[name]:
            rules = _column_errors(F.col(name), kinds[name], here, child, optional)
        else:
            record = F.to_variant_object(F.struct(F.col(name)))
            parts.append(_field_errors(record, path, name, child, optional))
            plain = False
            continue
        if rules:
            parts.append(F.array_compact(F.array(*[F.when(bad, error) for bad, error in rules])).cast(ERROR_TYPE))
            broken += [bad for bad, _ in rules]
    if plain:
        df = df.where(functools.reduce(lambda a, b: a | b, broken, F.lit(False)))
    found = df.select(F.col(ordinal).alias("ord"), F.explode(F.concat(*parts) if parts else _none()).alias("e"))
    return found.select("ord", "e.*")


def pass_rate(df: DataFrame, found: DataFrame, ordinal: str) -> DataFrame:
    """(n_items, n_failed, pass_rate) of a table and its error rows: two aggregates, one row."""
    zero = F.lit(0).cast("long")
    failed = found.agg(F.countDistinct("ord").alias("n_failed")).select(zero.alias("n_items"), "n_failed")
    both = df.agg(F.count(ordinal).alias("n_items")).select("n_items", zero.alias("n_failed")).union(failed)
    sums = both.agg(F.sum("n_items").alias("n_items"), F.sum("n_failed").alias("n_failed"))
    return sums.withColumn("pass_rate", F.when(F.col("n_items") > 0, (F.col("n_items") - F.col("n_failed")) / F.col("n_items")))


# ---- the contract in words -------------------------------------------------------------------------------------------


def flatten(contract: Any) -> list[str]:
    """Dotted paths of a contract's fields, [] for lists."""

    def walk(node: Any, prefix: str) -> list[str]:
        if isinstance(node, Record):
            return list(itertools.chain.from_iterable(walk(child, f"{prefix}.{n}" if prefix else n) for n, (child, _) in node.fields.items()))
        if isinstance(node, Items):
            return walk(node.item, f"{prefix}[]")
        return [prefix] if prefix else []

    return walk(parse(contract), "")


def describe(contract: Any) -> str:
    """The contract as text: its structure, then one line for every requirement."""
    node, rules = parse(contract), []

    def rule(path: str, words: list[str]) -> None:
        if words:
            rules.append(f"- {path or 'result'}: {', '.join(words)}")

    def shape(n: Any, path: str, indent: int) -> str:
        pad = "  " * indent
        if isinstance(n, Record):
            inner = "".join(f'{pad}  "{k}": {shape(c, f"{path}.{k}" if path else k, indent + 1)},\n' for k, (c, _) in n.fields.items())
            return "{\n" + inner + pad + "}"
        if isinstance(n, Items):
            low, high = n.min_items, n.max_items
            rule(path, [w for w in (low is not None and f"at least {low} items", high is not None and f"at most {high} items", n.allow_empty and "may be empty") if w])
            return f"[{shape(n.item, path + '[]', indent)}, ...]"
        if isinstance(n, AnyObject):
            return "{...}"
        checks: list[tuple[Any, Callable[[Any], str]]] = [
            (n.min, lambda v: f"at least {v}"), (n.max, lambda v: f"at most {v}"), (n.min_length, lambda v: f"{v} characters or more"), (n.max_length, lambda v: f"{v} characters at most"),
            (n.pattern, lambda v: f"matches {v}"), (n.enum, lambda v: "one of " + ", ".join(map(repr, v))), (n.optional or None, lambda v: "may be null"),
        ]
        rule(path, [say(v) for v, say in checks if v is not None])
        return n.type_.__name__

    text = shape(node, "", 0)
    return text + ("\n\nRequirements:\n" + "\n".join(rules) if rules else "")


__all__ = ["AnyObject", "ContractError", "Field", "Items", "Record", "describe", "display", "errors", "flatten", "grouped", "list_positions", "parse", "pass_rate", "report", "root_errors", "tolerated", "validate_records", "validate_table"]
