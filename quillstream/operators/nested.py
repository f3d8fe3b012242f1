"""Deeply nested records as related flat tables (problem 2).

``infer`` reads every payload once and merges the shapes of all records: which fields are lists, objects, scalars or, in
different rows, several of these. ``typed`` brings each record to the merged schema, ``flatten`` walks that schema and
makes one table for each array level, and ``flat_rows`` lists the elements of all levels in one pass. Every row carries a surrogate
key, that of its parent and the ordinals of all arrays above it, so children lead to their parents without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a blank value besides the space.
_WHITE = r"^[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*$"

#: The arrays of a bibliographic record, and the field by which an element is named: a bare text stands for it.
ROOTS = ("authors", "publication_types", "keywords")
NAMES = {"authors": "author", "authors.affiliation": "name"}
#: Arrays whose elements may be lists, or objects with a list in this field, that count on as one.
HOLDERS = {"keywords": "terms"}


def blank(x: Column) -> Column:
    """True for null, empty or white space only."""
    return x.isNull() | x.rlike(_WHITE)


def _shape(v) -> dict:
    """The shape of a JSON value: ``s`` for a scalar, ``f`` with the shapes of fields, ``i`` with that of the items of a list; null has none."""
    if isinstance(v, dict):
        return {"f": {k: _shape(x) for k, x in v.items()}}
    if isinstance(v, list):
        out: dict = {}
        for x in v:
            out = merge(out, _shape(x))
        return {"i": out}
    return {} if v is None else {"s": 1}


def merge(a: dict, b: dict) -> dict:
    """The shape of values that have one of two shapes."""
    out = dict(a)
    if "s" in b:
        out["s"] = 1
    if "i" in b:
        out["i"] = merge(a.get("i", {}), b["i"])
    if "f" in b:
        own = a.get("f", {})
        out["f"] = {k: merge(own.get(k, {}), b["f"].get(k, {})) for k in [*own, *(k for k in b["f"] if k not in own)]}
    return out


def _record(v, known: tuple[str, ...]):
    """The record in a parsed payload, found as in ``record_variant``."""
    if not isinstance(v, dict):
        return None
    has = lambda x: isinstance(x, dict) and any(x.get(k) is not None for k in known)
    if has(v):
        return v
    if isinstance(v.get("record"), dict):
        return v["record"]
    return next((x for x in v.values() if has(x)), None)


def infer(df: DataFrame, column: str, known: tuple[str, ...] | None = None) -> dict:
    """The merged shape of the records in all JSON payloads of ``column``.

    Each task merges the shapes of its rows, so that one shape for each task comes to the driver, whose size is that of the
    schema. Keys that are data (a pmid above the record) don't become fields. Payloads that aren't JSON have no shape.
    """
    fields = known or KNOWN

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape: dict = {}
        for b in batches:
            for text in b[column]:
                try:
                    shape = merge(shape, _shape(_record(json.loads(text), fields))) if text else shape
                except ValueError:
                    continue
        yield pd.DataFrame({"shape": [json.dumps(shape)]})

    out: dict = {}
    for r in df.select(column).mapInPandas(read, "shape string").toLocalIterator():
        out = merge(out, json.loads(r["shape"]))
    return out


def shape_of(kind: T.DataType) -> dict:
    """The shape of a Spark type."""
    if isinstance(kind, T.StructType):
        return {"f": {f.name: shape_of(f.dataType) for f in kind.fields}}
    if isinstance(kind, T.ArrayType):
        return {"i": shape_of(kind.elementType)}
    return {"s": 1}


def schema_of(shape: dict, item: bool = False) -> T.DataType:
    """The Spark type of a shape: what is a list anywhere is an array, of which a single element is a list of one.

    Elements (``item``) of several kinds are structs of the fields of the objects, ``value`` for scalars and ``items`` for lists. Scalars are strings.
    """
    kinds = [k for k in "sfi" if k in shape]
    if "i" in shape and not item:
        return T.ArrayType(schema_of(_element(shape), True))
    if kinds in ([], ["s"]):
        return T.StringType()
    if kinds == ["i"]:
        return T.ArrayType(schema_of(shape["i"], True))
    parts = [T.StructField(k, schema_of(x)) for k, x in shape.get("f", {}).items()]
    parts += [T.StructField("value", T.StringType())] * ("s" in shape) + [T.StructField("items", T.ArrayType(schema_of(shape.get("i", {}), True)))] * ("i" in shape)
    return T.StructType(parts)


def _element(shape: dict) -> dict:
    """The shape of the elements of a list or of the single element that stands for one."""
    return merge(shape["i"], {k: v for k, v in shape.items() if k != "i"})


def merged_schema(df: DataFrame, column: str) -> T.DataType:
    """The Spark type of all records in the JSON payloads of ``column``, merged over every row."""
    return schema_of(infer(df, column))


def typed(v: Column, shape: dict, item: bool = False) -> Column:
    """The variant ``v`` as ``schema_of(shape, item)``; what has another kind than its shape says is null."""
    kinds = [k for k in "sfi" if k in shape]
    if "i" in shape and not item:
        return F.transform(_items(v), lambda x: typed(x, _element(shape), True))
    if kinds in ([], ["s"]):
        return _text(v)
    if kinds == ["i"]:
        return F.when(_kind(v) == "ARRAY", F.transform(_items(v), lambda x: typed(x, shape["i"], True)))
    parts = [typed(_get(v, k), x).alias(k) for k, x in shape.get("f", {}).items()]
    if "s" in shape:
        parts.append(_text(v).alias("value"))
    if "i" in shape:
        parts.append(F.when(_kind(v) == "ARRAY", F.transform(_items(v), lambda x: typed(x, shape["i"], True))).alias("items"))
    return F.when(_kind(v) != "VOID", F.struct(*parts))


def as_type(c: Column, kind: T.DataType, to: T.DataType) -> Column:
    """A column of one Spark type as another that was merged from it: fields by name, a scalar as the ``value`` of a struct, missing fields null."""
    if kind == to:
        return c
    if isinstance(to, T.ArrayType):
        return F.transform(c, lambda x: as_type(x, kind.elementType, to.elementType))
    if not isinstance(to, T.StructType):
        return c.cast(to)
    own = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {"value": kind}
    get = (lambda n: c[n]) if isinstance(kind, T.StructType) else (lambda n: c)
    made = F.struct(*[(as_type(get(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields])
    return F.when(c.isNotNull(), made)


def flatten(df: DataFrame, key: str, schema: T.StructType | None = None) -> dict[str, DataFrame]:
    """One table for each array level of ``df``, named by its path (``authors``, ``authors.affiliation``).

    Columns: ``key``; ``<array>_pos`` from 1 for each array level from the outermost to its own; ``row_id`` and
    ``parent_id``, surrogate keys of the row and of the row above it (for the outermost level the key of the record); then the
    scalar fields of the elements, or ``value`` for scalar elements. The ordinal is the place in the array
    before anything is filtered. Null and empty arrays have no rows; null elements are rows of nulls. Repeated
    records give repeated rows; other columns of ``df`` are not read, so clashing names do no harm.
    """
    schema = schema or df.schema
    out: dict[str, DataFrame] = {}
    root = df.select(F.col(key), *[F.col(f"`{f.name}`") for f in schema.fields if f.name != key])
    kind = df.schema[key].dataType
    whole = F.concat_ws("/", *[F.col(f"`{key}`.`{f.name}`") for f in kind.fields]) if isinstance(kind, T.StructType) else F.col(f"`{key}`").cast("string")

    def walk(level: DataFrame, carried: list[str], fields: list[T.StructField], prefix: list[str], of) -> None:
        for f in fields:
            kind, path = f.dataType, [*prefix, f.name]
            if isinstance(kind, T.StructType):
                walk(level, carried, kind.fields, path, lambda name, of=of, f=f: of(f.name).getField(name))
            if not isinstance(kind, T.ArrayType):
                continue
            pos = "_".join(path) + "_pos"
            child = level.select(*carried, F.posexplode(of(f.name)).alias(pos, "_e")).withColumn(pos, F.col(pos) + 1)
            name, keep = ".".join(path), [*carried, pos]
            step = lambda cols: F.concat_ws("/", whole, *[F.concat(F.lit(c[:-4] + ":"), F.col(f"`{c}`")) for c in cols])
            ids = [step(keep[1:]).alias("row_id"), (step(carried[1:]) if len(carried) > 1 else whole).alias("parent_id")]
            if isinstance(kind.elementType, T.StructType):
                own = [g for g in kind.elementType.fields if not isinstance(g.dataType, (T.ArrayType, T.StructType))]
                out[name] = child.select(*keep, *ids, *[F.col("_e").getField(g.name).alias(g.name) for g in own])
                walk(child, keep, kind.elementType.fields, path, lambda n: F.col("_e").getField(n))
            elif isinstance(kind.elementType, T.ArrayType):
                walk(child, keep, [T.StructField("_e", kind.elementType)], path, lambda n: F.col(n))
            else:
                out[name] = child.select(*keep, *ids, F.col("_e").alias("value"))

    walk(root, [key], [f for f in schema.fields if f.name != key], [], lambda n: F.col(f"`{n}`"))
    return out


def flat_rows(record: Column, schema: T.StructType, names: dict[str, str]) -> Column:
    """The elements of all array levels of a record in one array: path, at (ordinals from 1, the outermost first) and value.

    The same walk as ``flatten``, for one pass over each record: each array level adds its ordinal and goes down into its
    elements. The value of an object is the field ``names`` has for its path, else its first scalar.
    """

    def walk(fields: list[T.StructField], get, at: list[Column], prefix: str) -> list[Column]:
        out = []
        for f in fields:
            path = f"{prefix}{f.name}"
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType.fields, lambda n, f=f: get(f.name)[n], at, f"{path}.")
            elif isinstance(f.dataType, T.ArrayType):
                out.append(level(get(f.name), f.dataType.elementType, at, path))
        return out

    def level(array: Column, kind: T.DataType, at: list[Column], path: str) -> Column:
        row = lambda places, v: F.struct(F.lit(path).alias("path"), F.array(*places).alias("at"), v.cast("string").alias("value"))
        if isinstance(kind, T.ArrayType):
            return F.flatten(F.transform(array, lambda x, i: level(x, kind.elementType, [*at, i + 1], f"{path}._e")))
        if not isinstance(kind, T.StructType):
            rows = F.transform(array, lambda x, i: row([*at, i + 1], x))
        else:
            scalars = [g.name for g in kind.fields if not isinstance(g.dataType, (T.ArrayType, T.StructType))]
            named = names.get(path, scalars[0] if scalars else None)
            value = lambda x: x[named] if named in scalars else F.lit(None)
            deeper = lambda x, i: walk(kind.fields, lambda n: x[n], [*at, i + 1], f"{path}.")
            rows = F.flatten(F.transform(array, lambda x, i: F.concat(F.array(row([*at, i + 1], value(x))), *deeper(x, i))))
        return F.coalesce(rows, F.array().cast("array<struct<path:string,at:array<int>,value:string>>"))

    parts = walk(schema.fields, lambda n: record[n], [], "")
    return F.concat(*parts) if parts else F.array().cast("array<struct<path:string,at:array<int>,value:string>>")


def _kind(v: Column) -> Column:
    """ARRAY, OBJECT, STRING ... or VOID of a variant."""
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "^[A-Z]+", 0)


def _items(v: Column) -> Column:
    """Array of variants: a list as it is, a single element as a list of one, missing as an empty list."""
    one = F.when(_kind(v) == "VOID", F.array().cast("array<variant>")).otherwise(F.array(v))
    return F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(one)


def _text(v: Column) -> Column:
    """The text of a string variant; null for any other kind."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _get(v: Column, field: str) -> Column:
    return F.when(_kind(v) == "OBJECT", F.try_variant_get(v, f"$.{field}", "variant"))


#: Fields by which a JSON object is known to be a record.
KNOWN = ("authors", "publication_types", "keywords", "title", "pmid", "journal", "year")


def record_variant(payload: Column, known: tuple[str, ...] = KNOWN) -> Column:
    """The record in a JSON payload as a variant; null if the payload isn't valid JSON or holds no record.

    The record is the payload itself if it has one of the fields ``known``, otherwise the value under
    ``record``, otherwise the first value that is an object with such a field (the record under its pmid).
    """
    has = lambda v: F.greatest(*[_get(v, f).isNotNull() for f in known])

    def pick(top: Column) -> Column:
        values = F.map_values(F.when(_kind(top) == "OBJECT", F.try_variant_get(top, "$", "map<string,variant>")))
        inner = F.filter(F.coalesce(values, F.array().cast("array<variant>")), has)
        return F.when(has(top), top).when(_kind(_get(top, "record")) == "OBJECT", _get(top, "record")).otherwise(F.try_element_at(inner, F.lit(1)))

    return _once(whole_json(payload), pick)


def whole_json(text: Column) -> Column:
    """The variant of a JSON text; null if the text is no JSON, is a list, or goes on behind its value, which the parser itself would not notice."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return _once(listed, lambda a: F.when((F.size(a) == 1) & F.rtrim(text).rlike(r"[^\]\s]\s*$"), a[0]))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once for a row, wherever the optimiser puts it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _plain(kind: T.DataType, path: str) -> T.DataType:
    """The type that ``tidy`` gives to a field: elements with a name instead of bare texts, lists of lists as one list."""
    if not isinstance(kind, T.ArrayType):
        return kind
    e = kind.elementType
    if path in HOLDERS:
        return T.ArrayType(T.StringType())
    if path in NAMES:
        inner = [f for f in (e.fields if isinstance(e, T.StructType) else []) if f.name not in ("value", NAMES[path])]
        return T.ArrayType(T.StructType([T.StructField(NAMES[path], T.StringType()), *[T.StructField(f.name, _plain(f.dataType, f"{path}.{f.name}")) for f in inner]]))
    return kind


def tidy(c: Column, kind: T.DataType, path: str) -> Column:
    """A field of a record without blank values and nameless elements, with all below them, before ordinals are given.

    In the arrays of ``NAMES`` a bare text is the name of an element; in those of ``HOLDERS`` lists, and objects with a list, count on as one.
    Arrays are never null. Other fields below are kept.
    """
    if not isinstance(kind, T.ArrayType):
        return c
    e = kind.elementType
    struct = isinstance(e, T.StructType)
    have = {f.name: f.dataType for f in e.fields} if struct else {}
    none = F.array().cast(_plain(kind, path))
    filled = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: ~blank(x))
    if path in HOLDERS:
        inside = [n for n in ("items", HOLDERS[path]) if isinstance(have.get(n), T.ArrayType)]
        texts = lambda a, t: F.transform(a, lambda y: y["value"] if isinstance(t.elementType, T.StructType) else y.cast("string"))
        if struct:
            one = lambda x: F.concat(F.array(x["value"] if "value" in have else F.lit(None).cast("string")), *[F.coalesce(texts(x[n], have[n]), F.array().cast("array<string>")) for n in inside])
            return filled(F.flatten(F.transform(F.filter(c, lambda x: x.isNotNull()), one)))
        return filled(F.flatten(c) if isinstance(e, T.ArrayType) else c)
    if path in NAMES:
        name = lambda x: F.coalesce(*[x[n] for n in (NAMES[path], "value") if n in have]) if struct else x
        inner = [f for f in (e.fields if struct else []) if f.name not in ("value", NAMES[path])]
        made = lambda x: F.struct(name(x).alias(NAMES[path]), *[tidy(x[f.name], f.dataType, f"{path}.{f.name}").alias(f.name) for f in inner])
        return F.coalesce(F.transform(F.filter(c, lambda x: x.isNotNull() & ~blank(name(x))), made), none)
    if isinstance(e, T.StringType):
        return filled(c)
    return F.coalesce(c, none)


def records(refs: DataFrame, raw: DataFrame, roots: tuple[str, ...] = ROOTS) -> tuple[DataFrame, T.StructType]:
    """(key: origin and rec_id; r: the tidy record, its type) of refs and of the payloads of raw_records.

    The type is merged from the columns of refs and from every payload, so that fields nobody knew of have their place.
    """
    own = T.StructType([f for f in refs.schema.fields if f.name in roots])
    shape = merge(shape_of(own), infer(raw, "payload"))
    shape = {"f": {k: v for k, v in shape["f"].items() if k in roots}}
    whole = schema_of(shape)
    made = lambda get: F.struct(*[tidy(get(f.name), f.dataType, f.name).alias(f.name) for f in whole.fields])
    key = lambda origin, id_: F.struct(F.lit(origin).alias("origin"), F.col(id_).alias("rec_id")).alias("key")
    have = {f.name: f.dataType for f in own.fields}
    native = lambda n: as_type(F.col(n), have[n], whole[n].dataType) if n in have else F.lit(None).cast(whole[n].dataType)
    a = refs.select(key("refs", "ref_id"), made(native).alias("r"))
    b = raw.select(key("raw_records", "rec_id"), _once(record_variant(F.col("payload")), lambda v: made(lambda n: typed(_get(v, n), shape["f"][n]))).alias("r"))
    return a.unionByName(b), T.StructType([T.StructField(f.name, _plain(f.dataType, f.name)) for f in whole.fields])


def child_tables(refs: DataFrame, raw: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of every array level of the records of refs and of raw_records: authors, affiliations, publication types, keywords and what else is below them.

    Each table has ``origin``, ``rec_id``, the ordinals, the surrogate keys and the values. Ordinals count only what is kept.
    Payloads that are null or not valid JSON have no children.
    """
    both, kind = records(refs, raw)
    flat = both.select("key", *[F.col(f"r.{f.name}").alias(f.name) for f in kind.fields])
    return {name: t.select("key.*", *[c for c in t.columns if c != "key"]) for name, t in flatten(flat, "key").items()}


#: What the array levels are called as kinds of children.
KINDS = {"authors": "author", "authors.affiliation": "affiliation", "publication_types": "publication_type", "keywords": "keyword"}


def children(refs: DataFrame, raw: DataFrame) -> DataFrame:
    """``child_tables`` of the ``KINDS`` under one header: origin, rec_id, kind, parent_pos, pos, value.

    All levels come from one pass over each record, so that payloads are parsed once and nothing is shuffled.
    """
    both, kind = records(refs, raw)
    rows = both.select("key.*", F.inline(_once(F.col("r"), lambda r: flat_rows(r, kind, NAMES))))
    named = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    kept = rows.where(F.col("path").isin(*KINDS))
    parent = F.when(F.size("at") > 1, F.element_at("at", -2)).otherwise(0)
    return kept.select("origin", "rec_id", named[F.col("path")].alias("kind"), parent.alias("parent_pos"), F.element_at("at", -1).alias("pos"), "value")
