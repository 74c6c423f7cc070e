r"""Line protocol to rows and back.

``measurement,tag=value field=1.5,other=8i,text="x" 1609459200000000000``. Blank lines and lines
starting with # are skipped. Bad lines are kept with an error, good ones go on.

A line is read once, from left to right, in Arrow batches. Escapes are ``\n \r \t \\ \" \, \= \ ``
and are honoured everywhere, in measurement and tags too; a backslash before anything else stays.
A line without timestamp takes ``now``. A tag or field named twice is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConflictingTypes
from ..model import Measurement
from ..scratch import importable

# Spellings of booleans, and escapes.
_TRUE, _FALSE = ("t", "T", "true", "True", "TRUE"), ("f", "F", "false", "False", "FALSE")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"', ",": ",", "=": "=", " ": " "}

_KINDS = {"float": ("f", "double"), "integer": ("i", "bigint"), "unsigned": ("u", "decimal(20,0)"), "string": ("s", "string"), "boolean": ("b", "boolean")}
_ESCAPE = re.compile(r"\\(.)", re.S)
_NAME = re.compile(r"(?:\\.|[^\\, ])+", re.S)
_TAG = re.compile(r",((?:\\.|[^\\,= ])+)=((?:\\.|[^\\, ])+)", re.S)
_FIELD = re.compile(r'((?:\\.|[^\\=," ])+)=(?:"((?:\\.|[^"\\])*)"|([^", ]+))', re.S)
_NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_WHOLE = re.compile(r"[+-]?[0-9]+")


class BadLine(ValueError):
    """What is wrong with a line."""


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPES.get(m[1], m[0]), text) if "\\" in text else text


def _value(text: str) -> tuple:
    """(kind, f, i, u, s, b) of an unquoted value."""
    if text in _TRUE or text in _FALSE:
        return ("boolean", None, None, None, None, text in _TRUE)
    if text[-1] == "i" and _WHOLE.fullmatch(text, 0, len(text) - 1) and -(2**63) <= int(text[:-1]) < 2**63:
        return ("integer", None, int(text[:-1]), None, None, None)
    if text[-1] == "u" and text[:-1].isascii() and text[:-1].isdigit() and int(text[:-1]) < 2**64:
        return ("unsigned", None, None, Decimal(text[:-1]), None, None)
    if _NUMBER.fullmatch(text):
        return ("float", float(text), None, None, None, None)
    raise BadLine("invalid value")


def parse_line(line: str) -> tuple[str, dict[str, str], dict[str, tuple], int | None]:
    """(measurement, tags, fields, time in nanoseconds or None); raises BadLine."""
    name = _NAME.match(line)
    if not name:
        raise BadLine("empty measurement")
    at, tags = name.end(), {}
    while at < len(line) and line[at] == ",":
        tag = _TAG.match(line, at)
        if not tag:
            raise BadLine("invalid tag")
        key, at = _unescape(tag[1]), tag.end()
        if key in tags:
            raise BadLine("repeated tag")
        tags[key] = _unescape(tag[2])
    if at < len(line) and line[at] != " ":
        raise BadLine("invalid escape")
    while at < len(line) and line[at] == " ":
        at += 1
    if at == len(line):
        raise BadLine("no fields")
    fields: dict[str, tuple] = {}
    while True:
        field = _FIELD.match(line, at)
        if not field:
            raise BadLine("invalid field")
        key, at = _unescape(field[1]), field.end()
        if key in fields:
            raise BadLine("repeated field")
        fields[key] = ("string", None, None, None, _unescape(field[2]), None) if field[3] is None else _value(field[3])
        if at == len(line) or line[at] == " ":
            break
        if line[at] != ",":
            raise BadLine("invalid field")
        at += 1
    rest = line[at:].split(" ", 1) if at == len(line) else line[at:].strip(" ").split(" ", 1)
    if rest == [""]:
        return _unescape(name[0]), tags, fields, None
    if not _WHOLE.fullmatch(rest[0]) or not -(2**63) <= int(rest[0]) < 2**63:
        raise BadLine("invalid timestamp")
    if len(rest) > 1:
        raise BadLine("more than three parts")
    return _unescape(name[0]), tags, fields, int(rest[0])


_VALUE = pa.struct([("kind", pa.string()), ("f", pa.float64()), ("i", pa.int64()), ("u", pa.decimal128(20, 0)), ("s", pa.string()), ("b", pa.bool_())])
_PARSED = "line string, measurement string, time_ns bigint, tags map<string,string>, fields map<string,struct<kind:string,f:double,i:bigint,u:decimal(20,0),s:string,b:boolean>>, error string"


def _map(rows: list[dict | None], items) -> pa.MapArray:
    """Maps of the rows; ``items`` makes the Arrow array of all their values."""
    ends, keys, values = [0], [], []
    for row in rows:
        if row:
            keys.extend(row)
            values.extend(row.values())
        ends.append(len(keys))
    offsets = pa.array([None if i < len(rows) and rows[i] is None else e for i, e in enumerate(ends)], pa.int32())
    return pa.MapArray.from_arrays(offsets, pa.array(keys, pa.string()), items(values))


def _values(found: list[tuple]) -> pa.StructArray:
    columns = list(zip(*found, strict=True)) or [()] * _VALUE.num_fields
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _VALUE, strict=True)], fields=list(_VALUE))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, names, times, tags, fields, errors = [], [], [], [], [], []
        for line in batch.column(0).to_pylist():
            try:
                found, error = parse_line(line), None
            except BadLine as e:
                found, error = (None, None, None, None), str(e)
            lines.append(line)
            errors.append(error)
            for column, x in zip((names, tags, fields, times), found, strict=True):
                column.append(x)
        strings = lambda x: pa.array(x, pa.string())
        yield pa.RecordBatch.from_arrays(
            [strings(lines), strings(names), pa.array(times, pa.int64()), _map(tags, strings), _map(fields, _values), strings(errors)], ["line", "measurement", "time_ns", "tags", "fields", "error"]
        )


def escape(c: Column, also: str = ",= ") -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), *[(x, "\\" + x) for x in also]):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """``line, measurement, time_ns, tags, fields, error``: one row per line that says something."""
    raw = lines.select(F.trim(F.col(column)).alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    importable(lines.sparkSession)
    rows = raw.mapInArrow(_parse, _PARSED)
    now = F.when(F.col("error").isNull(), F.unix_micros(F.current_timestamp()) * 1000)
    return rows.withColumn("time_ns", F.coalesce("time_ns", now))


def keys_of(parsed: DataFrame) -> dict[str, tuple[tuple[str, ...], dict[str, str]]]:
    """Tags and fields with their types by measurement, from one aggregation; its size is that of the schemas.

    A field that comes with two types raises ConflictingTypes.
    """
    good = parsed.filter(F.col("error").isNull())
    none = F.lit(None).cast("string")
    each = F.concat(
        F.transform(F.map_keys("tags"), lambda k: F.struct(k.alias("key"), none.alias("kind"))),
        F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("key"), e["value"]["kind"].alias("kind"))),
    )
    found = good.select("measurement", F.explode(each).alias("e")).select("measurement", "e.key", "e.kind").distinct().collect()
    out: dict[str, tuple[set[str], dict[str, str]]] = {}
    for r in found:
        tags, fields = out.setdefault(r["measurement"], (set(), {}))
        if r["kind"] is None:
            tags.add(r["key"])
        elif fields.setdefault(r["key"], r["kind"]) != r["kind"]:
            raise ConflictingTypes(f"field {r['key']!r} of {r['measurement']!r} is both {fields[r['key']]} and {r['kind']}")
    return {name: (tuple(sorted(tags)), dict(sorted(fields.items()))) for name, (tags, fields) in out.items()}


def measurement(parsed: DataFrame, name: str, keys: tuple[tuple[str, ...], dict[str, str]] | None = None) -> tuple[Measurement, DataFrame]:
    """Rows of one measurement with a column per tag and field; ``keys`` as ``keys_of`` found them."""
    rows = parsed.filter(F.col("error").isNull() & (F.col("measurement") == name))
    tags, fields = keys if keys is not None else keys_of(rows).get(name, ((), {}))
    time = F.timestamp_micros(F.expr("time_ns DIV 1000") - F.when(F.pmod("time_ns", F.lit(1000)) != 0, F.when(F.col("time_ns") < 0, 1).otherwise(0)).otherwise(0))
    columns = [time.cast("timestamp_ntz").alias("time"), F.col("time_ns")]
    columns += [F.col("tags")[t].alias(t) for t in tags]
    columns += [F.col("fields")[f][_KINDS[k][0]].alias(f) for f, k in fields.items()]
    return Measurement(name, "time", tags, tuple(fields), ("time_ns",)), rows.select(*columns)


def export(df: DataFrame, m: Measurement) -> DataFrame:
    """``value``: each row as a line. Rows without any field have none and are left out."""
    types = dict(df.dtypes)

    def field_text(f: str) -> Column:
        c, kind = F.col(f), types[f]
        if kind in ("double", "float"):
            text = F.when(~F.isnan(c), c.cast("string"))
        elif kind in ("bigint", "int", "smallint", "tinyint"):
            text = F.concat(c.cast("string"), F.lit("i"))
        elif kind.startswith("decimal"):
            text = F.concat(c.cast("string"), F.lit("u"))
        elif kind == "boolean":
            text = c.cast("string")
        else:
            text = F.concat(F.lit('"'), escape(c.cast("string"), '"'), F.lit('"'))
        return F.concat(F.lit(_escaped(f) + "="), text)

    tags = [F.concat(F.lit("," + _escaped(t) + "="), escape(F.col(t))) for t in sorted(m.tags)]
    head = F.concat(F.lit(_escaped(m.name)), *[F.when(F.col(t).isNotNull() & (F.col(t) != ""), x).otherwise("") for t, x in zip(sorted(m.tags), tags, strict=True)])
    body = F.concat_ws(",", *[field_text(f) for f in m.fields])
    ns = F.col("time_ns") if "time_ns" in df.columns else F.unix_micros(F.col("time").cast("timestamp")) * 1000
    return df.select(head.alias("head"), body.alias("body"), ns.alias("ns")).filter("body <> ''").select(F.concat_ws(" ", "head", "body", F.col("ns").cast("string")).alias("value"))


def _escaped(text: str) -> str:
    return "".join("\\" + c if c in ",= \\" else c for c in text)
