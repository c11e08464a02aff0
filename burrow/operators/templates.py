"""Analysis templates: counters, calculations and columns declared as data, compiled into one aggregation.

A template is a mapping (a ``template.json``): id, name, parameters, counters (a substring each), calculations (expressions over counters,
parameters, what a file's name says and earlier calculations), columns with labels and formats, and the name of a hook. All templates
that run over the same lines share one scan and one aggregation; equal counters are counted once.

Defined results: a division by zero makes a calculation 0; an unknown name, a text where a number is needed or a root or logarithm that
doesn't exist makes it null; a file without lines has no row; counters without a match count nothing.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a log file's name says: subject, box, date and time.
FILE_NAME = r"^(.+?)-Box(\d+)-(\d{4}-\d{2}-\d{2})-(\d{6})\.tsv$"
NAME_FIELDS = ("subject_id", "box_id", "session_date", "session_time")
_TYPES = {"INT": int, "FLOAT": float, "STRING": str, "BOOL": bool, "CHOICE": str}


@dataclass(frozen=True)
class Template:
    id: str
    name: str
    parameters: tuple[Mapping, ...] = ()
    counters: Mapping[str, str] = field(default_factory=dict)
    calculations: Mapping[str, str] = field(default_factory=dict)
    columns: tuple[Mapping, ...] = ()
    hook: str = ""

    @classmethod
    def of(cls, raw: Mapping) -> Template:
        """A template from its mapping; one without id or name is an error."""
        if not raw.get("id") or "name" not in raw:
            raise ValueError("a template needs an id and a name")
        counters = {k: str(c.get("match") or "") for k, c in (raw.get("counters") or {}).items() if c.get("type", "print") == "print"}
        return cls(raw["id"], raw["name"], tuple(raw.get("parameters") or ()), counters, {k: str(v) for k, v in (raw.get("calculations") or {}).items()}, tuple(raw.get("columns") or ()), raw.get("hook_class") or "")

    def arguments(self, given: Mapping | None = None) -> dict:
        """Every parameter's value: what is given or its default, in its type; one out of its range or choices is an error."""
        out = {}
        for p in self.parameters:
            v = (given or {}).get(p["name"], p.get("default"))
            if v is not None:
                kind = _TYPES.get(str(p.get("type", "STRING")).upper(), str)
                v = v.strip().lower() in ("1", "true", "yes", "on") if kind is bool and isinstance(v, str) else kind(v)
                if p.get("min") is not None and v < p["min"] or p.get("max") is not None and v > p["max"]:
                    raise ValueError(f"{p['name']} must be from {p.get('min')} to {p.get('max')}")
                if p.get("choices") and v not in p["choices"]:
                    raise ValueError(f"{p['name']} must be one of {', '.join(map(str, p['choices']))}")
            out[p["name"]] = v
        return out


def load_templates(spark: SparkSession, path: str) -> tuple[dict[str, Template], dict[str, str]]:
    """Templates by id from the ``template.json`` files below a path, and what is wrong with the others by file. A handful of small files."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "template.json").text(path, wholetext=True)
    good, bad = {}, {}
    for r in files.select(F.col("_metadata.file_path").alias("file"), "value").orderBy("file").collect():
        try:
            t = Template.of(json.loads(r["value"]))
            good[t.id] = t
        except (ValueError, AttributeError, TypeError) as e:
            bad[r["file"]] = str(e)
    return good, bad


class _Expression:
    """A calculation as a Column and whether it divided by zero."""

    def __init__(self, known: Mapping[str, Column]):
        self.known = known
        self.zero = F.lit(False)

    def of(self, node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=bool() | str() as v):
                return F.lit(v)
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=name):
                return self.known.get(name, F.lit(None).cast("double"))
            case ast.UnaryOp(op=ast.USub(), operand=v):
                return -self.number(v)
            case ast.UnaryOp(op=ast.UAdd(), operand=v):
                return self.number(v)
            case ast.UnaryOp(op=ast.Not(), operand=v):
                return ~self.true(v)
            case ast.IfExp(test=test, body=a, orelse=b):
                on = self.true(test)
                before = self.zero
                then, self.zero = (self.number(a), self.zero), before
                other, self.zero = (self.number(b), self.zero), before
                self.zero = F.when(on, then[1]).otherwise(other[1])
                return F.when(on, then[0]).otherwise(other[0])
            case ast.BoolOp(op=op, values=values):
                out = self.true(values[0])
                for v in values[1:]:
                    out = out & self.true(v) if isinstance(op, ast.And) else out | self.true(v)
                return out
            case ast.Compare(left=left, ops=ops, comparators=right):
                sides = [self.of(x) for x in (left, *right)]
                signs = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}
                out = F.lit(True)
                for a, op, b in zip(sides, ops, sides[1:]):
                    if type(op) not in signs:
                        raise ValueError(f"not allowed in a calculation: {ast.unparse(node)}")
                    out = out & getattr(a, signs[type(op)])(b)
                return out
            case ast.BinOp(left=left, op=op, right=right):
                return self.arithmetic(op, self.number(left), self.number(right), node)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if args:
                return self.call(name, args, node)
        raise ValueError(f"not allowed in a calculation: {ast.unparse(node)}")

    def number(self, node: ast.expr) -> Column:
        return self.of(node).try_cast("double")

    def true(self, node: ast.expr) -> Column:
        return F.coalesce(self.of(node).try_cast("double") != 0, F.lit(False)) if not isinstance(node, (ast.Compare, ast.BoolOp)) else F.coalesce(self.of(node), F.lit(False))

    def arithmetic(self, op: ast.operator, a: Column, b: Column, node: ast.expr) -> Column:
        if isinstance(op, (ast.Div, ast.FloorDiv, ast.Mod)):
            self.zero = self.zero | F.coalesce(b == 0, F.lit(False))
            share = a / F.nullif(b, F.lit(0.0))
            return share if isinstance(op, ast.Div) else F.floor(share).cast("double") if isinstance(op, ast.FloorDiv) else a - b * F.floor(share)
        if isinstance(op, ast.Pow):
            v = F.pow(a, b)
            return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        simple = {ast.Add: a + b, ast.Sub: a - b, ast.Mult: a * b}
        if type(op) not in simple:
            raise ValueError(f"not allowed in a calculation: {ast.unparse(node)}")
        return simple[type(op)]

    def call(self, name: str, args: list[ast.expr], node: ast.expr) -> Column:
        if name == "len" and len(args) == 1:
            return F.length(self.of(args[0]).cast("string")).cast("double")
        if name == "str" and len(args) == 1:
            return self.of(args[0]).cast("string")
        v = [self.number(a) for a in args]
        if name in ("min", "max") and len(v) > 1:
            whole = v[0].isNotNull()
            for x in v[1:]:
                whole = whole & x.isNotNull()
            return F.when(whole, (F.least if name == "min" else F.greatest)(*v))
        if name == "round" and len(v) <= 2:
            digits = args[1].value if len(args) > 1 and isinstance(args[1], ast.Constant) else 0
            return F.bround(v[0], int(digits))
        one = {"abs": F.abs, "int": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"), "float": lambda x: x, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "log": lambda x: F.when(x > 0, F.log(x)), "exp": F.exp}
        if name in one and len(v) == 1:
            return one[name](v[0])
        raise ValueError(f"not allowed in a calculation: {ast.unparse(node)}")


def calculation(text: str, known: Mapping[str, Column]) -> Column:
    """An expression as a Column of doubles; known: the Columns of its names."""
    e = _Expression(known)
    value = e.number(ast.parse(text, mode="eval").body)
    return F.when(e.zero, F.lit(0.0)).otherwise(value)


def formatted(value: Column, pattern: str | None) -> Column:
    """A value as text by a pattern as {:.2f}, {:d}, {:.1%} or {}; empty where there is none. Without a pattern the plain text."""
    if not pattern:
        return value.cast("string")
    m = re.fullmatch(r"(.*?)\{(?::(?:(,)?(?:\.(\d+))?([fd%]))?)?\}(.*)", pattern, re.S)
    if not m:
        raise ValueError(f"not a format that is known: {pattern}")
    before, comma, digits, kind, after = m.groups()
    number = value.try_cast("double")
    n = int(digits) if digits else 6
    if kind is None:
        cell = value.cast("string")
    elif kind == "d":
        cell = F.format_number(number, 0) if comma else number.cast("long").cast("string")
    else:
        number = number * 100 if kind == "%" else number
        number = F.bround(number, n)  # halves go to the even digit
        cell = F.format_number(number, n) if comma else F.format_string(f"%.{n}f", number)
        cell = F.concat(cell, F.lit("%")) if kind == "%" else cell
    return F.when(value.isNotNull(), F.concat(F.lit(before), cell, F.lit(after))).otherwise("")


def counted(lines: DataFrame, templates: list[Template], file: str = "file", line: str = "line") -> DataFrame:
    """file and the counters of all templates, in one aggregation; the columns are numbered in the order of ``needles``."""
    return lines.groupBy(file).agg(*(F.count_if(F.contains(line, F.lit(n))).alias(f"n{i}") for i, n in enumerate(needles(templates))))


def needles(templates: list[Template]) -> list[str]:
    return list(dict.fromkeys(m for t in templates for m in t.counters.values() if m))


def _names(template: Template, shared: list[str], given: Mapping | None, file: str) -> dict[str, Column]:
    """The Columns of all names that a template's calculations and columns may use, calculations last."""
    name = F.element_at(F.split(F.col(file), "/"), -1)
    known = {k: (F.col(f"n{shared.index(m)}") if m else F.lit(0).cast("long")) for k, m in template.counters.items()}
    known |= {k: F.lit(v) for k, v in template.arguments(given).items()} | {"file": name}
    parts = {f: F.regexp_extract(name, FILE_NAME, i + 1) for i, f in enumerate(NAME_FIELDS)}
    known |= parts | {"session": F.when(parts["subject_id"] == "", name).otherwise(F.concat_ws("-", parts["subject_id"], parts["session_date"]))}
    for metric, text in template.calculations.items():
        known[metric] = calculation(text, known)
    return known


def tables(lines: DataFrame, templates: list[Template], given: Mapping[str, Mapping] | None = None, hooks: Mapping[str, Callable[[DataFrame, dict], DataFrame]] | None = None, file: str = "file", line: str = "line") -> dict[str, DataFrame]:
    """Each template's table by its id, its columns under their labels; all come from one aggregation over the lines.

    Without declared columns all names are columns. given: parameters by template. hooks: functions by the name that a template calls for; one gets
    the template's table and its arguments, and its result counts.
    """
    shared, out = needles(templates), {}
    base = counted(lines, templates, file, line)
    for t in templates:
        known = _names(t, shared, (given or {}).get(t.id), file)
        wanted = [c for c in t.columns if c.get("key") in known] if t.columns else [{"key": k} for k in known]
        d = base.select(*((formatted(known[c["key"]], c["format"]) if c.get("format") else known[c["key"]]).alias(c.get("label") or c["key"]) for c in wanted))
        hook = (hooks or {}).get(t.hook)
        out[t.id] = hook(d, t.arguments((given or {}).get(t.id))) if hook else d
    return out


def cells(lines: DataFrame, templates: list[Template], given: Mapping[str, Mapping] | None = None, file: str = "file", line: str = "line") -> DataFrame:
    """file, template, label, value (text) of every cell of all templates, in one scan."""
    shared, all_ = needles(templates), []
    for t in templates:
        known = _names(t, shared, (given or {}).get(t.id), file)
        for c in t.columns:
            if c.get("key") in known:
                all_.append(F.struct(F.lit(t.id).alias("template"), F.lit(c.get("label") or c["key"]).alias("label"), formatted(known[c["key"]], c.get("format")).alias("value")))
    d = counted(lines, templates, file, line)
    return d.select(file, F.explode(F.array(*all_)).alias("c")).select(file, "c.*")
