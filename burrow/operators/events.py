"""Counters, latencies and sequences over event logs (session, frame as order, t_us, kind, name), and their formulas."""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.operators.series import FRAME, SESSION, along


@dataclass(frozen=True)
class Counter:
    """What to count: rows of ``kind`` (any if empty) whose name equals ``match``, or in which ``regex`` is found.

    ``agg``: count, last (the name, or the first group as a number), append (1, or the group, in order), or
    sum (of the first group; never anything for exact matches).
    """

    key: str
    kind: str = ""
    match: str = ""
    regex: str = ""
    agg: str = "count"


def _hit(c: Counter) -> Column:
    kind = F.lit(True) if c.kind in ("", "any") else F.col("kind") == c.kind
    return kind & (F.col("name") == c.match if c.match else F.col("name").rlike(c.regex) if c.regex else F.lit(False))


def _group(c: Counter) -> Column:
    return F.regexp_extract("name", c.regex, 1).try_cast("double") if c.regex and "(" in c.regex else F.lit(None).cast("double")


def counters(log: DataFrame, wanted: list[Counter]) -> DataFrame:
    """session and one column per counter, in one aggregation over the log."""
    out = []
    for c in wanted:
        hit, number = _hit(c), _group(c)
        if c.agg == "count":
            out.append(F.count(F.when(hit, 1)).alias(c.key))
        elif c.agg == "sum":
            out.append(F.coalesce(F.sum(F.when(hit & F.lit(not c.match), number)), F.lit(0.0)).alias(c.key))
        elif c.agg == "last":
            value = F.col("name") if c.match else number.cast("string")
            out.append(F.max_by(value, F.when(hit & value.isNotNull(), F.col(FRAME))).alias(c.key))
        elif c.agg == "append":
            value = F.lit(1.0) if c.match else number
            rows = F.array_sort(F.collect_list(F.when(hit & value.isNotNull(), F.struct(FRAME, value.alias("v")))))
            out.append(F.transform(rows, lambda e: e["v"]).alias(c.key))
    return log.groupBy(SESSION).agg(*out)


def latencies(log: DataFrame, start: Column, end: Column) -> DataFrame:
    """session, frame, latency_us of each measurement: from the last start to the first end after it.

    A start while one is open starts anew; a row that is both is a start; an end without a start is nothing.
    """
    marks = log.withColumn("mark", F.when(F.coalesce(start, F.lit(False)), 1).when(F.coalesce(end, F.lit(False)), 2)).where("mark IS NOT NULL")
    before = marks.withColumns({"was": F.lag("mark").over(along()), "was_t": F.lag("t_us").over(along())})
    return before.where("mark = 2 AND was = 1").select(SESSION, FRAME, (F.col("t_us") - F.col("was_t")).alias("latency_us"))


def sequences(log: DataFrame, tokens: dict[str, str]) -> DataFrame:
    """session, sequence: the tokens of rows whose name starts with a prefix, in order; the first prefix that fits gives the token."""
    token = F.coalesce(*(F.when(F.startswith("name", F.lit(p)), F.lit(t)) for t, p in tokens.items() if p))
    hits = log.withColumn("token", token).where("token IS NOT NULL")
    return hits.groupBy(SESSION).agg(F.array_sort(F.collect_list(F.struct(FRAME, "token"))).alias("all")).select(SESSION, F.transform("all", lambda e: e["token"]).alias("sequence"))


def fanned_out(rows: DataFrame, array: str, columns: int, prefix: str) -> DataFrame:
    """The first elements of an array as columns of their own; null past its end."""
    return rows.select("*", *(F.get(array, i).alias(f"{prefix}{i + 1}") for i in range(columns))).drop(array)


_FUNCTIONS = {
    "mean": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a),
    "sum": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x),
    "min": F.array_min,
    "max": F.array_max,
    "len": lambda a: F.size(a).cast("double"),
}


class Formula:
    """A restricted arithmetic expression over counter columns, compiled to a Column.

    Names that aren't columns are 0, a list stands for its mean, a division by zero, NaN or
    infinity gives 0. Only numbers, names, + - * / ** %, unary minus, and calls of mean, stdev, cv,
    median, min, max, len, sum, abs and round are allowed; anything else is a ValueError.
    """

    def __init__(self, text: str, columns: dict[str, str]):
        self.columns = columns
        self.tree = ast.parse(text, mode="eval").body

    def column(self) -> Column:
        v = self._scalar(self.tree)
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)

    def _is_list(self, node: ast.expr) -> bool:
        return isinstance(node, ast.Name) and self.columns.get(node.id, "").startswith("array")

    def _scalar(self, node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in self.columns:
                return F.lit(0.0)
            return self._call("mean", node) if self._is_list(node) else F.coalesce(F.col(node.id).try_cast("double"), F.lit(0.0))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            v = self._scalar(node.operand)
            return -v if isinstance(node.op, ast.USub) else v
        if isinstance(node, ast.BinOp):
            a, b = self._scalar(node.left), self._scalar(node.right)
            kind = type(node.op)
            if kind in (ast.Div, ast.Mod):
                return F.when(b != 0, a / b if kind is ast.Div else F.pmod(a, b)).otherwise(0.0)
            if kind in (ast.Add, ast.Sub, ast.Mult, ast.Pow):
                return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Pow: lambda: F.pow(a, b)}[kind]()
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords and node.args:
            return self._call(node.func.id, *node.args)
        raise ValueError(f"not allowed in a formula: {ast.dump(node)}")

    def _call(self, name: str, first: ast.expr, *more: ast.expr) -> Column:
        if name == "abs":
            return F.abs(self._scalar(first))
        if name == "round":
            digits = more[0].value if more and isinstance(more[0], ast.Constant) else 0
            return F.round(self._scalar(first), int(digits))
        if more:
            raise ValueError(f"{name} takes one argument")
        if name == "len" and not self._is_list(first):
            return F.lit(0.0)  # a number has no length
        a = F.col(first.id) if self._is_list(first) else F.array(self._scalar(first))
        size = F.size(a)
        mean = _FUNCTIONS["mean"](a)
        if name in ("stdev", "cv"):
            sd = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.when(size > 1, size - 1))
            v = sd if name == "stdev" else F.when(mean != 0, sd / mean)
        elif name == "median":
            s = F.sort_array(a)
            v = (F.get(s, F.floor((size - 1) / 2).cast("int")) + F.get(s, F.floor(size / 2).cast("int"))) / 2
        elif name in _FUNCTIONS:
            v = _FUNCTIONS[name](a)
        else:
            raise ValueError(f"no such function: {name}")
        return F.coalesce(F.when(size > 0, v), F.lit(0.0))


def calculated(rows: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """rows with a column for each formula over its columns."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({k: Formula(f, kinds).column() for k, f in formulas.items()})


def substring_counts(lines: DataFrame, file: str, line: str, needles: dict[str, str]) -> DataFrame:
    """file and, for each needle, the number of its lines that hold it."""
    return lines.groupBy(file).agg(*(F.count(F.when(F.contains(line, F.lit(n)), 1)).alias(k) for k, n in needles.items()))


def changed_only(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value differs from the row before; a session's first row stays."""
    return df.withColumn("was", F.struct(F.lag(value).over(along()).alias("v"), F.row_number().over(along()).alias("n"))).where((F.col("was.n") == 1) | ~F.col(value).eqNullSafe(F.col("was.v"))).drop("was")


def rolling_sd(df: DataFrame, value: str, n: int, out: str) -> DataFrame:
    """Population deviation of the last n values."""
    return df.withColumn(out, F.stddev_pop(value).over(along().rowsBetween(-(n - 1), 0)))


def template_scores(prints: DataFrame, templates: dict[str, list[str]], name: str = "name") -> DataFrame:
    """session, template, score: the share of a template's keywords that any print of the session holds, without regard to case."""
    low = F.lower(name)
    shares = [F.struct(F.lit(t).alias("template"), (sum(F.max(F.contains(low, F.lit(k.lower())).cast("int")) for k in keys) / len(keys)).alias("score")) for t, keys in templates.items() if keys]
    found = prints.groupBy(SESSION).agg(F.array(*shares).alias("all"))
    return found.select(SESSION, F.explode("all").alias("t")).select(SESSION, "t.*")


def configured(prints: DataFrame, templates: dict[str, list[str]], name: str = "name", least_prints: int = 5, least_score: float = 0.5, most: int = 10) -> DataFrame:
    """session, template, counters of sessions with ``least_prints`` distinct prints or more.

    The template with the best score, the first of equal ones, if it reaches ``least_score``; else no template and one counter for each of
    the ``most`` most frequent prints, ties by name. A session's distinct prints are aggregated, never its rows.
    """
    n = prints.where(F.col(name).isNotNull()).groupBy(SESSION, name).agg(F.count("*").alias("n"))
    w = Window.partitionBy(SESSION)
    n = n.withColumns({"distinct": F.count("*").over(w), "place": F.row_number().over(w.orderBy(F.desc("n"), name))}).where(F.col("distinct") >= least_prints)
    top = n.where(F.col("place") <= most).groupBy(SESSION).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(name).alias("name")))), lambda s: s["name"]).alias("names"))
    order = F.create_map(*(x for i, t in enumerate(templates) for x in (F.lit(t), F.lit(-i))))
    best = template_scores(prints, templates, name).groupBy(SESSION).agg(F.max(F.struct("score", F.element_at(order, F.col("template")).alias("first"), "template")).alias("b"))
    j = top.join(best, SESSION, "left")
    chosen = F.when(F.col("b.score") >= least_score, F.col("b.template"))
    return j.select(SESSION, chosen.alias("template"), F.when(chosen.isNull(), F.array_join("names", "|")).alias("counters"))
