"""Statistics of a batch that an expression of x refers to, without a window over a batch's raw rows.

Expressions write ``fn(arg) OVER {b}`` for an aggregate of the batch (``percentile(arg, q)`` among them),
``sum(arg) OVER {bo}`` for a running sum by idx, ``lag(arg, 1, 0D) OVER {bl}`` for the value of the row before,
and ``cume_dist(arg) OVER {bx}`` for the share of rows up to a value.  Each distinct call becomes a column:

* aggregates: one ``groupBy(batch, column)`` for all, joined back (small, so by broadcast as a rule);
* percentiles, exact: a sketch brackets the two order statistics, one more aggregate counts what lies below
  the bracket and the values in it, and only those are ranked;
* by place: blocks of ``BLOCK`` rows carry their sum and last value to the next, rows only meet their block;
* share of rows: distinct values are counted, cut to ranges, and ranges carry their counts on.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of the running transforms.
BLOCK = 1 << 16
#: Accuracy of the sketch that brackets percentiles; batches of up to SMALL rows are ranked whole.
ACCURACY, SMALL = 10_000, 100_000
#: Ranges that the distinct values of a batch are cut to.
RANGES = 200

_OVER = re.compile(r"\s+OVER \{(b|bo|bl|bx)\}")
_KEY = ["batch", "column"]


def _open(text: str, end: int) -> int:
    """Where the bracket that closes at ``end`` opens."""
    depth = 0
    for i in range(end, -1, -1):
        depth += (text[i] == ")") - (text[i] == "(")
        if not depth:
            return i
    raise ValueError(f"unbalanced brackets: {text!r}")


def _arguments(text: str) -> list[str]:
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [a.strip() for a in out]


def calls(forms: Mapping[str, str]) -> tuple[dict[str, str], dict[tuple[str, str, tuple[str, ...]], str]]:
    """The expressions with calls replaced by columns, and the calls (kind, function, arguments) by column, inner ones first."""
    found: dict[tuple[str, str, tuple[str, ...]], str] = {}
    out = {}
    for name, text in forms.items():
        while m := _OVER.search(text):
            start = _open(text, m.start() - 1)
            fn = re.search(r"\w+$", text[:start])[0]
            call = (m[1], fn, tuple(_arguments(text[start + 1 : m.start() - 1])))
            text = text[: start - len(fn)] + found.setdefault(call, f"__s{len(found)}") + text[m.end() :]
        out[name] = text
    return out, found


def used(text: str) -> set[str]:
    return set(re.findall(r"__s\d+", text))


def with_calls(cells: DataFrame, found: Mapping[tuple[str, str, tuple[str, ...]], str]) -> DataFrame:
    """``cells`` (batch, idx, column, x) with a column for each call."""
    level: dict[str, int] = {}
    for (_, _, args), name in found.items():
        level[name] = 1 + max((level[u] for a in args for u in used(a)), default=0)
    for depth in sorted(set(level.values())):
        here = {c: n for c, n in found.items() if level[n] == depth}
        stats = {n: f"{fn}({', '.join(a)})" for (kind, fn, a), n in here.items() if kind == "b" and fn != "percentile"}
        ranks = {n: a for (kind, fn, a), n in here.items() if kind == "b" and fn == "percentile"}
        base = cells
        if stats:
            cells = cells.join(base.groupBy(*_KEY).agg(*(F.expr(e).alias(n) for n, e in stats.items())), _KEY)
        if ranks:
            cells = cells.join(percentiles(base, ranks), _KEY, "left")
        places = {n: (kind, a[0]) for (kind, _, a), n in here.items() if kind in ("bo", "bl")}
        if places:
            cells = _by_place(cells, places)
        for (kind, _, a), n in here.items():
            if kind == "bx":
                cells = _share(cells, a[0], n)
    return cells


def percentiles(cells: DataFrame, asked: Mapping[str, tuple[str, str]]) -> DataFrame:
    """batch, column and for each name the exact percentile (argument, share), interpolated; NaN is above all numbers, nulls are left out."""
    args = list(dict.fromkeys(a for a, _ in asked.values()))
    shares = {a: list(dict.fromkeys(float(q.rstrip("D")) for b, q in asked.values() if b == a)) for a in args}
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("arg"), F.expr(f"CAST({a} AS DOUBLE)").alias("v")) for i, a in enumerate(args))))
    rows = cells.select(*_KEY, values.alias("c")).select(*_KEY, "c.*").filter("v IS NOT NULL")
    every = sorted({q for qs in shares.values() for q in qs})
    margin = 5 / ACCURACY
    cuts = [p for q in every for p in (max(0.0, q - margin), min(1.0, q + margin))]
    number = F.when(~F.isnan("v"), F.col("v"))
    sketch = rows.groupBy(*_KEY, "arg").agg(F.count("*").alias("n"), F.count(number).alias("numbers"), F.percentile_approx(number, cuts, ACCURACY).alias("cuts"))
    asked_of = F.array(*(F.lit([q in shares[a] for q in every]).cast("array<boolean>") for a in args))
    each = F.posexplode(F.arrays_zip(F.lit(every).cast("array<double>").alias("q"), F.get(asked_of, F.col("arg")).alias("on")))
    wanted = sketch.select(*_KEY, "arg", "n", "numbers", "cuts", each.alias("i", "w")).filter("w.on")
    whole = F.col("n") <= SMALL
    low, high = (F.when(whole, F.lit(None)).otherwise(F.get("cuts", 2 * F.col("i") + j)) for j in (0, 1))
    wanted = wanted.select(*_KEY, "arg", "n", "numbers", "i", F.col("w.q").alias("q"), low.alias("low"), high.alias("high"))
    packed = wanted.groupBy(*_KEY, "arg").agg(F.collect_list(F.struct("i", "low", "high")).alias("wants"))
    near = rows.filter("NOT isnan(v)").join(packed, [*_KEY, "arg"]).select(*_KEY, "arg", "v", F.explode("wants").alias("w")).filter("w.high IS NULL OR v <= w.high")
    near = near.select(*_KEY, "arg", "w.i", F.when(F.expr("w.low IS NULL OR v >= w.low"), F.col("v")).alias("v"))
    counted = near.groupBy(*_KEY, "arg", "i", "v").agg(F.count("*").alias("m"))
    upto = Window.partitionBy(*_KEY, "arg", "i").orderBy(F.asc_nulls_first("v"))
    ranked = counted.withColumn("upto", F.sum("m").over(upto)).filter("v IS NOT NULL").join(wanted, [*_KEY, "arg", "i"])
    at = "((n - 1) * q)"
    pick = lambda rank: F.min(F.when(F.expr(f"upto > {rank}"), F.col("v")))
    sure = (F.max(F.expr(f"upto > least(ceil{at}, numbers - 1)")) & F.max(F.expr(f"upto - m <= floor{at}")))
    both = ranked.groupBy(*_KEY, "arg", "i").agg(pick(f"floor{at}").alias("lo"), pick(f"ceil{at}").alias("hi"), sure.alias("sure"))
    full = wanted.join(both, [*_KEY, "arg", "i"], "left")
    lo, hi = (F.expr(f"CASE WHEN {f}{at} >= numbers THEN double('NaN') WHEN sure THEN {c} ELSE double(raise_error('a percentile left its bracket')) END") for f, c in (("floor", "lo"), ("ceil", "hi")))
    full = full.select(*_KEY, "arg", "q", F.expr(at).alias("at"), lo.alias("lo"), hi.alias("hi"))
    value = F.expr("IF(lo = hi, lo, (ceil(at) - at) * lo + (at - floor(at)) * hi)")
    out = [F.first(F.when((F.col("arg") == args.index(a)) & (F.col("q") == float(q.rstrip("D"))), value), True).alias(n) for n, (a, q) in asked.items()]
    return full.groupBy(*_KEY).agg(*out)


def _by_place(cells: DataFrame, places: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Running sums (bo) and values of the row before, or 0 (bl), of an argument by idx."""
    cells = cells.withColumn("__block", F.floor(F.col("idx") / BLOCK))
    ends = [(F.expr(f"sum({a})") if kind == "bo" else F.expr(f"max_by({a}, idx)")).alias(f"__e{n}") for n, (kind, a) in places.items()]
    blocks = cells.groupBy(*_KEY, "__block").agg(*ends)
    order = Window.partitionBy(*_KEY).orderBy("__block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = [(F.coalesce(F.sum(f"__e{n}").over(before), F.lit(0.0)) if kind == "bo" else F.lag(f"__e{n}", 1, 0.0).over(order)).alias(f"__c{n}") for n, (kind, _) in places.items()]
    out = cells.join(blocks.select(*_KEY, "__block", *carried), [*_KEY, "__block"])
    w = Window.partitionBy(*_KEY, "__block").orderBy("idx")
    for n, (kind, a) in places.items():
        if kind == "bo":
            own = F.sum(F.expr(a)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"__c{n}")
        else:
            own = F.when(F.row_number().over(w) == 1, F.col(f"__c{n}")).otherwise(F.lag(F.expr(a)).over(w))
        out = out.withColumn(n, own)
    return out.drop("__block", *(f"__c{n}" for n in places))


def _share(cells: DataFrame, arg: str, name: str) -> DataFrame:
    """The share of a batch's rows whose argument is not above the row's; nulls come first."""
    cells = cells.withColumn("__v", F.expr(arg))
    counted = cells.groupBy(*_KEY, "__v").agg(F.count("*").alias("__m"))
    cuts = counted.groupBy(*_KEY).agg(F.percentile_approx(F.when(~F.isnan("__v"), F.col("__v")), [i / RANGES for i in range(1, RANGES)], ACCURACY).alias("__cuts"), F.sum("__m").alias("__n"))
    placed = counted.join(cuts, _KEY).withColumn("__r", F.when(F.col("__v").isNull(), -1).otherwise(F.expr("size(filter(coalesce(__cuts, array()), c -> c < __v))")))
    ranges = placed.groupBy(*_KEY, "__r").agg(F.sum("__m").alias("__t"))
    before = Window.partitionBy(*_KEY).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*_KEY, "__r", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__c"))
    upto = F.sum("__m").over(Window.partitionBy(*_KEY, "__r").orderBy("__v")) + F.col("__c")
    shares = placed.join(ranges, [*_KEY, "__r"]).select(*(F.col(k).alias(f"__{k}") for k in _KEY), F.col("__v").alias("__w"), (upto / F.col("__n")).alias(name))
    same = (F.col("batch") == F.col("__batch")) & (F.col("column") == F.col("__column")) & F.col("__v").eqNullSafe(F.col("__w"))
    return cells.join(shares, same).drop("__v", "__w", "__batch", "__column")
