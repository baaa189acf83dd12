"""Columns derived from others: transforms, multivalue expansion, sub-features, crosses, controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.pairs import RELATION, PairSampler, crosses
from siftwell.operators.profile import MISSING
from siftwell.plans.batchwise import calls, used, with_calls

#: Transforms that one aggregate takes at once, so that its generated code stays small enough to be compiled.
TOGETHER = 16


def numeric(column: str):
    """A column of text as numbers: quotes dropped, empty as 0."""
    text = F.regexp_replace(F.col(f"`{column}`").cast("string"), '"', "")
    return F.when(text == "", F.lit(0.0)).otherwise(text.cast("double"))


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), numeric(c).alias("x")) for c in columns)))
    return df.select("batch", "idx", cells.alias("c")).select("batch", "idx", "c.*")


def _wide(cells: DataFrame, transforms: dict[str, str], kind: str) -> DataFrame:
    """batch, idx, column and t0, t1, ...: the transforms in their order."""
    forms, found = calls(transforms)
    return with_calls(cells, found).selectExpr("batch", "idx", "column", *(f"CAST({e} AS {kind}) AS `t{i}`" if kind else f"{e} AS `t{i}`" for i, e in enumerate(forms.values())))


def transform_rows(df: DataFrame, columns: Sequence[str], transforms: dict[str, str]) -> DataFrame:
    """batch, idx, feature, value: each transform of each column, as text, one row each (no wide projection)."""
    wide = _wide(_cells(df, columns), transforms, "STRING")
    pieces = F.explode(F.array(*(F.struct(F.concat("column", F.lit(n)).alias("feature"), F.col(f"t{i}").alias("value")) for i, n in enumerate(transforms))))
    return wide.select("batch", "idx", pieces.alias("p")).select("batch", "idx", "p.*")


def transform_profile(df: DataFrame, columns: Sequence[str], transforms: dict[str, str]) -> DataFrame:
    """feature, rows, finite (rows with a finite number), low (the least of them) of each transform of each column.

    What ``transform_rows`` would list is aggregated where it is made, column by column: nothing grows with rows
    times transforms but arithmetic.  Transforms that need a row's place are taken apart from the others.
    """
    cells, out = _cells(df, columns), None
    _, found = calls(transforms)
    placed = {n for (kind, *_), n in found.items() if kind != "b"}
    forms = {n: e for n, e in transforms.items()}
    by_place = [n for n, e in calls(forms)[0].items() if used(e) & placed]
    rest = [n for n in forms if n not in by_place]
    for names in [by_place, *(rest[i : i + TOGETHER] for i in range(0, len(rest), TOGETHER))]:
        if not names:
            continue
        wide = _wide(cells, {n: forms[n] for n in names}, "")
        finite = [F.when(F.abs(f"t{i}") < float("inf"), F.col(f"t{i}")) for i in range(len(names))]  # NaN is above all
        totals = wide.groupBy("column").agg(F.count("*").alias("rows"), *(F.count(v).alias(f"n{i}") for i, v in enumerate(finite)), *(F.min(v).cast("double").alias(f"l{i}") for i, v in enumerate(finite)))
        pieces = F.explode(F.array(*(F.struct(F.concat("column", F.lit(n)).alias("feature"), F.col("rows"), F.col(f"n{i}").alias("finite"), F.col(f"l{i}").alias("low")) for i, n in enumerate(names))))
        one = totals.select(pieces.alias("p")).select("p.*")
        out = one if out is None else out.union(one)
    return out


def place_transforms(df: DataFrame, column: str, of: str = "x") -> DataFrame:
    """batch, idx and the transforms that look at rows by place: reverse, sort, argsort, running product.

    of: an expression of x, as x itself, pow(x, 2D) or abs(x)."""
    x = df.select("batch", "pos", "idx", numeric(column).alias("x")).withColumn("x", F.expr(of))
    w = Window.partitionBy("batch")
    x = x.withColumn("n", F.count("*").over(w)).withColumn("order", F.row_number().over(w.orderBy("x", "pos")) - 1)
    by = x.select(F.col("batch").alias("b2"), F.col("pos").alias("p2"), F.col("x").alias("reverse"))
    so = x.select(F.col("batch").alias("b3"), F.col("order").alias("p3"), F.col("x").alias("sort"), F.col("pos").cast("double").alias("argsort"))
    out = x.join(by, (x.batch == by.b2) & (x.n - 1 - x.pos == by.p2)).join(so, (x.batch == so.b3) & (x.pos == so.p3))
    running = F.product("x").over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return out.select("batch", "idx", "reverse", "sort", "argsort", running.alias("cumulative_prod"))


def place_rows(df: DataFrame, column: str) -> DataFrame:
    """batch, idx, feature, value of all transforms by place."""
    out = None
    for of, suffix, names in (("x", "", ("reverse", "sort", "argsort", "cumulative_prod")), ("pow(x, 2D)", "_squared", ("reverse", "sort", "argsort")), ("abs(x)", "_abs", ("cumulative_prod",))):
        pieces = F.explode(F.array(*(F.struct(F.lit(f"{column}_tr_{n}{suffix}").alias("feature"), F.col(n).cast("string").alias("value")) for n in names)))
        one = place_transforms(df, column, of).select("batch", "idx", pieces.alias("p")).select("batch", "idx", "p.*")
        out = one if out is None else out.union(one)
    return out


def admitted(rows: DataFrame, majority: float = 0.80, missing: float = 0.75) -> DataFrame:
    """batch, feature of derived columns worth keeping: over one value, none too common, not mostly NaN."""
    counts = rows.groupBy("batch", "feature", "value").agg(F.count("*").alias("n"))
    stats = counts.groupBy("batch", "feature").agg(F.count("*").alias("values"), (F.max("n") / F.sum("n")).alias("top"), (F.sum(F.when(F.col("value") == "NaN", F.col("n")).otherwise(0)) / F.sum("n")).alias("nan"))
    return stats.filter((F.col("values") > 1) & (F.col("top") < majority) & (F.col("nan") < missing)).select("batch", "feature")


def enrich_with_transforms(df: DataFrame, columns: Sequence[str], transforms: dict[str, str]) -> DataFrame:
    """batch, idx, feature, value of the admitted transforms; a verbose set has those by place, too."""
    rows = transform_rows(df, columns, transforms)
    if "_tr_cumulative_sum" in transforms:
        for c in columns:
            rows = rows.union(place_rows(df, c))
    return rows.join(admitted(rows), ["batch", "feature"], "left_semi").select("batch", "idx", "feature", "value")


def baseline_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    values = F.array(*(F.col(f"`{c}`").cast("string") for c in features))
    share = F.bround(F.size(F.filter(values, lambda x: x == "")) / F.lit(float(len(features))), 1)
    return df.withColumn("BASELINE-MISSING-PROPORTION", share).withColumn("BASELINE-DUMMY", F.lit(0))


def multivalue(df: DataFrame, features: Sequence[str], missing: Sequence[str] = MISSING) -> DataFrame:
    """batch, idx, feature (MULTIEX-<column>-<value>), value: the 1s of the expansion; all else is ''."""
    out = None
    for f in features:
        parts = F.array_distinct(F.split(F.translate(F.col(f"`{f}`").cast("string"), ",", "-"), "-"))
        one = df.select("batch", "idx", F.explode(parts).alias("v")).filter(~F.col("v").isin(*missing))
        one = one.select("batch", "idx", F.concat(F.lit(f"MULTIEX-{f}-"), "v").alias("feature"), F.lit("1").alias("value"))
        out = one if out is None else out.union(one)
    return out


def densified(sparse: DataFrame, df: DataFrame, fill: str = "") -> DataFrame:
    """A row for every row of df and feature of its batch; missing ones hold ``fill``."""
    names = sparse.select("batch", "feature").distinct()
    full = df.select("batch", "idx").join(names, "batch")
    return full.join(sparse, ["batch", "idx", "feature"], "left").select("batch", "idx", "feature", F.coalesce("value", F.lit(fill)).alias("value"))


def subfeatures(df: DataFrame, mapping: str) -> DataFrame:
    """batch, idx, feature, value of ``a->b`` and ``a<->b``, separated by ``;``.

    a->b: for each value v of b, SUBFEATURE-a&v is a AND b where b = v, else ''.  a<->b: for each va, vb the
    flag SUBFEATURE|a|b-va&vb.  Another form is a NotImplementedError.
    """
    out = None
    for part in filter(None, (m.strip() for m in mapping.split(";"))):
        if "<->" in part:
            a, b = part.split("<->")
            x, y = (df.select("batch", F.col(f"`{c}`").cast("string").alias(n)).distinct() for c, n in ((a, "va"), (b, "vb")))
            rows = df.select("batch", "idx", F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")).join(x.join(y, "batch"), "batch")
            one = rows.select("batch", "idx", F.concat(F.lit(f"SUBFEATURE|{a}|{b}-"), "va", F.lit("&"), "vb").alias("feature"), F.when((F.col("a") == F.col("va")) & (F.col("b") == F.col("vb")), "1").otherwise("0").alias("value"))
        elif "->" in part:
            a, b = part.split("->")
            y = df.select("batch", F.col(f"`{b}`").cast("string").alias("v")).distinct()
            rows = df.select("batch", "idx", F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")).join(y, "batch")
            one = rows.select("batch", "idx", F.concat(F.lit(f"SUBFEATURE-{a}&"), "v").alias("feature"), F.when(F.col("b") == F.col("v"), F.concat("a", F.lit("AND"), "b")).otherwise("").alias("value"))
        else:
            raise NotImplementedError(f"no sub-feature has the form {part!r}")
        out = one if out is None else out.union(one)
    return out


def with_crosses(df: DataFrame, features: Sequence[str], order: int = 2, label: str = "", relation: bool = False, sampler: PairSampler | None = None, sep: str = "", chosen: Sequence[tuple[str, ...]] | None = None) -> tuple[DataFrame, list[str]]:
    """Adds crossed columns, named by ' AND ' (' AND_REL ' and of order 2 for relations); values are joined by ``sep``."""
    combos = list(chosen) if chosen is not None else crosses(features, 2 if relation else order, label)
    combos = (sampler or PairSampler()).take(combos)
    names = [(RELATION if relation else " AND ").join(c) for c in combos]
    value = lambda c: F.xxhash64(F.concat_ws(sep, *(F.col(f"`{f}`").cast("string") for f in c))).cast("string")
    return df.select("*", *(value(c).alias(n) for c, n in zip(combos, names, strict=True))), names


def with_controls(df: DataFrame, label: str, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """Adds control columns of which none but the target should rank high; all as text."""
    rand = lambda i: F.rand(seed + i)
    made = {"CONTROL-constant": F.lit(0), "CONTROL-gaussian": F.randn(seed), "CONTROL-uniform": rand(1), "CONTROL-random-binary": F.floor(rand(2) * 2), "CONTROL-random-card100": F.floor(rand(3) * 101), "CONTROL-random-card2k": F.floor(rand(4) * 2001), "CONTROL-random-card10k": F.floor(rand(5) * 10001), "CONTROL-random-card50k": F.floor(rand(6) * 50001), "CONTROL-int-seq": F.col("idx"), "CONTROL-target": F.col(f"`{label}`"), "CONTROL-volume": F.xxhash64(*(f"`{c}`" for c in df.columns))}
    return df.select("*", *(c.cast("string").alias(n) for n, c in made.items())), list(made)
