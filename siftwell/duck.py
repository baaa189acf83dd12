"""SQL text of the transforms for DuckDB, which has other names, literals and domain errors than Spark."""

from __future__ import annotations

import re
from collections.abc import Mapping

NAN, INF = "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)"
_WINDOWS = {"b": "OVER ()", "bo": "OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING)", "bl": "OVER (ORDER BY idx)"}


def _float(a: str) -> str:
    return f"(CASE WHEN abs({a}) > 3.4028235677973366E38 THEN sign({a}) * {INF} ELSE CAST(CAST({a} AS FLOAT) AS DOUBLE) END)"


#: What a call becomes; others stay.
_CALLS = {
    "sqrt": lambda a: f"(CASE WHEN {a} < 0 THEN {NAN} ELSE sqrt({a}) END)",
    "acosh": lambda a: f"(CASE WHEN {a} < 1 THEN {NAN} ELSE acosh({a}) END)",
    "atanh": lambda a: f"(CASE WHEN abs({a}) > 1 THEN {NAN} WHEN abs({a}) = 1 THEN {a} * {INF} ELSE atanh({a}) END)",
    "log1p": lambda a: f"(CASE WHEN abs({a}) < 1E-5 THEN {a} - {a} * {a} / 2 + {a} * {a} * {a} / 3 ELSE ln(1 + {a}) END)",
    "expm1": lambda a: f"(exp({a}) - 1)",
    "signum": lambda a: f"CAST(sign({a}) AS DOUBLE)",
    "rint": lambda a: f"round_even({a}, 0)",
    "float": _float,
    "e": lambda: "exp(1)",
    "percentile": lambda a, q: f"quantile_cont({a}, {q})",
}


def _parts(text: str) -> list[str]:
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out]


def _calls(text: str) -> str:
    """Calls by name, from the inside out."""
    out, at = "", 0
    for m in re.finditer(r"\b([a-z]\w*)\(", text):
        if m.start() < at or m[1] not in _CALLS:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        inner = text[m.end() : end - 1]
        out += text[at : m.start()] + _CALLS[m[1]](*(_parts(_calls(inner)) if inner.strip() else ()))
        at = end
    return out + text[at:]


def translated(expression: str) -> str:
    text = expression.replace("double('NaN')", NAN).replace("double('Infinity')", INF)
    text = re.sub(r"\b(\d+(?:\.\d+)?(?:E\d+)?)D\b", r"CAST(\1 AS DOUBLE)", text)
    text = re.sub(r"cume_dist\((.*?)\) OVER \{bx\}", r"cume_dist() OVER (ORDER BY \1)", text)
    text = re.sub(r"OVER \{(b|bo|bl)\}", lambda m: _WINDOWS[m[1]], text)
    return _calls(text)


def wide(base: str, column: str, transforms: Mapping[str, str]) -> str:
    """A CTE list: base (idx, x) and w, a column t0, t1, ... for each transform."""
    return f"base AS ({base}), w AS (SELECT " + ", ".join(f"{translated(e)} AS t{i}" for i, e in enumerate(transforms.values())) + " FROM base)"


def profile(base: str, column: str, transforms: Mapping[str, str]) -> str:
    """feature, rows, finite, low (to 4 places) of each transform."""
    n = range(len(transforms))
    low = lambda i: f"min(CASE WHEN isfinite(t{i}) THEN t{i} END)"
    totals = ", ".join(f"count(*) FILTER (WHERE isfinite(t{i})) AS n{i}, {low(i)} AS l{i}" for i in n)
    lists = ("[" + ", ".join(f"'{column}{name}'" for name in transforms) + "]", "[" + ", ".join("rows" for _ in n) + "]", "[" + ", ".join(f"n{i}" for i in n) + "]", "[" + ", ".join(f"round(l{i}, 4)" for i in n) + "]")
    return f"WITH {wide(base, column, transforms)}, s AS (SELECT count(*) AS rows, {totals} FROM w) SELECT " + ", ".join(f"unnest({x}) AS {name}" for x, name in zip(lists, ("feature", "rows", "finite", "low"), strict=True)) + " FROM s"


def admitted(base: str, column: str, transforms: Mapping[str, str], majority: float = 0.80, missing: float = 0.75) -> str:
    """feature of the transforms that are worth keeping."""
    cells = " UNION ALL ".join(f"SELECT '{column}{name}' AS feature, CAST(t{i} AS VARCHAR) AS v FROM w" for i, name in enumerate(transforms))
    return f"""WITH {wide(base, column, transforms)}, c AS ({cells}), k AS (SELECT feature, v, count(*) AS n FROM c GROUP BY ALL)
 SELECT feature FROM k GROUP BY feature HAVING count(*) > 1 AND max(n) < {majority} * sum(n) AND coalesce(sum(n) FILTER (WHERE v = 'nan'), 0) < {missing} * sum(n)"""
