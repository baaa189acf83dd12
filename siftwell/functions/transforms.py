"""Numeric transforms of a column, as SQL expressions of x, and the presets that name them.

IEEE semantics as an array library has them: division by zero gives an infinity or NaN, logarithms of
negative numbers NaN, of zero minus infinity; comparisons with NaN are false.  ``OVER {b}``, ``{bo}``, ``{bl}``
and ``{bx}`` mark what is taken of the whole batch, see ``siftwell.plans.batchwise``.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Mapping

NAN, INF = "double('NaN')", "double('Infinity')"


def log(a: str, fn: str = "ln") -> str:
    return f"CASE WHEN isnan({a}) OR {a} < 0D THEN {NAN} WHEN {a} = 0D THEN -{INF} ELSE {fn}({a}) END"


def log1p(a: str) -> str:
    return f"CASE WHEN isnan({a}) OR {a} < -1D THEN {NAN} WHEN {a} = -1D THEN -{INF} ELSE log1p({a}) END"


def div(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0D THEN ({a}) / ({b}) WHEN isnan({a}) OR ({a}) = 0D THEN {NAN} WHEN ({a}) > 0D THEN {INF} ELSE -{INF} END"


def gt(a: str, b: str) -> str:
    return f"({a} > {b} AND NOT isnan({a}))"


def clip(a: str, low: str, high: str) -> str:
    return f"IF(isnan({a}), {a}, least(greatest({a}, {low}), {high}))"


def batch(fn: str, a: str) -> str:
    return f"{fn}({a}) OVER {{b}}"


def share(a: str, q: float) -> str:
    return f"percentile({a}, {q}D) OVER {{b}}"


def real(a: str) -> str:
    return f"nullif({a}, {NAN})"


def infinite(a: str) -> str:
    return f"(abs({a}) = {INF})"


# Names of the presets' transforms and what they compute.
MINIMAL = {
    "_tr_sqrt": "sqrt(x)",
    "_tr_log(x+1)": log("(x + 1D)"),
    "_tr_sqrt(abs(x))": "sqrt(abs(x))",
    "_tr_log(abs(x)+1)": log("(abs(x) + 1D)"),
}
DEFAULT = MINIMAL | {
    "_tr_div(x,abs(x))*log(abs(x))": f"({div('x', 'abs(x)')}) * ({log('abs(x)')})",
    "_tr_log(x + sqrt(pow(x,2), 1)": log("(x + sqrt(pow(x, 2D) + 1D))"),
    "_tr_log*sqrt": f"({log('(x + 1D)')}) * sqrt(x)",
    "_tr_log*100": f"rint(({log('(x + 1D)')}) * 100D)",
    "_tr_nonzero": "IF(x <> 0D, 1D, 0D)",
    "_tr_round(div(x,max))": f"rint({div('x', batch('max', 'x'))})",
}
_SCALE = div(f"(x - {batch('min', 'x')})", f"({batch('max', 'x')} - {batch('min', 'x')})")
_STANDARD = div(f"(x - {batch('avg', 'x')})", batch("stddev_pop", "x"))
EXTENDED = DEFAULT | {
    "_tr_squared": "pow(x, 2D)",
    "_tr_cubed": "pow(x, 3D)",
    "_tr_inverse": "IF(x <> 0D, 1D / x, 0D)",
    "_tr_exp": "exp(x)",
    "_tr_exp_minus_1": "expm1(x)",
    "_tr_sin": "sin(x)",
    "_tr_cos": "cos(x)",
    "_tr_tan": "tan(x)",
    "_tr_arcsin_safe": f"asin({clip('x', '-1D', '1D')})",
    "_tr_arccos_safe": f"acos({clip('x', '-1D', '1D')})",
    "_tr_arctan": "atan(x)",
    "_tr_sign": "signum(x)",
    "_tr_z_score": _STANDARD,
    "_tr_min_max_scale": _SCALE,
    "_tr_quadratic_root": "cbrt(x)",
    "_tr_shifted_sigmoid": div("1D", "(1D + exp(-x - 0.5D))"),
    "_tr_logistic": div("1D", "(1D + exp(-x))"),
}

#: Of the verbose preset: transforms that it has of x and, by the rule below, of its square or absolute value.
_CORE = {
    "reciprocal": "IF(x <> 0D, 1D / x, 0D)",
    "log1p": log1p("x"),
    "expm1": "expm1(x)",
    "softplus": log1p("exp(x)"),
    "absolute": "abs(x)",
    "normalize": _SCALE,
    "standardize": _STANDARD,
    "cumulative_sum": "sum(x) OVER {bo}",
    "diff": "x - lag(x, 1, 0D) OVER {bl}",
    "fourth_root": "sqrt(sqrt(x))",
    "positive": f"IF({gt('x', '0D')}, 1D, 0D)",
    "round(div(x,median))": f"rint({div('x', share('x', 0.5))})",
    "fourth_power": "pow(x, 4D)",
    "fifth_power": "pow(x, 5D)",
    "inverse_squared": "IF(x <> 0D, 1D / pow(x, 2D), 0D)",
    "exp2": "pow(2D, x)",
    "sinh": "sinh(x)",
    "cosh": "cosh(x)",
    "tanh": "tanh(x)",
    "log2": log("x", "log2"),
    "log10": log("x", "log10"),
    "sinc": "IF(x = 0D, 1D, sin(pi() * x) / (pi() * x))",
    "mean": batch("avg", "x"),
    "median": share("x", 0.5),
    "variance": batch("var_pop", "x"),
    "std_dev": batch("stddev_pop", "x"),
    "percentile_25": share("x", 0.25),
    "percentile_50": share("x", 0.5),
    "percentile_75": share("x", 0.75),
    "is_nan": "IF(isnan(x), 1D, 0D)",
    "is_finite": f"IF(isnan(x) OR {infinite('x')}, 0D, 1D)",
    "is_infinite": f"IF({infinite('x')}, 1D, 0D)",
    "is_positive": f"IF({gt('x', '0D')}, 1D, 0D)",
    "is_negative": "IF(x < 0D, 1D, 0D)",
    "is_zero": "IF(x = 0D, 1D, 0D)",
    "log2(x+1)": log("(x + 1D)", "log2"),
    "log2(abs(x)+1)": log("(abs(x) + 1D)", "log2"),
    "log2*sqrt": f"({log('(x + 1D)', 'log2')}) * sqrt(x)",
    "log2*100": f"rint(({log('(x + 1D)', 'log2')}) * 100D)",
    "sec": div("1D", "cos(x)"),
    "cosec": div("1D", "sin(x)"),
    "cot": div("1D", "tan(x)"),
    "arcsinh": "signum(x) * asinh(abs(x))",
    "arccosh": "acosh(x)",
    "arctanh": "atanh(x)",
    "poly2": "pow(x, 2D)",
    "poly3": "pow(x, 3D)",
    "poly4": "pow(x, 4D)",
    "custom1": "pow(x, 2D) + 2D * x + 1D",
    "custom2": "sin(x) + cos(x)",
    "custom3": f"exp(x) - ({log('(x + 1D)')})",
    "empirical_cdf": "cume_dist(x) OVER {bx}",
    "uniform_cdf": clip("x", "0D", "1D"),
    "exponential_cdf": "1D - exp(-x)",
}
_OF_X = {
    "clip_0_1": clip("x", "0D", "1D"),
    "log10(x+1)": log("(x + 1D)", "log10"),
    "fourth_root(abs(x))": "sqrt(sqrt(abs(x)))",
    "log10(abs(x)+1)": log("(abs(x) + 1D)", "log10"),
    "div(x,abs(x))*log10(abs(x))": f"({div('x', 'abs(x)')}) * ({log('abs(x)', 'log10')})",
    "log10*sqrt": f"({log('(x + 1D)', 'log10')}) * sqrt(x)",
    "log10*100": f"rint(({log('(x + 1D)', 'log10')}) * 100D)",
    "log10_abs(x+1)": log("(abs(x) + 1D)", "log10"),
    "log10_squared(abs(x)+1)": log("(pow(abs(x), 2D) + 1D)", "log10"),
    "div_squared(x,abs(x))*log10(abs(x))": f"({div('pow(x, 2D)', 'abs(x)')}) * ({log('abs(x)', 'log10')})",
    "log10*sqrt_squared": f"({log('(pow(x, 2D) + 1D)', 'log10')}) * sqrt(pow(x, 2D))",
    "log10*100_squared": f"rint(({log('(pow(x, 2D) + 1D)', 'log10')}) * 100D)",
    "square_root_abs": "sqrt(abs(x))",
    "log1p_abs": log1p("abs(x)"),
    "exp_minus_one": "expm1(x)",
    "inverse_abs": "IF(x <> 0D, 1D / abs(x), 0D)",
    "square_root_inverse": "sqrt(IF(x <> 0D, 1D / x, 0D))",
    "cubed_root": "cbrt(x)",
    "log1p_cubed": log1p("pow(x, 3D)"),
    "expm1_cubed": "expm1(pow(x, 3D))",
    "softplus_cubed": log1p("exp(pow(x, 3D))"),
    "clip_0_2": clip("x", "0D", "2D"),
    "log1p_squared": log1p("pow(x, 2D)"),
    "exp_squared": "exp(pow(x, 2D))",
    "sin_squared": "sin(pow(x, 2D))",
    "cos_squared": "cos(pow(x, 2D))",
    "tan_squared": "tan(pow(x, 2D))",
    "arctan_squared": "atan(pow(x, 2D))",
    "sign_squared": "signum(pow(x, 2D))",
    "fill_nan_with_zero": f"CASE WHEN isnan(x) THEN 0D WHEN x = {INF} THEN 1.797E308D WHEN x = -{INF} THEN -1.797E308D ELSE x END",
    "boxcox_lambda_0.5": f"IF({gt('x', '0D')}, (pow(x, 0.5D) - 1D) / 0.5D, {NAN})",
    "yeo_johnson_lambda_0": f"signum(x) * ({log('(abs(x) + 1D)')})",
    "relu": "greatest(0D, x)",
    "leaky_relu": f"IF({gt('x', '0D')}, x, 0.01D * x)",
    "elu": f"IF({gt('x', '0D')}, x, exp(x) - 1D)",
    "softsign": "x / (1D + abs(x))",
    "swish": "x / (1D + exp(-x))",
    "gelu_approx": "0.5D * x * (1D + tanh(sqrt(2D / pi()) * (x + 0.044715D * pow(x, 3D))))",
    "mish": f"x * tanh({log1p('exp(x)')})",
    "hard_sigmoid": clip("((x + 1D) / 2D)", "0D", "1D"),
    "hard_tanh": clip("x", "-1D", "1D"),
    "swish_flick": "x / (1D + exp(x))",
    "reciprocal_softplus": div("1D", log1p("exp(x)")),
    "bell_shape": "exp(-pow(x, 2D))",
    "gumbel_smx": "exp(-exp(-(x - 3D) / 4D))",
    "gumbel_smx1": "exp(-exp(-(x - 0.5D) / 2D))",
    "gumbel_smx2": "exp(-exp(-(x - 2D) / 1.2D))",
    "fancy_beta": f"sqrt({div('(2D * pi())', 'x')}) * pow(x / e(), x)",
    "energy_distance": f"sqrt(2D * {batch('var_pop', 'x')})",
}
#: The square's names for some of these differ from theirs.
_SQUARED_NAMES = {"log2(x+1)": "log2_squared(x+1)", "log2(abs(x)+1)": "log2_squared(abs(x)+1)", "round(div(x,median))": "round_squared(div(x,median))"}
_ABSOLUTE = ("z_score", "min_max_scale", "shifted_sigmoid", "logistic", "reciprocal", "normalize", "standardize", "cumulative_sum", "diff", "fourth_root")


def _of(expression: str, inner: str) -> str:
    """The expression with x replaced, but not within other names."""
    import re

    return re.sub(r"(?<![A-Za-z_.0-9])x(?![A-Za-z_0-9(])", inner, expression)


def _fills() -> dict[str, str]:
    """What takes the place of values by condition."""
    value = {"mean": batch("avg", real("x")), "median": f"percentile({real('x')}, 0.5D) OVER {{b}}", "max": batch("max", real("x")), "min": batch("min", real("x")), "zero": "0D", "nan": NAN}
    when = {"nan": ("isnan(x)", ("mean", "median", "max", "min")), "inf": (infinite("x"), ("zero", "mean", "median", "max", "min")), "zero": ("x = 0D", ("nan", "mean", "median", "max", "min")), "negative": ("x < 0D", ("zero", "nan", "mean", "median", "max", "min")), "positive": (gt("x", "0D"), ("zero", "nan", "mean", "median", "max", "min"))}
    out = {f"fill_{c}_with_{v}": f"IF({test}, {value[v]}, x)" for c, (test, names) in when.items() for v in names}
    out |= {f"threshold_10_with_{v}": f"IF({gt('x', '10D')}, {value[v]}, x)" for v in ("max", "min", "mean", "median")}
    out |= {f"threshold_minus_10_with_{v}": f"IF(x < -10D, {value[v]}, x)" for v in ("zero", "nan", "mean", "median")}
    return out | {f"clip_outliers_{low}_{100 - low}": clip("x", share("x", low / 100), share("x", 1 - low / 100)) for low in (1, 5, 10, 25)}


def _verbose() -> dict[str, str]:
    out = dict(EXTENDED)
    out |= {f"_tr_{k}": v for k, v in (_CORE | _OF_X | _fills()).items()}
    out |= {f"_tr_{_SQUARED_NAMES.get(k, k + '_squared')}": _of(v, "pow(x, 2D)") for k, v in _CORE.items() if k not in ("reciprocal", "log1p", "expm1", "softplus", "normalize", "standardize", "cumulative_sum", "diff")}
    every = {k.removeprefix("_tr_"): v for k, v in EXTENDED.items()} | _CORE
    return out | {f"_tr_{k}_abs": _of(every[k], "abs(x)") for k in _ABSOLUTE}


def _rounded() -> dict[str, str]:
    """Rounded in single precision: scaled, rounded half to even, scaled back."""
    return {f"{k}_round{n}": f"float(rint(float(float({v}) * float(1E{n}))) / 1E{n}D)" for k, v in EXTENDED.items() for n in (1, 2, 3, 4)}


# Resolutions and limits of the two-sided transforms.
FW_RESOLUTIONS = (1, 10, 50, 100)
FW_LIMITS = (1, 2, 4, 8, 16, 32, 64, 96)


def _two_sided() -> dict[str, str]:
    """Unchanged below a limit, a rounded multiple of the root or logarithm of the rest above it."""
    out = {}
    for prefix, scale in (("fw", 1), ("fw_prob", 100)):
        for name in ("sqrt", "log"):
            for res in FW_RESOLUTIONS:
                for limit in FW_LIMITS:
                    g = f"{limit / scale}D"
                    rest = f"(x - {g})"
                    value = f"sqrt{rest}" if name == "sqrt" else f"ln{rest}"  # of a positive number, by the test before
                    out[f"_tr_{prefix}_{name}_res_{res}_gt_{limit / scale:g}"] = f"CASE WHEN x < {g} THEN x WHEN {gt('x', g)} THEN rint(({value}) * {res}D) ELSE 0D END"
    return out


PRESETS: dict[str, dict[str, str]] = {
    "minimal": MINIMAL,
    "default": DEFAULT,
    "extended": EXTENDED,
    "verbose": _verbose(),
    "extended_rounded": _rounded(),
    "fw-transformers": DEFAULT | _two_sided(),
}
#: Transforms that need other rows by their place; see enrich.place_rows.
BY_PLACE = ("_tr_reverse", "_tr_sort", "_tr_argsort", "_tr_cumulative_prod", "_tr_reverse_squared", "_tr_sort_squared", "_tr_argsort_squared", "_tr_cumulative_prod_abs")

_FUNCTIONS = {"sqrt": "sqrt({})", "log": "LOG", "log1p": "LOG1P", "log2": "LOG2", "log10": "LOG10", "exp": "exp({})", "expm1": "expm1({})", "abs": "abs({})", "square": "pow({}, 2D)", "sin": "sin({})", "cos": "cos({})", "tan": "tan({})", "tanh": "tanh({})", "sinh": "sinh({})", "cosh": "cosh({})", "arctan": "atan({})", "sign": "signum({})", "cbrt": "cbrt({})", "round": "rint({})", "rint": "rint({})", "floor": "double(floor({}))", "ceil": "double(ceil({}))", "maximum": "greatest({}, {})", "minimum": "least({}, {})", "power": "pow({}, {})", "max": "max({}) OVER {{b}}", "min": "min({}) OVER {{b}}", "mean": "avg({}) OVER {{b}}", "std": "stddev_pop({}) OVER {{b}}", "median": "percentile({}, 0.5D) OVER {{b}}", "where": "IF({}, {}, {})", "clip": "CLIP"}


def parse(text: str) -> str:
    """An expression over X (arithmetic, comparisons, np.<function>) as a SQL expression; never evaluated.

    SyntaxError: it is none; NameError: it names something unknown.
    """

    def walk(node: ast.AST) -> str:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return f"{float(node.value)!r}D"
        if isinstance(node, ast.Name):
            if node.id in ("X", "x"):
                return "x"
            raise NameError(f"name {node.id!r} is not defined")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return f"(-{walk(node.operand)})" if isinstance(node.op, ast.USub) else walk(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = walk(node.left), walk(node.right)
            if isinstance(node.op, ast.Div):
                return f"({div(a, b)})"
            if isinstance(node.op, ast.Pow):
                return f"pow({a}, {b})"
            sign = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Mod: "%"}.get(type(node.op))
            if sign:
                return f"({a} {sign} {b})"
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            sign = {ast.Gt: ">", ast.Lt: "<", ast.GtE: ">=", ast.LtE: "<=", ast.Eq: "=", ast.NotEq: "<>"}.get(type(node.ops[0]))
            if sign:
                return f"({walk(node.left)} {sign} {walk(node.comparators[0])})"
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "np":
            if node.attr in ("pi", "e"):
                return f"{node.attr}()"
        if isinstance(node, ast.Call) and not node.keywords:
            f = node.func
            name = f.attr if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "np" else f.id if isinstance(f, ast.Name) else None
            args = [walk(a) for a in node.args]
            form = _FUNCTIONS.get(name or "")
            if form is None:
                raise NameError(f"function {name!r} is not defined")
            if form.startswith("LOG"):
                return f"({log1p(args[0])})" if form == "LOG1P" else f"({log(args[0], {'LOG': 'ln', 'LOG2': 'log2', 'LOG10': 'log10'}[form])})"
            return f"({clip(*args)})" if form == "CLIP" else form.format(*args)
        raise SyntaxError(f"not an expression over X: {text!r}")

    return walk(ast.parse(text, mode="eval"))


def load(names: str) -> dict[str, str]:
    """Transforms of comma-separated presets and JSON files (flat objects of strings), later ones winning.

    FileNotFoundError: no such file; ValueError: not such an object; NotImplementedError: nothing named.
    """
    out: dict[str, str] = {}
    for name in filter(None, (n.strip() for n in names.split(","))):
        if name in PRESETS:
            out |= PRESETS[name]
        elif name.endswith(".json"):
            with open(name) as f:
                try:
                    found = json.load(f)
                except ValueError as e:
                    raise ValueError(f"{name} is not JSON: {e}") from e
            if not isinstance(found, Mapping) or not all(isinstance(v, str) for v in found.values()):
                raise ValueError(f"{name} is not an object of strings")
            out |= {k: parse(v) for k, v in found.items()}
    if not out:
        raise NotImplementedError(f"no transforms are called {names!r}")
    return out
