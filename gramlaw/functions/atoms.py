"""One-variable atoms and registry operators, each in three matching forms.

``column`` is the JVM form used in queries and law scoring, ``array`` the NumPy form used inside Arrow batches when
hundreds of candidates are evaluated at once, and ``sql`` the text form used to export a law.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's for equal results).
EPS = 1e-9
REGISTRY_EPS = 1e-8
POS_CAP, NEG_CAP = 1e6, -1e6
GELU_CUBIC = 0.044715
GELU_SCALE = math.sqrt(2.0 / math.pi)


@dataclass(frozen=True)
class Atom:
    name: str
    column: Callable[..., Column]
    array: Callable[..., np.ndarray]
    sql: str
    params: tuple[tuple[str, float], ...] = ()
    arity: int = 1
    commutative: bool = False
    bits: float = 8.0

    @property
    def defaults(self) -> dict[str, float]:
        return dict(self.params)


def finite(c: Column) -> Column:
    """NaN and null become 0, infinities are capped. Written with few mentions of ``c``: each one is inlined."""
    odd = F.nanvl(F.signum(c), F.lit(0.0)) * POS_CAP
    return F.coalesce(F.when(F.abs(c) < F.lit(math.inf), c).otherwise(odd), F.lit(0.0))


def finite_array(a: np.ndarray) -> np.ndarray:
    if np.isfinite(a.sum()):  # nothing to replace: a missing or infinite value would show in the sum
        return a
    return np.nan_to_num(a, nan=0.0, posinf=POS_CAP, neginf=NEG_CAP)


def finite_sql(text: str) -> str:
    return (
        f"CASE WHEN ({text}) IS NULL OR isnan({text}) THEN 0.0 "
        f"WHEN ({text}) = CAST('Infinity' AS DOUBLE) THEN {POS_CAP!r} "
        f"WHEN ({text}) = CAST('-Infinity' AS DOUBLE) THEN {NEG_CAP!r} ELSE ({text}) END"
    )


def _between(c: Column, lo: float, hi: float) -> Column:
    """Clip; NaN and null give null (``least`` alone would turn them into the bound)."""
    return F.when(c <= F.lit(math.inf), F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo))))


def _logistic(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-_between(c, -20, 20)))


def _logistic_array(a: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(a, -20, 20)))


_SIGMOID_SQL = "(1.0/(1.0+exp(-greatest(least({x},20.0),-20.0))))"
_TANH_GELU_SQL = f"tanh({GELU_SCALE!r}*({{x}}+{GELU_CUBIC!r}*{{x}}*{{x}}*{{x}}))"

# Candidate bank, in catalog order: the order decides ties, so it is part of the result.
_BANK = [
    Atom("x", lambda c: c, lambda a: a, "{x}"),
    Atom("x^2", lambda c: c * c, np.square, "({x}*{x})"),
    Atom("x^3", lambda c: c * c * c, lambda a: a * a * a, "({x}*{x}*{x})"),
    Atom("|x|", F.abs, np.abs, "abs({x})"),
    Atom("sgn*x", lambda c: F.signum(c) * c, lambda a: np.sign(a) * a, "(sign({x})*{x})"),
    Atom(
        "sgn*sqrt|x|",
        lambda c: F.signum(c) * F.sqrt(F.abs(c) + EPS),
        lambda a: np.sign(a) * np.sqrt(np.abs(a) + EPS),
        f"(sign({{x}})*sqrt(abs({{x}})+{EPS!r}))",
    ),
    Atom("sqrt|x|", lambda c: F.sqrt(F.abs(c) + EPS), lambda a: np.sqrt(np.abs(a) + EPS), f"sqrt(abs({{x}})+{EPS!r})"),
    Atom("log1p|x|", lambda c: F.log1p(F.abs(c)), lambda a: np.log1p(np.abs(a)), "ln(1.0+abs({x}))"),
    Atom("x/(1+|x|)", lambda c: c / (1.0 + F.abs(c)), lambda a: a / (1.0 + np.abs(a)), "({x}/(1.0+abs({x})))"),
    Atom("x/(1+x^2)", lambda c: c / (1.0 + c * c), lambda a: a / (1.0 + a * a), "({x}/(1.0+{x}*{x}))"),
    Atom("1/(1+|x|)", lambda c: 1.0 / (1.0 + F.abs(c)), lambda a: 1.0 / (1.0 + np.abs(a)), "(1.0/(1.0+abs({x})))"),
    Atom("softsign", lambda c: c / (1.0 + F.abs(c)), lambda a: a / (1.0 + np.abs(a)), "({x}/(1.0+abs({x})))"),
    Atom("tanh", F.tanh, np.tanh, "tanh({x})"),
    Atom("sigmoid", _logistic, _logistic_array, _SIGMOID_SQL),
    Atom("atan", F.atan, np.arctan, "atan({x})"),
    Atom("sin", F.sin, np.sin, "sin({x})"),
    Atom("cos", F.cos, np.cos, "cos({x})"),
    Atom(
        "sinh_sat",
        lambda c: F.sinh(_between(c, -3, 3)),
        lambda a: np.sinh(np.clip(a, -3, 3)),
        "((exp(greatest(least({x},3.0),-3.0))-exp(-greatest(least({x},3.0),-3.0)))/2.0)",
    ),
    Atom("relu", lambda c: F.greatest(c, F.lit(0.0)), lambda a: np.maximum(a, 0.0), "greatest({x},0.0)"),
    Atom(
        "lrelu",
        lambda c: F.when(c >= 0, c).otherwise(c * 0.1),
        lambda a: np.where(a >= 0, a, 0.1 * a),
        "(CASE WHEN {x}>=0 THEN {x} ELSE 0.1*{x} END)",
    ),
    Atom(
        "elu",
        lambda c: F.when(c > 0, c).otherwise(F.exp(_between(c, -20, 0)) - 1.0),
        lambda a: np.where(a > 0, a, np.exp(np.clip(a, -20, 0)) - 1.0),
        "(CASE WHEN {x}>0 THEN {x} ELSE exp(greatest(least({x},0.0),-20.0))-1.0 END)",
    ),
    Atom(
        "gelu",
        lambda c: c * 0.5 * (1.0 + F.tanh((c + c * c * c * GELU_CUBIC) * GELU_SCALE)),
        lambda a: a * 0.5 * (1.0 + np.tanh((a + a * a * a * GELU_CUBIC) * GELU_SCALE)),
        f"(0.5*{{x}}*(1.0+{_TANH_GELU_SQL}))",
    ),
    Atom("swish", lambda c: c * _logistic(c), lambda a: a * _logistic_array(a), f"({{x}}*{_SIGMOID_SQL})"),
    Atom("hat", lambda c: _between(F.abs(c), 0, 3), lambda a: np.minimum(np.abs(a), 3.0), "least(abs({x}),3.0)"),
]

UNARY: dict[str, Atom] = {a.name: a for a in _BANK}


def register_atom(name: str, column: Callable, array: Callable, sql: str | None = None) -> Atom:
    """Add a user atom to the candidate bank; both forms must agree (``tests`` check the built-in ones)."""
    UNARY[name] = USER_ATOMS[name] = Atom(name, column, array, sql or "")
    return UNARY[name]


USER_ATOMS: dict[str, Atom] = {}
USER_OPS: dict[str, Atom] = {}


def adopt(atoms: dict[str, Atom], ops: dict[str, Atom]) -> None:
    """Make the user's atoms and operators known to this process; candidates bring them along to the executors."""
    UNARY.update(atoms)
    REGISTRY.update(ops)


def forget(name: str) -> None:
    """Take a user atom or operator back."""
    for known, users in ((UNARY, USER_ATOMS), (REGISTRY, USER_OPS)):
        if users.pop(name, None):
            known.pop(name, None)


def apply_atom(name: str, c: Column) -> Column:
    """JVM form of a bank atom: a missing or non-finite result never leaves the expression."""
    return finite(UNARY[name].column(c))


def apply_atom_array(name: str, a: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return finite_array(UNARY[name].array(a))


# --------------------------------------------------------------------------------------------------------------
# Registry operators used by expression graphs.


def _beta_ratio(c, beta=1.0):
    return c / (1.0 + F.abs(c) * beta + REGISTRY_EPS)


def _guarded_div(a: Column, b: Column) -> Column:
    """a / (sign(b)·max(|b|, 1e-8)); a zero divisor gives ±infinity or NaN as floating-point division would."""
    by_zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    divisor = F.signum(b) * F.greatest(F.abs(b), F.lit(REGISTRY_EPS))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(divisor))


def _guarded_div_array(a, b):
    with np.errstate(all="ignore"):
        return a / (np.sign(b) * np.maximum(np.abs(b), REGISTRY_EPS))


_REGISTRY = [
    Atom("id", lambda c: c, lambda a: a, "{x}", bits=1.0),
    Atom("sin", F.sin, np.sin, "sin({x})"),
    Atom("cos", F.cos, np.cos, "cos({x})"),
    Atom("tanh", F.tanh, np.tanh, "tanh({x})"),
    Atom("abs", F.abs, np.abs, "abs({x})"),
    Atom("square", lambda c: c * c, np.square, "({x}*{x})"),
    Atom(
        "signed_sqrt",
        lambda c: F.signum(c) * F.sqrt(F.abs(c) + REGISTRY_EPS),
        lambda a: np.sign(a) * np.sqrt(np.abs(a) + REGISTRY_EPS),
        f"(sign({{x}})*sqrt(abs({{x}})+{REGISTRY_EPS!r}))",
    ),
    Atom("log1p_abs", lambda c: F.log1p(F.abs(c)), lambda a: np.log1p(np.abs(a)), "ln(1.0+abs({x}))"),
    Atom(
        "x_over_one_plus_beta_abs",
        _beta_ratio,
        lambda a, beta=1.0: a / (1.0 + beta * np.abs(a) + REGISTRY_EPS),
        f"({{x}}/(1.0+{{beta}}*abs({{x}})+{REGISTRY_EPS!r}))",
        params=(("beta", 1.0),),
    ),
    Atom(
        "sin_affine",
        lambda c, omega=1.0, phi=0.0: F.sin(c * omega + phi),
        lambda a, omega=1.0, phi=0.0: np.sin(omega * a + phi),
        "sin({omega}*{x}+{phi})",
        params=(("omega", 1.0), ("phi", 0.0)),
    ),
    Atom("add", lambda a, b: a + b, np.add, "({x}+{y})", arity=2, commutative=True),
    Atom("sub", lambda a, b: a - b, np.subtract, "({x}-{y})", arity=2),
    Atom("mul", lambda a, b: a * b, np.multiply, "({x}*{y})", arity=2, commutative=True),
    Atom(
        "safe_div",
        _guarded_div,
        _guarded_div_array,
        f"({{x}}/(sign({{y}})*greatest(abs({{y}}),{REGISTRY_EPS!r})))",
        arity=2,
    ),
    Atom("max", F.greatest, np.maximum, "greatest({x},{y})", arity=2, commutative=True),
    Atom("min", F.least, np.minimum, "least({x},{y})", arity=2, commutative=True),
]

REGISTRY: dict[str, Atom] = {a.name: a for a in _REGISTRY}


def register_op(
    name: str,
    column: Callable,
    array: Callable,
    arity: int = 1,
    params: dict[str, float] | None = None,
    bits: float = 8.0,
    commutative: bool = False,
    sql: str = "",
) -> Atom:
    """Add a user operator for expression graphs."""
    REGISTRY[name] = USER_OPS[name] = Atom(name, column, array, sql, tuple((params or {}).items()), arity, commutative, bits)
    return REGISTRY[name]
