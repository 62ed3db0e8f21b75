"""Column expressions over feature arrays. Weights are data: nested lists become literal arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda c: c,
    "linear": lambda c: c,
    "tanh": F.tanh,
    "sigmoid": lambda c: 1 / (1 + F.exp(-c)),
    "relu": lambda c: F.greatest(c, F.lit(0.0)),
    "leaky_relu": lambda c: F.when(c >= 0, c).otherwise(0.2 * c),
    "softplus": lambda c: F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c))),
    "elu": lambda c: F.when(c >= 0, c).otherwise(F.exp(c) - 1),
}


def activation(act: str | Callable[[Column], Column] | None) -> Callable[[Column], Column]:
    """A named activation, or the caller's own."""
    if act is None:
        return ACTIVATIONS["identity"]
    if callable(act):
        return act
    if act.lower() not in ACTIVATIONS:
        raise ValueError(f"no activation {act}; there are {', '.join(ACTIVATIONS)}")
    return ACTIVATIONS[act.lower()]


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot(x: Column, p: list[float]) -> Column:
    """Inner product with literal weights, unrolled, so that it stays in generated code."""
    out = F.lit(0.0)
    for i, v in enumerate(p):
        out = out + x[i] * F.lit(float(v))
    return out


def affine(x: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """x W + b. weights: a row for each input."""
    outs = len(weights[0])
    return F.array(*(dot(x, [row[j] for row in weights]) + F.lit(float(bias[j] if bias else 0.0)) for j in range(outs)))


def mlp(x: Column, layers: list[tuple[list[list[float]], list[float] | None]], act: str | Callable = "relu") -> Column:
    """Affine maps with an activation between them."""
    f = activation(act)
    for k, (weights, bias) in enumerate(layers):
        x = affine(x, weights, bias)
        if k < len(layers) - 1:
            x = F.transform(x, f)
    return x


def softmax(x: Column) -> Column:
    """Softmax of an array."""
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def segment_softmax(value: Column, *keys: str) -> Column:
    """Softmax of a column within groups."""
    w = Window.partitionBy(*keys)
    e = F.exp(value - F.max(value).over(w))
    return e / F.sum(e).over(w)


def stick_breaking(v: Column, k: int) -> Column:
    """pi_j = v_j prod_{i<j} (1 - v_i) for j < k - 1; the last takes the rest. v: k - 1 fractions."""
    left, out = F.lit(1.0), []
    for j in range(k - 1):
        out.append(left * v[j])
        left = left * (1 - v[j])
    return F.array(*out, left)


def hashed_weights(rows: int, cols: int, seed: int = 0) -> list[list[float]]:
    """A fixed matrix in (-1, 1) / sqrt(rows) from integer hashing, for operators that are used before they are trained."""
    out = []
    for i in range(rows):
        line = []
        for j in range(cols):
            h = (i * 73856093 ^ j * 19349663 ^ seed * 83492791) & 0xFFFFFFFF
            h = (h * 2654435761 + 12345) & 0xFFFFFFFF
            line.append((h / 2**31 - 1) / max(1, rows) ** 0.5)
        out.append(line)
    return out
