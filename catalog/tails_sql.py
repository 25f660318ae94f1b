"""Tail probabilities in SQL, by Simpson's rule: the counterpart of ``assay.functions.tails``."""

STEPS = 2000


def _simpson(integrand: str, upper: str) -> str:
    """Integral from 0 to ``upper`` of an expression in x."""
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    body = integrand.replace("x_", f"(i * ({upper}) / {STEPS}.0)")
    return f"(({upper}) / {3 * STEPS}.0 * list_sum(list_transform(range(0, {STEPS + 1}), lambda i: {weight} * ({body}))))"


def normal_two_sided(z: str) -> str:
    top = f"least(abs({z}), 10.0)"
    return f"greatest(0.0, 1 - 2 * {_simpson('exp(-0.5 * x_ * x_) / sqrt(2 * pi())', top)})"


def t_two_sided(t: str, df: str) -> str:
    """From the integral of cos^(df - 1) up to atan(t / sqrt(df))."""
    scale = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi())"
    return f"greatest(0.0, 1 - 2 * {scale} * {_simpson(f'pow(cos(x_), ({df}) - 1)', f'atan(abs({t}) / sqrt({df}))')})"


def f_upper(f: str, d1: str, d2: str) -> str:
    """One minus the regularised incomplete beta function; d1 of at least 2."""
    a, b = f"(({d1}) / 2.0)", f"(({d2}) / 2.0)"
    top = f"(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2})))"
    scale = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))"
    return f"greatest(0.0, 1 - {scale} * {_simpson(f'pow(x_, {a} - 1) * pow(1 - x_, {b} - 1)', top)})"


def chi2_upper_even(x: str, half: int) -> str:
    """Closed form for 2 * ``half`` degrees of freedom."""
    terms = " + ".join(f"pow(({x}) / 2.0, {i}) / {' * '.join(map(str, range(1, i + 1))) or '1'}" for i in range(half)).replace(
        "/ 1 * 2", "/ (1 * 2)")
    return f"exp(-({x}) / 2.0) * ({terms})"


def u_two_sided(u: str, na: str, nb: str, ties: str) -> str:
    """Normal p of Mann-Whitney's U with tie and continuity correction."""
    mean = f"(({na}) * ({nb}) / 2.0)"
    sigma = f"sqrt(({na}) * ({nb}) / 12.0 * ((({na}) + ({nb}) + 1) - ({ties}) / ((({na}) + ({nb})) * (({na}) + ({nb}) - 1.0))))"
    z = f"((greatest({u}, ({na}) * ({nb}) - ({u})) - {mean} - 0.5) / {sigma})"
    return f"CASE WHEN {z} < 0 THEN 1.0 ELSE {normal_two_sided(z)} END"
