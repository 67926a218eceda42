"""How a value is shown in an inspection summary."""

from __future__ import annotations

import json
import math


def number_text(x: float) -> str:
    """The shortest text that reads back as the double x: plain for 1e-6 <= |x| < 1e21, else with an exponent; whole
    numbers without a point; minus zero as 0."""
    if not math.isfinite(x):
        return "NaN"
    if x == 0:
        return "0"
    sign, digits = ("-" if x < 0 else ""), repr(abs(float(x)))
    mantissa, _, exponent = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len(figures)
    figures = figures.rstrip("0") or "0"
    if 0 < point <= 21:
        body = figures.ljust(point, "0")[:point] + ("." + figures[point:] if len(figures) > point else "")
    elif -6 < point <= 0:
        body = "0." + "0" * -point + figures
    else:
        e = point - 1
        body = figures[0] + ("." + figures[1:] if len(figures) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + body


def value_text(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value) if abs(value) < 10**21 else number_text(float(value))
    if isinstance(value, float):
        return number_text(value)
    if isinstance(value, str):
        return value
    return json.dumps(value, default=str)
