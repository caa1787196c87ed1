"""Brute-force, row-at-a-time reference of the viewer's colour arithmetic in
plain Python (IEEE doubles, JavaScript operator semantics), for tests only."""

from __future__ import annotations

import math


def to_int32(x: int) -> int:
    x &= 0xFFFFFFFF
    return x - (1 << 32) if x >= (1 << 31) else x


def js_hash(s: str) -> int:
    h = 0
    data = s.encode("utf-16-be")
    for i in range(0, len(data), 2):
        unit = (data[i] << 8) | data[i + 1]
        h = unit + (to_int32(to_int32(h) << 5) - h)
    return h


def js_mod(a: float, m: float) -> float:
    return math.fmod(a, m)


def trunc_mod(a: int, m: int) -> int:
    r = abs(a) % m
    return -r if a < 0 else r


def hue2rgb(p: float, q: float, t: float) -> float:
    if t < 0:
        t += 1
    if t > 1:
        t -= 1
    if t < 1 / 6:
        return p + (q - p) * 6 * t
    if t < 1 / 2:
        return q
    if t < 2 / 3:
        return p + (q - p) * 6 * (2 / 3 - t)
    return p


def set_hsl(h: float, s: float, l: float) -> tuple[float, float, float]:
    h = js_mod(js_mod(h, 1) + 1, 1)
    s = min(max(s, 0.0), 1.0)
    l = min(max(l, 0.0), 1.0)
    if s == 0:
        return l, l, l
    p = l * (1 + s) if l <= 0.5 else l + s - l * s
    q = 2 * l - p
    return hue2rgb(q, p, h + 1 / 3), hue2rgb(q, p, h), hue2rgb(q, p, h - 1 / 3)


def rgb8(c: tuple[float, float, float]) -> tuple[int, int, int]:
    return tuple(int(math.floor(v * 255 + 0.5)) for v in c)


def category_color(value) -> tuple[int, int, int]:
    if value is None or value == "":
        return (136, 136, 136)
    h = js_hash(str(value))
    hue = ((trunc_mod(h, 360)) + 360) % 360
    sat = 70 + trunc_mod(h, 20)
    light = 50 + trunc_mod(h, 20)
    return rgb8(set_hsl(hue / 360, sat / 100, light / 100))


def js_number_text(v: float) -> str:
    """Number::toString for finite doubles, from the shortest digits."""
    from decimal import Decimal

    if v == 0:
        return "0"
    sign = "-" if v < 0 else ""
    _, digits, exp = Decimal(repr(abs(v))).normalize().as_tuple()
    s = "".join(map(str, digits))
    k = len(s)
    n = exp + k  # 10^(n-1) <= |v| < 10^n
    if k <= n <= 21:
        out = s + "0" * (n - k)
    elif 0 < n <= 21:
        out = s[:n] + "." + s[n:]
    elif -6 < n <= 0:
        out = "0." + "0" * (-n) + s
    else:
        e = n - 1
        mant = s[0] + ("." + s[1:] if k > 1 else "")
        out = f"{mant}e{'+' if e >= 0 else '-'}{abs(e)}"
    return sign + out


def gradient_color(v, lo, hi) -> tuple[int, int, int]:
    if v is None:
        return (136, 136, 136)
    if lo is not None and hi is not None and hi > lo:
        n = (v - lo) / (hi - lo)
        return rgb8(set_hsl((1 - n) * 0.7, 0.8, 0.5))
    return category_color(js_number_text(v))


def js_to_fixed(v: float, f: int) -> str:
    """Number.prototype.toFixed for |v| < 1e21, on the exact binary value."""
    from decimal import ROUND_HALF_UP, Decimal

    sign = "-" if v < 0 else ""
    q = Decimal(abs(v)).quantize(Decimal(1).scaleb(-f), rounding=ROUND_HALF_UP)
    return sign + (f"{q:.{f}f}")
