"""Canonical JSON of requests: the accepted fields alone, sorted keys, numbers in their shortest form."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The fields that a request may have, and the one of them that is no text.
TEXT_FIELDS, OBJECT_FIELD = ("meeting_url", "bot_name", "language", "webhook_url", "platform"), "metadata"


def number(x: float) -> str:
    """The shortest decimal form of a double, as JSON writers of the web have it: 100, 0.000001, 1e-7, 1e+21."""
    if x == 0 or not math.isfinite(x):
        return "0" if x == 0 else "null"
    digits, _, power = f"{abs(x)!r}".partition("e")
    whole, _, rest = digits.partition(".")
    figures = (whole + rest).lstrip("0")
    point = len(whole) + int(power or 0) - (len(whole + rest) - len(figures))  # of the decimal point, from the first figure
    figures = figures.rstrip("0")
    n, sign = len(figures), "-" if x < 0 else ""
    if n <= point <= 21:
        return sign + figures + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{figures[:point]}.{figures[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    return f"{sign}{figures[0]}{'.' * (n > 1)}{figures[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def text(s: str) -> str:
    out = json.dumps(s, ensure_ascii=False)
    return out if out.isascii() else "".join(f"\\u{ord(c):04x}" if 0xD800 <= ord(c) < 0xE000 else c for c in out)


def write(v) -> str:
    """A parsed value in canonical form; keys are ordered by their UTF-16 units."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{text(k)}:{write(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(write, v)) + "]"
    if isinstance(v, str):
        return text(v)
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else number(v)


def _refuse(name: str):
    raise ValueError(name)


def canonical(body: str | None) -> str | None:
    """The canonical form of a request; of repeated keys the last counts, and an optional field that is null is absent.
    Null if the text is no JSON object, or nested beyond what a parser takes."""
    try:
        v = json.loads(body, parse_int=float, parse_constant=_refuse)
        if not isinstance(v, dict):
            return None
        kept = {k: v[k] for k in TEXT_FIELDS if v.get(k) is not None}
        return write(kept | ({OBJECT_FIELD: v[OBJECT_FIELD]} if OBJECT_FIELD in v else {}))
    except (TypeError, ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_request(body: pd.Series) -> pd.Series:
    return body.map(canonical, na_action="ignore")
