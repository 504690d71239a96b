"""Functions that no Spark expression gives: Arrow UDFs over batches, registered as sf_<name>."""

from __future__ import annotations

import ipaddress
import json
import math
import struct

import pandas as pd
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Seed of the 32-bit hash, and its multipliers.
MURMUR_SEED = 104729
C1, C2 = 0xCC9E2D51, 0x1B873593
M32 = 0xFFFFFFFF


def murmur3_32(data: bytes, seed: int) -> int:
    def spin(x: int, r: int) -> int:
        return ((x << r) | (x >> (32 - r))) & M32

    h, whole = seed & M32, len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h = (spin(h ^ (spin(k * C1 & M32, 15) * C2 & M32), 13) * 5 + 0xE6546B64) & M32
    if tail := data[whole:]:
        h ^= spin(int.from_bytes(tail, "little") * C1 & M32, 15) * C2 & M32
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> shift)) * factor) & M32
    return h ^ (h >> 16)


def signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def chained_murmur(*texts: str) -> int:
    h = MURMUR_SEED
    for t in texts:
        h = murmur3_32(t.encode(), h)
    return signed(h, 32)


def chained_xxh3(*texts: str) -> int:
    h = 0
    for t in texts:
        h = xxhash.xxh3_64_intdigest(t.encode(), h)
    return signed(h, 64)


def xxh3_128_text(*texts: str) -> str:
    """A decimal number as text: 128 bits don't fit a Spark decimal."""
    return str(signed(xxhash.xxh3_128_intdigest("".join(texts).encode()), 128))


def iceberg_bucket(x, n: int) -> int:
    data = x.encode() if isinstance(x, str) else int(x).to_bytes(8, "little", signed=True)
    return (murmur3_32(data, 0) & 0x7FFFFFFF) % n


def grams(s: bytes, n: int) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i in range(len(s) - n + 1):
        out[s[i : i + n]] = out.get(s[i : i + n], 0) + 1
    return out


def ngram_search(haystack: str, needle: str, n: int) -> float:
    want, have = grams(needle.encode(), n), grams(haystack.encode(), n)
    total = sum(want.values())
    if n <= 0 or not total:
        return 0.0
    share = sum(min(c, have.get(g, 0)) for g, c in want.items()) / total
    return struct.unpack("f", struct.pack("f", share))[0]


def ngram_search_folded(haystack: str, needle: str, n: int) -> float:
    fold = lambda s: s.encode().lower().decode()
    return ngram_search(fold(haystack), fold(needle), n)


def address(s: str, version: int | None = None):
    try:
        a = ipaddress.ip_address(s)
    except ValueError:
        return None
    return a if version is None or a.version == version else None


def inet6_aton(s: str) -> str | None:
    """Packed bytes in hexadecimal."""
    return a.packed.hex().upper() if (a := address(s)) else None


def inet6_ntoa(h: str) -> str | None:
    try:
        return str(ipaddress.ip_address(bytes.fromhex(h)))
    except ValueError:
        return None


def is_ipv6(s: str) -> int:
    return int(address(s, 6) is not None)


def is_ipv4_compat(s: str) -> int:
    a = address(s, 6) or address(inet6_ntoa(s) or "", 6)
    return int(a is not None and int(a) >> 32 == 0 and int(a) > 1)


def is_ipv4_mapped(s: str) -> int:
    a = address(s, 6) or address(inet6_ntoa(s) or "", 6)
    return int(a is not None and a.ipv4_mapped is not None)


def holds(target, candidate) -> bool:
    """MySQL's containment: arrays hold what each element of the candidate is in, objects hold keys and values."""
    if isinstance(target, list):
        return all(any(holds(t, c) for t in target) for c in candidate) if isinstance(candidate, list) else any(holds(t, candidate) for t in target)
    if isinstance(target, dict):
        return isinstance(candidate, dict) and all(k in target and holds(target[k], v) for k, v in candidate.items())
    return type(target) is type(candidate) and target == candidate or (isinstance(target, (int, float)) and isinstance(candidate, (int, float)) and not isinstance(target, bool) and not isinstance(candidate, bool) and target == candidate)


def json_contains(target: str, candidate: str) -> bool | None:
    try:
        return holds(json.loads(target), json.loads(candidate))
    except ValueError:
        return None


def json_remove(doc: str, *paths: str) -> str | None:
    import re

    try:
        value = json.loads(doc)
    except ValueError:
        return None
    for path in paths:
        steps = [k if k else (q if q else int(i)) for k, q, i in re.findall(r"""\.([A-Za-z_]\w*)|\."([^"]*)"|\[(\d+)\]""", path)]
        at = value
        for s in steps[:-1]:
            at = at[s] if isinstance(at, dict) and s in at or isinstance(at, list) and isinstance(s, int) and s < len(at) else None
        if steps and (isinstance(at, dict) and steps[-1] in at or isinstance(at, list) and isinstance(steps[-1], int) and steps[-1] < len(at)):
            del at[steps[-1]]
    return json.dumps(value)


def seconds_of(t: str) -> float | None:
    """Seconds of a signed time text [H]HH:MM:SS[.f] or of a date and time."""
    t = t.strip()
    if " " in t or "T" in t:
        stamp = pd.to_datetime(t, errors="coerce")
        return None if pd.isna(stamp) else stamp.timestamp()
    sign, parts = (-1, t[1:].split(":")) if t.startswith("-") else (1, t.split(":"))
    try:
        h, m, s = ([0, 0] + [float(p) for p in parts])[-3:] if len(parts) != 2 else (float(parts[0]), float(parts[1]), 0)
    except ValueError:
        return None
    return sign * (h * 3600 + m * 60 + s) if m < 60 and s < 60 else None


def time_text(seconds: float) -> str:
    limit = 838 * 3600 + 59 * 60 + 59
    seconds = max(-limit, min(limit, seconds))
    whole, micros = divmod(round(abs(seconds) * 1_000_000), 1_000_000)
    return f"{'-' if seconds < 0 else ''}{whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}" + (f".{micros:06d}" if micros else "")


def timediff(a: str, b: str) -> str | None:
    x, y = seconds_of(a), seconds_of(b)
    return None if x is None or y is None else time_text(x - y)


def shift_time(sign: int):
    def shifted(a: str, b: str) -> str | None:
        x, y = seconds_of(a), seconds_of(b)
        if x is None or y is None:
            return None
        return (pd.Timestamp(a) + pd.Timedelta(seconds=sign * y)).strftime("%Y-%m-%d %H:%M:%S") if " " in a.strip() else time_text(x + sign * y)

    return shifted


def soundex(s: str) -> str:
    """MySQL's: not cut at four characters, vowels separate nothing."""
    codes = {c: d for d, cs in {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}.items() for c in cs}
    letters = [c for c in s.upper() if c.isalpha()]
    if not letters:
        return ""
    out, last = letters[0], codes.get(letters[0])
    for c in letters[1:]:
        code = codes.get(c)
        if code and code != last:
            out += code
        if code:
            last = code
    return out.ljust(4, "0")


#: name -> (function of one row, Spark type). A null argument gives null.
UDFS = {
    "murmur_hash3_32": (chained_murmur, "int"), "xx_hash3_64": (chained_xxh3, "long"), "xx_hash3_128": (xxh3_128_text, "string"),
    "__iceberg_transform_bucket": (iceberg_bucket, "int"), "ngram_search": (ngram_search, "double"), "ngram_search_case_insensitive": (ngram_search_folded, "double"),
    "inet6_aton": (inet6_aton, "string"), "inet6_ntoa": (inet6_ntoa, "string"), "is_ipv6": (is_ipv6, "int"), "is_ipv4_compat": (is_ipv4_compat, "int"), "is_ipv4_mapped": (is_ipv4_mapped, "int"),
    "json_contains": (json_contains, "boolean"), "json_remove": (json_remove, "string"),
    "timediff": (timediff, "string"), "addtime": (shift_time(1), "string"), "subtime": (shift_time(-1), "string"), "soundex_full": (soundex, "string"),
}


def vectorised(f, kind: str):
    def run(*columns: pd.Series) -> pd.Series:
        got = [None if any(v is None or v != v for v in row) else f(*(v.item() if hasattr(v, "item") else v for v in row)) for row in zip(*columns)]
        return pd.Series(got, dtype=object)

    import inspect

    count = len(inspect.signature(f).parameters)
    variadic = any(p.kind is inspect.Parameter.VAR_POSITIONAL for p in inspect.signature(f).parameters.values())
    if variadic or count == 0:

        def apply(*args: pd.Series) -> pd.Series:
            return run(*args)
    elif count == 1:

        def apply(a: pd.Series) -> pd.Series:
            return run(a)
    elif count == 2:

        def apply(a: pd.Series, b: pd.Series) -> pd.Series:
            return run(a, b)
    else:

        def apply(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return run(a, b, c)

    return F.pandas_udf(apply, kind)


def weighted_percentile(x: pd.Series, w: pd.Series, p: float) -> float | None:
    """Each value is a centroid of its whole weight, centred on its share; linear between centres."""
    rows = pd.DataFrame({"x": pd.to_numeric(x), "w": pd.to_numeric(w)}).dropna()
    rows["w"] = rows["w"].astype(float).map(math.trunc)
    rows = rows[rows.w >= 1].sort_values(["x", "w"])
    if rows.empty:
        return None
    total = rows.w.sum()
    centre = (rows.w.cumsum() - rows.w / 2).to_numpy()
    import numpy as np

    return float(np.interp(p * total, centre, rows.x.to_numpy(float)))


def mann_whitney(x: pd.Series, index: pd.Series, alternative: str = "two-sided", correct: bool = True) -> str | None:
    rows = pd.DataFrame({"x": pd.to_numeric(x), "i": index}).dropna()
    if rows.empty:
        return None
    on = rows.i.astype(bool)
    n1, n2 = int((~on).sum()), int(on.sum())
    if not n1 or not n2:
        return json.dumps({"Error": "Both samples must have numbers."})
    if rows.x.nunique() == 1:
        return json.dumps({"Error": "All numbers in both samples are identical."})
    ranks = rows.x.rank()
    u = float(ranks[~on].sum() - n1 * (n1 + 1) / 2)
    n, ties = n1 + n2, rows.x.value_counts()
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - float((ties**3 - ties).sum()) / (n * (n - 1))))
    mean = n1 * n2 / 2
    d = {"two-sided": abs(u - mean), "greater": u - mean, "less": mean - u}[alternative.lower()]
    z = (d - (0.5 if correct else 0)) / sd
    p = 0.5 * math.erfc(z / math.sqrt(2))
    return json.dumps([u, min(1.0, 2 * p) if alternative.lower() == "two-sided" else p])


def register(spark: SparkSession) -> None:
    for name, (f, kind) in UDFS.items():
        spark.udf.register(f"sf_{name}", vectorised(f, kind))

    @F.pandas_udf("string")
    def mann_whitney_u_test(x: pd.Series, i: pd.Series) -> str:
        return mann_whitney(x, i)

    spark.udf.register("mann_whitney_u_test", mann_whitney_u_test)
