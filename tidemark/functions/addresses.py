"""Bech32 text of raw addresses, as published in BIP 173, for the edge of the system."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import functions as F

# fixed values of the format
_CHARSET = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def _checksum(values: Iterable[int]) -> int:
    chk = 1
    for v in values:
        top, chk = chk >> 25, (chk & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(_GENERATOR):
            if top >> i & 1:
                chk ^= g
    return chk


def _prefix(name: str) -> list[int]:
    return [ord(c) >> 5 for c in name] + [0] + [ord(c) & 31 for c in name]


def _regroup(data: Iterable[int], have: int, want: int, pad: bool) -> list[int] | None:
    """Bits in groups of `have` as groups of `want`; None if bits other than zero are left over."""
    bits = size = 0
    out = []
    for v in data:
        bits, size = bits << have | v, size + have
        while size >= want:
            size -= want
            out.append(bits >> size & (1 << want) - 1)
    rest = bits & (1 << size) - 1
    if pad:
        return out + [rest << want - size] if size else out
    return None if rest or size >= have else out


def encode(name: str, raw: bytes) -> str:
    data = _regroup(raw, 8, 5, True)
    check = _checksum([*_prefix(name), *data, 0, 0, 0, 0, 0, 0]) ^ 1
    return name + "1" + "".join(_CHARSET[v] for v in data + [check >> 5 * (5 - i) & 31 for i in range(6)])


def decode(text: str | None) -> tuple[str, bytes] | None:
    """(prefix, raw bytes), or None if the text is no valid address."""
    if not text or text not in (text.lower(), text.upper()) or not 0 < text.rfind("1") < len(text) - 6:
        return None
    text = text.lower()
    name, _, body = text.rpartition("1")
    if any(c not in _CHARSET for c in body) or any(not 33 <= ord(c) <= 126 for c in name):
        return None
    values = [_CHARSET.index(c) for c in body]
    if _checksum(_prefix(name) + values) != 1:
        return None
    raw = _regroup(values[:-6], 5, 8, False)
    return None if raw is None else (name, bytes(raw))


def encoder(name: str):
    """A column function: binary to text."""

    @F.pandas_udf("string")
    def to_text(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else encode(name, bytes(b)))

    return to_text


def decoder():
    """A column function: text to binary, null for what is not valid."""

    @F.pandas_udf("binary")
    def to_raw(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if (found := decode(t)) is None else found[1])

    return to_raw
