"""The trailer that seals a segment: BLAKE2b digest, and an EdDSA signature over Curve25519 with BLAKE2b."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from dataclasses import dataclass

MAGIC, SIZE = bytes.fromhex("46534947"), 200
CLEAN, SALVAGE = 0, 1
REASONS = {0: "none", 1: "partial_frame", 2: "chain_fail", 3: "crc_fail", 4: "missing_trailer", 5: "no_records"}

_P, _L = 2**255 - 19, 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_I = pow(2, (_P - 1) // 4, _P)


def _x(y: int, sign: int) -> int | None:
    if y >= _P:
        return None
    xx = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(xx, (_P + 3) // 8, _P)
    if (x * x - xx) % _P:
        x = x * _I % _P
    if (x * x - xx) % _P or (x == 0 and sign):
        return None
    return _P - x if x % 2 != sign else x


_BY = 4 * pow(5, -1, _P) % _P
_BASE = (_x(_BY, 0), _BY, 1, _x(_BY, 0) * _BY % _P)


def _add(p: tuple, q: tuple) -> tuple:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(k: int, p: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _add(out, p)
        p, k = _add(p, p), k >> 1
    return out


def _pack(p: tuple) -> bytes:
    z = pow(p[2], -1, _P)
    return (p[1] * z % _P | (p[0] * z % _P & 1) << 255).to_bytes(32, "little")


def _unpack(b: bytes) -> tuple | None:
    y = int.from_bytes(b, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    x = _x(y, sign)
    return None if x is None else (x, y, 1, x * y % _P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes, bytes]:
    h = hashlib.blake2b(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:], _pack(_times(a, _BASE))


def sign(seed: bytes, message: bytes) -> tuple[bytes, bytes]:
    """(public key, signature)"""
    a, prefix, public = _secret(seed)
    r = _hash(prefix, message) % _L
    big_r = _pack(_times(r, _BASE))
    return public, big_r + ((r + _hash(big_r, public, message) * a) % _L).to_bytes(32, "little")


def check(public: bytes, signature: bytes, message: bytes) -> bool:
    a, r, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    k = _hash(signature[:32], public, message) % _L
    return _pack(_times(s, _BASE)) == _pack(_add(r, _times(k, a)))


def key_id(public: bytes) -> bytes:
    return hashlib.blake2b(public, digest_size=32).digest()[:8]


def message(signed_length: int, digest: bytes, tip: bytes, mode: int) -> bytes:
    return struct.pack("<IBQ", 1, 2, signed_length) + digest + tip + bytes([mode])


@dataclass
class Seal:
    mode: int
    reason: int
    signed_length: int
    records: int
    tip: bytes
    digest: bytes
    public: bytes
    signature: bytes


def trailer(signed_length: int, records: int, tip: bytes, digest: bytes, mode: int = CLEAN, reason: int = 0, seed: bytes | None = None) -> bytes:
    """200 bytes. The key lives for this seal only unless a seed is given: the seal shows that nothing was changed, not by whom it was made."""
    public, signature = sign(seed or os.urandom(32), message(signed_length, digest, tip, mode))
    body = MAGIC + bytes([1, 1, 2, mode, reason if mode else 0, 0, 0, 0]) + struct.pack("<QQ", signed_length, records) + tip + digest + public + signature + key_id(public)
    return body + struct.pack("<I", zlib.crc32(body))


def parse(b: bytes) -> Seal | None:
    """The trailer in these 200 bytes, if they are one."""
    if len(b) != SIZE or b[:4] != MAGIC or b[4:7] != bytes([1, 1, 2]) or struct.unpack("<I", b[196:])[0] != zlib.crc32(b[:196]):
        return None
    n, records = struct.unpack_from("<QQ", b, 12)
    return Seal(b[7], b[8], n, records, b[28:60], b[60:92], b[92:124], b[124:188])


def verified(seal: Seal, digest: bytes) -> bool:
    return seal.digest == digest and check(seal.public, seal.signature, message(seal.signed_length, digest, seal.tip, seal.mode))
