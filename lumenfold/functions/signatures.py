"""Ed25519 signatures (RFC 8032) of single messages, in plain integers.

Meant for ledgers of few thousand events: one signature takes milliseconds and
runs inside a task, beside the row it signs.
"""

from __future__ import annotations

import hashlib

#: Fixed values of the curve: the field, the order of the base point, the constant, a root of -1 and the base point's y.
FIELD = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
CURVE = -121665 * pow(121666, -1, FIELD) % FIELD
ROOT = pow(2, (FIELD - 1) // 4, FIELD)
BASE_Y = 4 * pow(5, -1, FIELD) % FIELD


def _recover(y: int, odd: int) -> int | None:
    """x of a point on the curve, or None if y belongs to none."""
    square = (y * y - 1) * pow(CURVE * y * y + 1, -1, FIELD) % FIELD
    x = pow(square, (FIELD + 3) // 8, FIELD)
    if (x * x - square) % FIELD:
        x = x * ROOT % FIELD
    if (x * x - square) % FIELD or (x == 0 and odd):
        return None
    return x if x & 1 == odd else FIELD - x


#: Points as (X, Y, Z, T) with x = X / Z, y = Y / Z and x y = T / Z.
IDENTITY = (0, 1, 1, 0)


def _point(x: int, y: int):
    return x, y, 1, x * y % FIELD


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]), (p[1] + p[0]) * (q[1] + q[0])
    c, d = 2 * p[3] * q[3] * CURVE, 2 * p[2] * q[2]
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % FIELD, g * h % FIELD, f * g % FIELD, e * h % FIELD


def _times(n: int, p):
    out = IDENTITY
    for bit in bin(n)[2:]:
        out = _add(out, out)
        if bit == "1":
            out = _add(out, p)
    return out


BASE = _point(_recover(BASE_Y, 0), BASE_Y)


def _pack(p) -> bytes:
    z = pow(p[2], -1, FIELD)
    return (p[1] * z % FIELD | (p[0] * z % FIELD & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes):
    n = int.from_bytes(data, "little")
    y, odd = n & (1 << 255) - 1, n >> 255
    x = _recover(y, odd) if y < FIELD else None
    return None if x is None else _point(x, y)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def _secret(key: bytes) -> tuple[int, bytes]:
    if len(key) != 32:
        raise ValueError("a secret key has 32 bytes")
    h = hashlib.sha512(key).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(key: bytes) -> bytes:
    return _pack(_times(_secret(key)[0], BASE))


def sign(key: bytes, message: bytes) -> bytes:
    a, prefix = _secret(key)
    r = _number(prefix, message)
    point = _pack(_times(r, BASE))
    return point + ((r + _number(point, _pack(_times(a, BASE)), message) * a) % ORDER).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    left, right = _times(s, BASE), _add(r, _times(_number(signature[:32], public, message), a))
    return (left[0] * right[2] - right[0] * left[2]) % FIELD == 0 and (left[1] * right[2] - right[1] * left[2]) % FIELD == 0
