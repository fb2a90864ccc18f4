"""Small number theory and sizing helpers for planning; plain Python."""

from __future__ import annotations

import math

#: Witnesses that make the test below exact for every n under 3.3 * 10**24.
_WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)


def is_prime(n: int) -> bool:
    """Exact for n under 3.3e24 (strong probable-prime test with fixed witnesses)."""
    if n < 2:
        return False
    for p in _WITNESSES:
        if n % p == 0:
            return n == p
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1

    def passes(a: int) -> bool:
        x = pow(a, odd, n)
        return x in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1))

    return all(passes(a) for a in _WITNESSES)


def next_prime(n: int, residue: int | None = None, modulus: int = 4) -> int:
    """Smallest prime >= n, with the given residue if one is named (3 mod 4 suits quadratic probing)."""
    n = max(n, 2)
    while not (is_prime(n) and (residue is None or n % modulus == residue)):
        n += 1
    return n


def inverse(a: int, m: int) -> int:
    """Multiplicative inverse of a modulo m; ValueError where there is none."""
    return pow(a, -1, m)


def power(x: int, y: int, m: int) -> int:
    return pow(x, y, m)


def gcd(a: int, b: int) -> int:
    return math.gcd(a, b)


def bloom_size(n: int, fpr: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for n keys: bits rounded up to a power of two. Advisory, as the prefilter here is exact."""
    if n < 1 or not 0 < fpr < 1:
        raise ValueError("n must be positive and fpr between 0 and 1")
    bits = 1 << math.ceil(math.log2(-n * math.log(fpr) / math.log(2) ** 2))
    return bits, max(1, math.ceil(bits / n * math.log(2)))
