"""Characteristic polynomials of whole symmetric matrices, exactly, and their real roots and null spaces to many digits.

The polynomial is found modulo primes, by reduction to Hessenberg form, and put together by Chinese remainders. All its
roots are real, so the number of roots above a point is the number of sign changes in the coefficients around that point
(Descartes' rule, exact here, multiple roots counted as often), which isolates roots without rounding.
"""

from __future__ import annotations

import math
from decimal import Context, Decimal, localcontext

import numpy as np

#: Primes lie below this, so that a product of two residues fits 64 bits.
TOP = 1 << 31
#: Bits to which a root is told relative to its size, and digits of the arithmetic of null spaces.
BITS, DIGITS = 160, 90


def _prime(n: int) -> bool:
    """Miller-Rabin; these bases decide all n below 3,215,031,751."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for b in (2, 3, 5, 7):
        x = pow(b, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below TOP whose product has more than so many bits."""
    out: list[int] = []
    n, have = TOP - 1, 0.0
    while have <= bits:
        if _prime(n):
            out.append(n)
            have += math.log2(n)
        n -= 2
    return out


def coefficient_bits(matrix: list[list[int]]) -> int:
    """Bits that hold any coefficient, with sign, of a matrix without negative eigenvalues: they are at most those of equal eigenvalues."""
    d, trace = len(matrix), sum(matrix[k][k] for k in range(len(matrix)))
    mean = math.log2(trace // d + 1) + 1 if d else 0
    return int(max((math.log2(math.comb(d, k)) + k * mean for k in range(d + 1)), default=0)) + 3


def modular_polynomials(matrix: list[list[int]], moduli: list[int]) -> np.ndarray:
    """A row of coefficients (constant first) modulo each prime, all primes at once."""
    d, p = len(matrix), np.array(moduli, dtype=np.int64)
    h = np.array([[[v % m for v in row] for row in matrix] for m in moduli], dtype=np.int64).reshape(len(moduli), d, d)
    each, p1, p2 = np.arange(len(moduli)), p[:, None], p[:, None, None]
    for m in range(1, d - 1):
        below = h[:, m:, m - 1] != 0
        pivot = m + below.argmax(axis=1)
        h[each, m], h[each, pivot] = h[each, pivot], h[each, m].copy()
        h[each, :, m], h[each, :, pivot] = h[each, :, pivot], h[each, :, m].copy()
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(h[:, m, m - 1], p, strict=True)], dtype=np.int64)
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % p1
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, m : m + 1] % p2) % p2
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % p2).sum(axis=2)) % p1
    found = np.zeros((d + 1, len(moduli), d + 1), dtype=np.int64)
    found[0, :, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros((len(moduli), d + 1), dtype=np.int64)
        new[:, 1:] = found[k - 1][:, :-1]
        new = (new - h[:, k - 1, k - 1][:, None] * found[k - 1] % p1) % p1
        chain = np.ones(len(moduli), dtype=np.int64)
        for i in range(k - 1, 0, -1):
            chain = chain * h[:, i, i - 1] % p
            new = (new - (h[:, i - 1, k - 1] * chain % p)[:, None] * found[i - 1] % p1) % p1
        found[k] = new
    return found[d]


def remaindered(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The coefficients that have these residues modulo these primes, the nearest to 0."""
    product, value = 1, [0] * (len(residues[0][1]) if residues else 1)
    for p, row in residues:
        inverse = pow(product % p, -1, p)
        value = [v + product * ((r - v) * inverse % p) for v, r in zip(value, row, strict=True)]
        product *= p
    return [v - product if 2 * v > product else v for v in value]


def roots_above(poly: list[int], at: int, power: int) -> int:
    """Roots above at * 2**power of a polynomial (constant first) of real roots, multiple ones counted as often."""
    d = len(poly) - 1
    c = [v << (power * k) for k, v in enumerate(poly)] if power >= 0 else [v << (-power * (d - k)) for k, v in enumerate(poly)]
    if at:
        for k in range(d):
            for j in range(d - 1, k - 1, -1):
                c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def isolated(poly: list[int], most: int) -> list[tuple[int, int, int, int]]:
    """(number, low, power, n): the largest positive roots, from the largest down, `most` at least if there are so many.

    n roots, the first of them `number` (from 1), lie above low and up to low + 1, times 2**power. n is 1, unless several are
    equal or within 2**-BITS of their size.
    """
    d = len(poly) - 1
    if d < 1:
        return []
    # Fujiwara's bound, in bits
    power = 1 + max(-(-(-(-abs(poly[d - k]) // abs(poly[d]))).bit_length() // k) for k in range(1, d + 1))
    while power > 0 and roots_above(poly, 1, power - 1) == 0:
        power -= 1
    total = roots_above(poly, 0, 0)
    out: list[tuple[int, int, int, int]] = []
    # intervals from the largest down: (low, power, roots above its upper end, roots above its lower end)
    todo = [(0, power, 0, total)]
    while todo:
        low, e, above, upto = todo.pop()
        if above == upto or above >= most:
            continue
        if low and (upto - above == 1 or low.bit_length() > BITS):
            out.append((above + 1, low, e, upto - above))
            continue
        middle = roots_above(poly, 2 * low + 1, e - 1)
        todo += [(2 * low, e - 1, middle, upto), (2 * low + 1, e - 1, above, middle)]
    return sorted(out)


def _sign(poly: list[int], at: int, power: int) -> int:
    """The sign at at * 2**power."""
    d, v = len(poly) - 1, 0
    for k in range(d, -1, -1):
        v = v * at + (poly[k] << (max(0, power) * k + max(0, -power) * (d - k)))
    return (v > 0) - (v < 0)


def refined(poly: list[int], low: int, power: int, n: int) -> tuple[int, int]:
    """(low, power) of an interval around the same root, or the same equal roots, with BITS bits.

    Steps of Newton's rule are taken where signs prove them, with twice as many new bits after each; else the interval is halved.
    """
    if n > 1:
        return low, power
    upper = _sign(poly, low + 1, power)
    if upper == 0:  # the root is the upper end itself
        shift = max(0, BITS - low.bit_length())
        return ((low + 1) << shift) - 1, power - shift
    slope = [k * v for k, v in enumerate(poly)][1:]
    gain = 2
    while low.bit_length() < BITS:
        # twice as many new bits after each success
        a, e = (2 * low + 1) << gain, power - 1 - gain
        f, g = _value(poly, a, e), _value(slope, a, e)
        guess = a - (f[0] << max(0, f[1] - g[1] - e)) // (g[0] << max(0, -(f[1] - g[1] - e))) if g[0] else a
        down = guess - 1
        inside = (low << (1 + gain)) <= down and down + 2 <= ((low + 1) << (1 + gain))
        if inside and (s := _sign(poly, down + 2, e)) * upper > 0 and _sign(poly, down, e) * upper < 0:
            # two neighbours hold it: halve once
            middle = _sign(poly, down + 1, e)
            low, power = (down, e) if middle * s >= 0 else (down + 1, e)
            if middle == 0:
                shift = max(0, BITS - low.bit_length())
                return ((down + 1) << shift) - 1, e - shift
            gain = min(2 * gain, BITS)
        else:
            middle = _sign(poly, 2 * low + 1, power - 1)
            if middle == 0:
                shift = max(0, BITS - low.bit_length())
                return ((2 * low + 1) << shift) - 1, power - 1 - shift
            low, power = (2 * low, power - 1) if middle * upper > 0 else (2 * low + 1, power - 1)
            gain = max(2, gain // 2)
    return low, power


def _value(poly: list[int], at: int, power: int) -> tuple[int, int]:
    """(v, e): the value v * 2**e at at * 2**power, exactly."""
    d, v = len(poly) - 1, 0
    for k in range(d, -1, -1):
        v = v * at + (poly[k] << (max(0, power) * k + max(0, -power) * (d - k)))
    return v, -max(0, -power) * d


def null_space(matrix: list[list[int]], low: int, power: int, n: int) -> tuple[Decimal, list[list[float]]]:
    """The root as a number and n unit vectors, at right angles to each other, that matrix - root takes to 0: inverse iteration from
    fixed starts, n at a time, with DIGITS digits."""
    d = len(matrix)
    with localcontext(Context(prec=DIGITS)):
        root = (Decimal(low) + Decimal("0.5")) * Decimal(2) ** power
        a = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object)
        a[np.arange(d), np.arange(d)] -= root
        tiny = max(abs(root), Decimal(1)) * Decimal(10) ** -(DIGITS - 10)
        order = np.arange(d)
        for k in range(d):
            pivot = k + int(np.argmax(np.abs(a[k:, k])))
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1 :, k] /= a[k, k]
                a[k + 1 :, k + 1 :] -= a[k + 1 :, k][:, None] * a[k, k + 1 :][None, :]
        v = [np.array([Decimal(1 + (i * (2 * j + 7) + j) % 11) / 16 for i in range(d)], dtype=object) for j in range(n)]
        for _ in range(3):
            for j in range(n):
                x = v[j][order]
                for k in range(1, d):
                    x[k] -= a[k, :k] @ x[:k]
                for k in range(d - 1, -1, -1):
                    x[k] = (x[k] - (a[k, k + 1 :] @ x[k + 1 :] if k + 1 < d else 0)) / a[k, k]
                x = x / max(abs(e) for e in x)
                for w in v[:j]:
                    x = x - w * (w @ x)
                v[j] = x / (x @ x).sqrt()
        return root, [[float(e) for e in x] for x in v]
