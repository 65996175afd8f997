"""Scalar functions and small numeric tools."""

import math

from pyspark.sql import Column, functions as F

BUCKET_SEED = 11451


def laplace(u: Column, scale) -> Column:
    """Laplace noise by the inverse distribution, of u in (0, 1)."""
    return -F.lit(float(scale)) * F.signum(u - 0.5) * F.log(F.lit(1.0) - 2 * F.abs(u - 0.5))


def hash_uniform(*cols, seed=17) -> Column:
    """A number in [0, 1) by md5, so that any SQL engine can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def prefix(key: Column, n: int) -> Column:
    return F.substring(key, 1, n)


def geometric_pmf(z: int, epsilon: float):
    """The two-sided geometric distribution cut to 0..z around z/2, summing to 1."""
    a = math.exp(-epsilon)
    w = [a ** abs(i - z / 2) for i in range(z + 1)]
    return [x / sum(w) for x in w]


def geometric_weights(z: int, epsilon: float):
    """The weights that loads are drawn with: from the middle on, step i multiplies by a to the power of i, so they fall faster than a geometric series and do not sum to 1."""
    a, half = math.exp(-epsilon), z // 2
    middle = (1 - a) / (1 + a - 2 * a ** (half + 1))
    return [middle * a ** (abs(i - half) * (abs(i - half) + 1) // 2) for i in range(z + 1)]


def align(size: int, unit: int = 16):
    """(size rounded down, size rounded up) to a multiple of the unit."""
    return size // unit * unit, -(-size // unit) * unit


def bin_factor(capacity: int, bin_capacity: int, lam: int):
    """How many bins a bucket is spread over: 2 * capacity / (bin_capacity * (1 - 1 / ln(lambda)^2))."""
    return 2 * capacity / (bin_capacity * (1 - math.log(lam) ** -2))


def convolve(p, times: int):
    """Distribution of the sum of `times` independent draws."""
    out = [1.0]
    for _ in range(times):
        nxt = [0.0] * (len(out) + len(p) - 1)
        for i, x in enumerate(out):
            for j, y in enumerate(p):
                nxt[i + j] += x * y
        out = nxt
    return out


def level_schedule(k: int, inserts: int):
    """Landing level and batches per level after each insert, by the k-binomial counters: level i holds C(D[i], i+1) batches."""
    d, held, out = [*range(k), None], [0] * k, []
    for _ in range(inserts):
        d[0] += 1
        i, moved = 0, 1
        while i + 1 < k and d[i] == d[i + 1]:
            d[i + 1] += 1
            moved += held[i]
            held[i], d[i] = 0, i
            i += 1
        held[i] += moved
        out.append((i, list(held)))
    return out


def stationary(matrix, tolerance=1e-6):
    """Rows of a stochastic matrix multiplied until they agree."""
    m, n = [list(r) for r in matrix], len(matrix)
    for _ in range(200):
        m = [[sum(m[i][k] * m[k][j] for k in range(n)) for j in range(n)] for i in range(n)]
        if max(abs(m[0][j] - m[i][j]) for i in range(n) for j in range(n)) < tolerance:
            break
    return m[0]


def histogram_bounds(limit=2**64):
    """Upper bounds of histogram buckets: 1, 2, then each 1.5 times the one before, cut to its two leading digits."""
    out, x = [1, 2], 2.0
    while x * 1.5 <= limit:
        x *= 1.5
        n = int(x)
        unit = 10 ** max(0, len(str(n)) - 2)
        if n // unit == 10 and unit > 1:  # a leading 10 keeps three digits
            unit //= 10
        out.append(n // unit * unit)
    return out


def bucket_index(value: Column, bounds) -> Column:
    """Number of bounds below the value, at most the last index: a balanced tree of comparisons, inside generated code."""
    if len(bounds) == 1:
        return F.lit(0)

    def tree(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds) - 1)


# Multiplier and shift of the 64-bit murmur mix.
MIX, SHIFT = 0xC6A4A7935BD1E995, 47


def _signed(n):
    return n - 2**64 if n >= 2**63 else n


def wrapping_multiply(x: Column, by: int) -> Column:
    """x * by modulo 2^64 as a signed long, through decimals of 32-bit halves, so that nothing overflows."""
    low = x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(10,0)")
    high = F.shiftrightunsigned(x, 32).cast("decimal(10,0)")
    dec = lambda n, w: F.lit(str(n)).cast(f"decimal({w},0)")
    carry = ((high * dec(by & 0xFFFFFFFF, 10)) % dec(2**32, 10)).cast("decimal(10,0)")
    total = ((low * dec(by, 20)).cast("decimal(36,0)") + (carry * dec(2**32, 10)).cast("decimal(36,0)")) % dec(2**64, 20)
    return F.when(total >= dec(2**63, 20), total - dec(2**64, 20)).otherwise(total).cast("long")


def pairing(a: Column, b: Column) -> Column:
    """The Cantor pairing of two numbers, their sum held to 32 bits."""
    s = (a.bitwiseAND(F.lit(0xFFFFFFFF)) + b).bitwiseAND(F.lit(0xFFFFFFFF))
    half = F.when(s % 2 == 0, F.shiftright(s, 1) * (s + 1)).otherwise(s * F.shiftright(s + 1, 1))
    return half + b


def bucket_id(df, level: str, bucket: str, replica: str, out: str, seed=BUCKET_SEED):
    """Add the hexadecimal name of a bucket's replica: the 64-bit mix of the paired numbers; a mix of 0 is named '0'."""
    fold = lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, SHIFT))
    h, steps = F.col("_h"), df.withColumn("_h", pairing(pairing(F.col(level).cast("long"), F.col(bucket).cast("long")), F.col(replica).cast("long")))
    steps = steps.withColumn("_h", wrapping_multiply(h, MIX)).withColumn("_h", fold(h)).withColumn("_h", wrapping_multiply(h, MIX))
    steps = steps.withColumn("_h", wrapping_multiply(h.bitwiseXOR(F.lit(_signed(seed ^ MIX))), MIX)).withColumn("_h", fold(h))
    return steps.withColumn("_h", wrapping_multiply(h, MIX)).withColumn(out, F.lower(F.hex(fold(h)))).drop("_h")


def bin_capacity(capacity: int, bins: int, epsilon: float, delta: float, limit=4096):
    """Smallest even z for which `bins` truncated geometric loads fill a bucket of `capacity` but with probability delta."""
    for z in range(2, limit + 1, 2):
        if sum(convolve(geometric_pmf(z, epsilon), bins)[:capacity]) <= delta:
            return z
    raise ValueError("no bin capacity up to the limit")
