"""Numeric functions Spark lacks, written as column expressions so that they stay in generated code."""

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_2PI = 1.8378770664093454836

# Coefficients of algorithm AS 241 (Wichura 1988), ascending powers.
QNORM_CENTRE = (
    [3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
QNORM_MIDDLE = (
    [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
QNORM_FAR = (
    [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)

# Rational form of the normal tail below 7.07 (Hart 1968, as given by West 2005), ascending powers.
CDF_TOP = [220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383,
           6.37396220353165, 0.700383064443688, 0.0352624965998911]
CDF_BOTTOM = [440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674,
              86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184]


def column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def polynomial(x: Column, ascending) -> Column:
    return reduce(lambda total, c: total * x + F.lit(c), reversed(ascending[:-1]), F.lit(ascending[-1]))


def qnorm(p) -> Column:
    """Normal quantile: -inf at 0, inf at 1, NULL outside [0, 1].

    The region picks the coefficients and one fold evaluates them. Written out, the three ratios make a method too
    large for the JIT compiler, which costs five times the evaluation.
    """
    p = column(p)
    q = p - 0.5
    root = F.sqrt(-F.ln(F.least(p, 1.0 - p)))

    def region(centre, middle, far):
        return F.when(F.abs(q) <= 0.425, centre).when(root <= 5.0, middle).otherwise(far)

    def fold(x, part):
        choices = [F.array(*[F.lit(c) for c in reversed(r[part])]) for r in (QNORM_CENTRE, QNORM_MIDDLE, QNORM_FAR)]
        return F.aggregate(region(*choices), F.lit(0.0), lambda total, c: total * x + c)

    argument = region(0.180625 - q * q, root - 1.6, root - 5.0)
    ratio = F.get(F.transform(F.array(argument), lambda x: fold(x, 0) / fold(x, 1)), F.lit(0))
    return (
        F.when((p < 0.0) | (p > 1.0), F.lit(None).cast("double"))
        .when(p == 0.0, F.lit(float("-inf")))
        .when(p == 1.0, F.lit(float("inf")))
        .when(F.abs(q) <= 0.425, q * ratio)
        .when(q < 0.0, -ratio)
        .otherwise(ratio)
    )


def normal_cdf(x) -> Column:
    x = column(x)
    size = F.abs(x)
    density = F.exp(-0.5 * size * size)
    near = density * polynomial(size, CDF_TOP) / polynomial(size, CDF_BOTTOM)
    fraction = reduce(lambda below, k: size + F.lit(float(k)) / below, (4, 3, 2, 1), size + 0.65)
    upper = F.when(size > 37.0, F.lit(0.0)).when(size < 7.07106781186547, near).otherwise(
        density / fraction / 2.506628274631
    )
    return F.when(x > 0.0, 1.0 - upper).otherwise(upper)


def normal_pdf(x) -> Column:
    x = column(x)
    return F.exp(-0.5 * x * x - 0.5 * LOG_2PI)


def normal_lpdf(y, mu, sigma) -> Column:
    z = (column(y) - column(mu)) / column(sigma)
    return -0.5 * z * z - F.ln(column(sigma)) - 0.5 * LOG_2PI


def inv_logit(x) -> Column:
    return 1.0 / (1.0 + F.exp(-column(x)))


def pseudo_log(x) -> Column:
    """Signed log scale: linear near 0, logarithmic far out."""
    return F.asinh(column(x) / 2.0)


def round_even(x, digits=0) -> Column:
    """Ties go to the even neighbour."""
    return F.bround(column(x), digits)


MODULUS = 2**31 - 1


def key_number(*keys, seed=0, stream="") -> Column:
    """A whole number below `MODULUS` from a hash of the key columns.

    Made once per key, not per row: `with_numbers` turns it into any number of random numbers by whole-number arithmetic.
    Unlike `rand`, a retried task yields the same numbers for the same row, whatever its partition or order.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[column(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % MODULUS


def with_numbers(df, **numbers):
    """`df` with scrambled whole numbers below `MODULUS`, one column each. numbers: name = (number column, step, ..), the
    steps being other whole numbers that tell rows and streams apart.

    Each step adds to the number and takes its fifth power, a bijection modulo this prime; all products stay below
    2 ** 62. The powers are made in columns of their own: as one expression the number would be repeated inside itself.
    """
    rounds = max(len(parts) for parts in numbers.values())
    for k in range(rounds):
        added = {}
        for name, (number, *steps) in numbers.items():
            step = steps[k] if k < len(steps) else F.lit(0)
            step = F.lit(step) if isinstance(step, int) else column(step)
            start = column(number) if k == 0 else F.col(name)
            added[name] = (start + (step % MODULUS) * (48_271 + 16_807 * k) + (12_345 if k == rounds - 1 else 0)) % MODULUS
        df = df.withColumns(added)
        df = df.withColumns({f"_{name}_2": F.col(name) * F.col(name) % MODULUS for name in numbers})
        df = df.withColumns({f"_{name}_4": F.col(f"_{name}_2") * F.col(f"_{name}_2") % MODULUS for name in numbers})
        df = df.withColumns({name: F.col(f"_{name}_4") * F.col(name) % MODULUS for name in numbers})
        df = df.drop(*[f"_{name}_{power}" for name in numbers for power in (2, 4)])
    return df


def uniform(number) -> Column:
    """A uniform number in (0, 1) from a scrambled number."""
    return (column(number) + 0.5) / float(MODULUS)


def normal(first, second) -> Column:
    """A standard normal number from two scrambled numbers (Box and Muller 1958)."""
    return F.sqrt(-2.0 * F.ln(uniform(first))) * F.cos(2.0 * math.pi * uniform(second))


def digest(*keys, seed=0, stream="") -> Column:
    """Hash text of the key columns: a repeatable random order of rows."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[column(k).cast("string") for k in keys])
    return F.md5(text.cast("binary"))
