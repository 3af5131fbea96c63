"""Student-t quantiles for a column of degrees of freedom."""

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import column

TABLE_SIZE = 200


def _expansion(z, df):
    """Cornish-Fisher expansion about the normal quantile; works on floats and on columns."""
    z2 = z * z
    terms = (
        z * (z2 + 1) / 4,
        z * ((5 * z2 + 16) * z2 + 3) / 96,
        z * (((3 * z2 + 19) * z2 + 17) * z2 - 15) / 384,
        z * ((((79 * z2 + 776) * z2 + 1482) * z2 - 1920) * z2 - 945) / 92160,
    )
    total = z
    for power, term in enumerate(terms, start=1):
        total = total + term / df**power
    return total


@lru_cache(maxsize=32)
def quantile_table(probability: float) -> tuple:
    """Quantiles for 1..TABLE_SIZE degrees of freedom; depends on the probability only, never on data."""
    nodes, weights = np.polynomial.legendre.leggauss(120)
    z = NormalDist().inv_cdf(probability)
    found = [math.tan(math.pi * (probability - 0.5)), (2 * probability - 1) / math.sqrt(2 * probability * (1 - probability))]
    for df in range(3, TABLE_SIZE + 1):
        scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
        t = _expansion(z, df)
        for _ in range(20):
            angle = math.atan(t / math.sqrt(df))
            area = scale * 0.5 * angle * float(weights @ np.cos(0.5 * angle * (nodes + 1)) ** (df - 1))
            density = scale / math.sqrt(df) * (1 + t * t / df) ** (-(df + 1) / 2)
            step = (0.5 + area - probability) / density
            t -= step
            if abs(step) < 1e-13:
                break
        found.append(t)
    return tuple(found)


def t_quantile(df, probability: float) -> Column:
    """NULL below one degree of freedom."""
    df = column(df).cast("double")
    table = F.array(*[F.lit(q) for q in quantile_table(probability)])
    beyond = _expansion(F.lit(NormalDist().inv_cdf(probability)), df)
    place = F.greatest(F.least(df, F.lit(float(TABLE_SIZE))), F.lit(1.0)).cast("int")
    return F.when(df.between(1, TABLE_SIZE), F.element_at(table, place)).when(df > TABLE_SIZE, beyond)
