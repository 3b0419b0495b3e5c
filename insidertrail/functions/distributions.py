"""The normal distribution and its quantile as native expressions, which Spark lacks."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximations of the normal distribution in its middle part (Hart 1968), highest power first.
CENTRE = ((3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
         220.206867912376),
        (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
         793.826512519948, 440.413735824752))
CENTRE_END = 5.0
# Rational approximations of the normal quantile (Wichura 1988, AS 241): around the middle, in the tails, far out.
MIDDLE = ((2.50908092873012267270e3, 3.34305755835881281050e4, 6.72657709270087008530e4, 4.59219539315498714570e4,
           1.37316937655094611250e4, 1.97159095030655144270e3, 1.33141667891784377450e2, 3.38713287279636660800e0),
          (5.22649527885285456100e3, 2.87290857357219426740e4, 3.93078958000927106100e4, 2.12137943015865958670e4,
           5.39419602142475110770e3, 6.87187007492057908300e2, 4.23133307016009112520e1, 1.0))
SIDE = ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
         3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
        (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
         6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0))
FAR = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
        2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
       (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
        1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0))


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def _ratio(x: Column, pair: tuple) -> Column:
    return _polynomial(x, pair[0]) / _polynomial(x, pair[1])


def _of(x: Column | str, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is worked out once, however often the function names it."""
    return F.transform(F.array(F.col(x) if isinstance(x, str) else x), function)[0]


def _cdf(z: Column) -> Column:
    x = F.abs(z)
    fraction = x  # of Laplace, whose 20 steps are exact to the last digits from five deviations on
    for k in range(20, 0, -1):
        fraction = x + float(k) / fraction
    outer = F.lit(1.0) / fraction / math.sqrt(2 * math.pi)
    side = F.when(x > 37, F.lit(0.0)).otherwise(F.exp(-x * x / 2) * F.when(x < CENTRE_END, _ratio(x, CENTRE)).otherwise(outer))
    return F.when(~F.isnan(z), F.when(z > 0, 1 - side).otherwise(side))


def _quantile(p: Column) -> Column:
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    side = F.when(r <= 5, _of(r - 1.6, lambda x: _ratio(x, SIDE))).otherwise(_of(r - 5, lambda x: _ratio(x, FAR)))
    z = F.when(F.abs(q) <= 0.425, q * _of(0.180625 - q * q, lambda x: _ratio(x, MIDDLE))).when(q < 0, -side).otherwise(side)
    return F.when((p > 0) & (p < 1), z)


def normal_cdf(z: Column | str) -> Column:
    """P(Z <= z) to about 15 digits of the smaller side; null for null and NaN."""
    return _of(z, _cdf)


def normal_quantile(p: Column | str) -> Column:
    """z with P(Z <= z) = p, to about 16 digits; null unless 0 < p < 1."""
    return _of(p, _quantile)
