"""The universal thermal climate index by its published regression polynomial (Bröde et al., Int. J. Biometeorol. 2012)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .comfort import vapour_pressure

# Coefficients of pa^p · d^q · v^r · t^s, of all powers with p + q + r + s <= 6, s counting fastest, then r, q and p (pa in kPa, d = mean radiant less air temperature, v in m/s, t in °C).
COEFFICIENTS = np.array("""
0.607562052 -0.0227712343 8.06470249e-4 -1.54271372e-4 -3.24651735e-6 7.32602852e-8 1.35959073e-9 -2.25836520 0.0880326035 0.00216844454 -1.53347087e-5 -5.72983704e-7 -2.55090145e-9 -0.751269505 -0.00408350271 -5.21670675e-5 1.94544667e-6 1.14099531e-8
0.158137256 -6.57263143e-5 2.22697524e-7 -4.16117031e-8 -0.0127762753 9.66891875e-6 2.52785852e-9 4.56306672e-4 -1.74202546e-7 -5.91491269e-6
0.398374029 1.83945314e-4 -1.73754510e-4 -7.60781159e-7 3.77830287e-8 5.43079673e-10 -0.0200518269 8.92859837e-4 3.45433048e-6 -3.77925774e-7 -1.69699377e-9 1.69992415e-4 -4.99204314e-5 2.47417178e-7 1.07596466e-8 8.49242932e-5 1.35191328e-6 -6.21531254e-9 -4.99410301e-6 -1.89489258e-8 8.15300114e-8
7.55043090e-4 -5.65095215e-5 -4.52166564e-7 2.46688878e-8 2.42674348e-10 1.54547250e-4 5.24110970e-6 -8.75874982e-8 -1.50743064e-9 -1.56236307e-5 -1.33895614e-7 2.49709824e-9 6.51711721e-7 1.94960053e-9 -1.00361113e-8
-1.21206673e-5 -2.18203660e-7 7.51269482e-9 9.79063848e-11 1.25006734e-6 -1.81584736e-9 -3.52197671e-10 -3.36514630e-8 1.35908359e-10 4.17032620e-10 -1.30369025e-9 4.13908461e-10 9.22652254e-12 -5.08220384e-9 -2.24730961e-11 1.17139133e-10 6.62154879e-10 4.03863260e-13 1.95087203e-12 -4.73602469e-12
5.12733497 -0.312788561 -0.0196701861 9.99690870e-4 9.51738512e-6 -4.66426341e-7 0.548050612 -0.00330552823 -0.00164119440 -5.16670694e-6 9.52692432e-7 -0.0429223622 0.00500845667 1.00601257e-6 -1.81748644e-6 -1.25813502e-3 -1.79330391e-4 2.34994441e-6 1.29735808e-4 1.29064870e-6 -2.28558686e-6
-0.0369476348 0.00162325322 -3.14279680e-5 2.59835559e-6 -4.77136523e-8 8.64203390e-3 -6.87405181e-4 -9.13863872e-6 5.15916806e-7 -3.59217476e-5 3.28696511e-5 -7.10542454e-7 -1.24382300e-5 -7.38584400e-9 2.20609296e-7
-7.32469180e-4 -1.87381964e-5 4.80925239e-6 -8.75492040e-8 2.77862930e-5 -5.06004592e-6 1.14325367e-7 2.53016723e-6 -1.72857035e-8 -3.95079398e-8 -3.59413173e-7 7.04388046e-7 -1.89309167e-8 -4.79768731e-7 7.96079978e-9 1.62897058e-9 3.94367674e-8 -1.18566247e-9 3.34678041e-10 -1.15606447e-10
-2.80626406 0.548712484 -0.00399428410 -9.54009191e-4 1.93090978e-5 -0.308806365 0.0116952364 4.95271903e-4 -1.90710882e-5 0.00210787756 -6.98445738e-4 2.30109073e-5 4.17856590e-4 -1.27043871e-5 -3.04620472e-6
0.0514507424 -0.00432510997 8.99281156e-5 -7.14663943e-7 -2.66016305e-4 2.63789586e-4 -7.01199003e-6 -1.06823306e-4 3.61341136e-6 2.29748967e-7 3.04788893e-4 -6.42070836e-5 1.16257971e-6 7.68023384e-6 -5.47446896e-7 -3.59937910e-8 -4.36497725e-6 1.68737969e-7 2.67489271e-8 3.23926897e-9
-0.0353874123 -0.221201190 0.0155126038 -2.63917279e-4 0.0453433455 -0.00432943862 1.45389826e-4 2.17508610e-4 -6.66724702e-5 3.33217140e-5 -0.00226921615 3.80261982e-4 -5.45314314e-9 -7.96355448e-4 2.53458034e-5 -6.31223658e-6 3.02122035e-4 -4.77403547e-6 1.73825715e-6 -4.09087898e-7
0.614155345 -0.0616755931 0.00133374846 0.00355375387 -5.13027851e-4 1.02449757e-4 -0.00148526421 -4.11469183e-5 -6.80434415e-6 -9.77675906e-6 0.0882773108 -0.00301859306 0.00104452989 2.47090539e-4 0.00148348065
""".split(), float)  # fmt: skip


def polynomial(t: np.ndarray, d: np.ndarray, v: np.ndarray, pa_: np.ndarray, coefficients: np.ndarray = COEFFICIENTS) -> np.ndarray:
    """The index less the air temperature, by Horner's rule in each variable."""
    at = len(coefficients)
    total = np.zeros_like(t)
    for p in range(6, -1, -1):
        in_d = np.zeros_like(t)
        for q in range(6 - p, -1, -1):
            in_v = np.zeros_like(t)
            for r in range(6 - p - q, -1, -1):
                n = 6 - p - q - r + 1
                c = coefficients[at - n : at]
                at -= n
                in_t = np.zeros_like(t)
                for x in c[::-1]:
                    in_t = in_t * t + x
                in_v = in_v * v + in_t
            in_d = in_d * d + in_v
        total = total * pa_ + in_d
    return total


def _utci(t: pa.Array, tr: pa.Array, v: pa.Array, hpa: pa.Array) -> pa.Array:
    a, b, c, e = (x.to_numpy(zero_copy_only=False).astype(float) for x in (t, tr, v, hpa))
    out = a + polynomial(a, b - a, c, e / 10)
    return pa.array(out, mask=np.isnan(out))


def utci(t: Column, tr: Column, v: Column, rh: Column) -> Column:
    """°C, of air and mean radiant temperature (°C), wind at 10 m (m/s) and relative humidity (%); null where one of them is null or NaN. Inputs are not held to the regression's range.

    The polynomial's 210 terms run in Arrow batches; as one Column they would overflow a generated method.
    """
    return F.arrow_udf(_utci, DoubleType())(t.cast("double"), tr.cast("double"), v.cast("double"), vapour_pressure(t) * rh / 100)
