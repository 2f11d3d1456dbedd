"""Sky models as column expressions: Perez 1990 and CIE luminance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper clearness limits of the bins, and F11 F12 F13 F21 F22 F23 of each bin (Perez et al. 1990).
CLEARNESS = [1.065, 1.230, 1.500, 1.950, 2.800, 4.500, 6.200]
COEFFICIENTS = [
    (-0.0083117, 0.5877285, -0.0620636, -0.0596012, 0.0721249, -0.0220216),
    (0.1299457, 0.6825954, -0.1513752, -0.0189325, 0.0659650, -0.0288748),
    (0.3296958, 0.4868735, -0.2210958, 0.0554140, -0.0639588, -0.0260542),
    (0.5682053, 0.1874525, -0.2951290, 0.1088631, -0.1519229, -0.0139754),
    (0.8730280, -0.3920403, -0.3616149, 0.2255647, -0.4620442, 0.0012448),
    (1.1326077, -1.2367284, -0.4118494, 0.2877813, -0.8230357, 0.0558651),
    (1.0601591, -1.5999137, -0.3589221, 0.2642124, -1.1272340, 0.1310694),
    (0.6777470, -0.3272588, -0.2504286, 0.1561313, -1.3765031, 0.2506212),
]
SOLAR_CONSTANT = 1367.0


def perez(dni: Column, dhi: Column, zenith: Column, incidence: Column, tilt_cosine: Column) -> dict[str, Column]:
    """Diffuse irradiance on a tilted plane by parts: dome, circumsolar, horizon, and their total (not below 0).

    zenith is the sun's zenith angle in radians, incidence the cosine between the
    plane's normal and the sun, tilt_cosine the normal's z.
    """
    z = F.least(zenith, F.lit(math.pi / 2))
    kappa = 1.041
    clearness = F.when(dhi > 0, ((dhi + dni) / dhi + kappa * z * z * z) / (1 + kappa * z * z * z)).otherwise(F.lit(1.0))
    elevation = F.greatest(90 - F.degrees(z), F.lit(0.0))
    mass = 1 / (F.sin(F.radians(elevation)) + 0.50572 * F.pow(elevation + 6.07995, -1.6364))
    brightness = dhi * mass / SOLAR_CONSTANT
    which = sum(((clearness > x).cast("int") for x in CLEARNESS[1:]), (clearness > CLEARNESS[0]).cast("int"))
    f = [F.element_at(F.array(*[F.lit(row[k]) for row in COEFFICIENTS]), which + 1) for k in range(6)]
    f1 = F.greatest(f[0] + f[1] * brightness + f[2] * z, F.lit(0.0))
    f2 = f[3] + f[4] * brightness + f[5] * z
    a, b = F.greatest(incidence, F.lit(0.0)), F.greatest(F.cos(z), F.lit(0.087))
    side = F.sqrt(F.greatest(1 - tilt_cosine * tilt_cosine, F.lit(0.0)))
    dome = dhi * (1 - f1) * (1 + tilt_cosine) / 2
    ring = dhi * f1 * a / b
    horizon = dhi * f2 * side
    return {"dome": dome, "circumsolar": ring, "horizon": horizon, "total": F.greatest(dome + ring + horizon, F.lit(0.0))}


def luminance(model: str, z: Column) -> Column:
    """Relative sky luminance at a direction with this z: isotropic, or CIE overcast."""
    if model == "isotropic":
        return F.lit(1.0)
    if model == "cie_overcast":
        return 1 + 2 * z
    raise ValueError(f"unknown sky model {model}")
