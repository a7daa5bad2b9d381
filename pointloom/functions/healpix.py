"""Equal-area sky pixels (ring order) from (z = sin dec, phi): an expression, no lookup."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel(ra_deg: Column, sin_dec: Column, nside: int) -> Column:
    """Ring-order pixel number of a direction."""
    n = nside
    z, za = sin_dec, F.abs(sin_dec)
    tt = F.pmod(F.radians(ra_deg), F.lit(2 * math.pi)) / F.lit(math.pi / 2)  # in [0, 4)
    # equatorial belt
    up = F.floor(F.lit(float(n)) * (0.5 + tt) - F.lit(float(n)) * z * 0.75)
    down = F.floor(F.lit(float(n)) * (0.5 + tt) + F.lit(float(n)) * z * 0.75)
    ring = n + 1 + up - down
    shifted = 1 - ring % 2
    along = F.pmod(F.floor((up + down - n + shifted + 1) / 2), F.lit(4 * n))
    belt = 2 * n * (n - 1) + (ring - 1) * 4 * n + along
    # polar caps
    tp = tt - F.floor(tt)
    width = F.lit(float(n)) * F.sqrt(3 * (1 - za))
    a, b = F.floor(tp * width), F.floor((1 - tp) * width)
    r = a + b + 1
    at = F.pmod(F.floor(tt * r), 4 * r)
    cap = F.when(z > 0, 2 * r * (r - 1) + at).otherwise(12 * n * n - 2 * r * (r + 1) + at)
    return F.when(za <= 2 / 3, belt).otherwise(cap).cast("long")


def centre(pix: Column, nside: int) -> tuple[Column, Column]:
    """(right ascension in degrees, sin dec) of a pixel's middle."""
    n, north, p = nside, 2 * nside * (nside - 1), pix.cast("double")
    whole = 12 * n * n

    def rings(k: Column) -> Column:
        """Ring of the k-th pixel, from 1, of a cap counted from its pole."""
        return F.floor(F.sqrt(k / 2 - F.sqrt(F.floor(k / 2)))) + 1

    top, bottom = rings(p + 1), rings(F.lit(float(whole)) - p)
    ring = F.when(pix < north, top).when(pix < whole - north, F.floor((p - north) / (4 * n)) + n).otherwise(bottom)
    place = F.when(pix < north, p + 1 - 2 * top * (top - 1)).when(pix < whole - north, (p - north) % (4 * n) + 1).otherwise(4 * bottom + 1 - (whole - p - 2 * bottom * (bottom - 1)))
    shift = F.when((pix >= north) & (pix < whole - north) & ((ring + n) % 2 == 1), 1.0).otherwise(0.5)
    step = F.when((pix < north) | (pix >= whole - north), 90 / ring).otherwise(90.0 / n)
    height = F.when(pix < north, 1 - ring * ring / (3.0 * n * n)).when(pix < whole - north, (2 * n - ring) * 2 / (3.0 * n)).otherwise(ring * ring / (3.0 * n * n) - 1)
    return (place - shift) * step, height


def ring_place(pix: Column, nside: int) -> tuple[Column, Column]:
    """(ring, from 1 at the north pole; place in the ring, from 0) of a pixel."""
    n, p = nside, pix.cast("long")
    north, whole = 2 * n * (n - 1), 12 * n * n
    rings = lambda k: (F.floor(F.sqrt(k / 2 - F.sqrt(F.floor(k / 2)))) + 1).cast("long")
    top, bottom = rings((p + 1).cast("double")), rings((F.lit(whole) - p).cast("double"))
    ring = F.when(p < north, top).when(p < whole - north, F.floor((p - north) / (4 * n)) + n).otherwise(4 * n - bottom)
    place = F.when(p < north, p - 2 * top * (top - 1)).when(p < whole - north, (p - north) % (4 * n)).otherwise(p - whole + 2 * bottom * (bottom + 1))
    return ring.cast("int"), place.cast("int")
