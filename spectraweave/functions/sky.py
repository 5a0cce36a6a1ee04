"""Sky geometry as Column expressions: angles in degrees, offsets in arcseconds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Wavelengths in Angstrom, and the shifts there in arcseconds.
REFRACTION_WAVES = (3500.0, 4000.0, 4500.0, 5000.0, 5500.0)
REFRACTION_SHIFTS = (-0.74, -0.4, -0.08, 0.08, 0.20)


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in arcseconds (haversine)."""
    a = F.pow(F.sin(F.radians(dec2 - dec1) / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))) * 3600


def offsets(ra0: Column, dec0: Column, ra: Column, dec: Column) -> tuple[Column, Column]:
    """Flat-sky offsets of (ra, dec) from (ra0, dec0), right ascension taken the short way round."""
    dra = F.pmod(ra - ra0 + 180, F.lit(360.0)) - 180
    return dra * F.cos(F.radians(dec0)) * 3600, (dec - dec0) * 3600


def to_plane(ra: Column, dec: Column, ra0: Column, dec0: Column, rotation: Column | float = 0.0, scale: float = 1.0) -> tuple[Column, Column]:
    """Gnomonic projection about (ra0, dec0), turned by `rotation` degrees, in units of `scale` arcseconds."""
    r, d, d0 = F.radians(ra - ra0), F.radians(dec), F.radians(dec0)
    depth = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(r)
    x = F.degrees(F.cos(d) * F.sin(r) / depth) * 3600 / scale
    y = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(r)) / depth) * 3600 / scale
    t = F.radians(rotation if isinstance(rotation, Column) else F.lit(rotation))
    return x * F.cos(t) - y * F.sin(t), x * F.sin(t) + y * F.cos(t)


def to_sky(x: Column, y: Column, ra0: Column, dec0: Column, rotation: Column | float = 0.0, scale: float = 1.0) -> tuple[Column, Column]:
    """The inverse of to_plane."""
    t = F.radians(rotation if isinstance(rotation, Column) else F.lit(rotation))
    u = F.radians((x * F.cos(t) + y * F.sin(t)) * scale / 3600)
    v = F.radians((y * F.cos(t) - x * F.sin(t)) * scale / 3600)
    d0 = F.radians(dec0)
    across = F.cos(d0) - v * F.sin(d0)
    ra = ra0 + F.degrees(F.atan2(u, across))
    dec = F.degrees(F.atan2(F.sin(d0) + v * F.cos(d0), F.sqrt(u * u + across * across)))
    return F.pmod(ra, F.lit(360.0)), dec


def refraction(wave: Column) -> Column:
    """The shift in arcseconds by differential refraction at a wavelength: the cubic that fits the five knots best."""
    u = (wave - 4500.0) / 1000.0
    knots = [(x - 4500.0) / 1000.0 for x in REFRACTION_WAVES]
    cubic = np.polyfit(knots, REFRACTION_SHIFTS, 3).tolist()
    out = F.lit(cubic[0])
    for c in cubic[1:]:
        out = out * u + c
    return out


def refracted(ra: Column, dec: Column, wave: Column, angle: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """Where a fiber at (ra, dec) looks at a wavelength: moved on the plane about (ra0, dec0) by the refraction along a position angle."""
    x, y = to_plane(ra, dec, ra0, dec0)
    dx, dy = refraction_offset(refraction(wave), angle)
    return to_sky(x + dx, y + dy, ra0, dec0)


def refraction_offset(shift: Column, angle: Column) -> tuple[Column, Column]:
    """A refraction shift in arcseconds along a position angle, as x and y."""
    return shift * F.cos(F.radians(angle)), shift * F.sin(F.radians(angle))


def moved(ra: Column, dec: Column, pm_ra: Column, pm_dec: Column, years: Column) -> tuple[Column, Column]:
    """A position after proper motion in mas a year; NULL motion is none."""
    return (
        ra + F.coalesce(pm_ra, F.lit(0.0)) * years / 3.6e6 / F.cos(F.radians(dec)),
        dec + F.coalesce(pm_dec, F.lit(0.0)) * years / 3.6e6,
    )


def zone_keys(ra: Column, dec: Column, radius: float, spread: bool) -> Column:
    """Cells (zone, bin) of at least `radius` arcseconds; with spread, also those within one cell of it.

    A zone is a band of declination; its bins of right ascension widen with
    1 / cos(dec), and wrap at 360 degrees.
    """
    step = radius / 3600

    def bins(zone: Column) -> Column:
        edge = F.least(F.lit(89.9), F.greatest(F.abs(zone * step), F.abs((zone + 1) * step)) + step)
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / step)).cast("long")

    def cell(zone: Column, shift: Column) -> Column:
        n = bins(zone)
        at = F.floor(F.pmod(ra, F.lit(360.0)) / 360 * n).cast("long")
        return F.struct(zone.cast("long").alias("zone"), F.pmod(at + shift, n).alias("bin"))

    home = F.floor(dec / step).cast("long")
    if not spread:
        return F.array(cell(home, F.lit(0)))
    return F.array_distinct(F.array(*[cell(home + z, F.lit(b)) for z in (-1, 0, 1) for b in (-1, 0, 1)]))
