"""Great-circle distance and a grid-cell key that turns radius joins into equi-joins."""

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_KM)


class Grid:
    """Cells of equal degrees, no narrower than the search radius in latitude.

    ``cell`` gives the one cell of a point. ``around`` gives every cell that the radius around a
    point can touch: the exact longitude span of a spherical cap, wrapped at the date line and
    widened to the whole circle near a pole.
    """

    def __init__(self, km: float):
        self.reach = math.degrees(km / EARTH_KM) + 1e-9
        self.columns = max(1, math.floor(360.0 / self.reach))
        self.size = 360.0 / self.columns

    def _row(self, lat: Column) -> Column:
        return F.floor(lat / self.size).cast("int")

    def _column(self, lon: Column) -> Column:
        return F.floor(lon / self.size).cast("int")

    def cell(self, lat: Column, lon: Column) -> Column:
        return F.struct(
            self._row(lat).alias("row"),
            F.pmod(self._column(lon), F.lit(self.columns)).alias("column"),
        )

    def around(self, lat: Column, lon: Column) -> Column:
        ratio = F.lit(math.sin(math.radians(self.reach))) / F.cos(F.radians(lat))
        span = F.when(F.abs(lat) + self.reach >= 90.0, F.lit(180.0)).otherwise(
            F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9
        )
        first = self._column(lon - span)
        last = F.least(self._column(lon + span), first + F.lit(self.columns - 1))
        rows = F.sequence(self._row(lat - self.reach), self._row(lat + self.reach))
        columns = F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.lit(self.columns)))
        return F.flatten(
            F.transform(
                rows,
                lambda r: F.transform(columns, lambda c: F.struct(r.alias("row"), c.alias("column"))),
            )
        )
