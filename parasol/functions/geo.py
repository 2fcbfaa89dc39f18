"""Great-circle distance."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from parasol.constants import EARTH_RADIUS_KM
from parasol.functions.numeric import as_col


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(as_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(float(2 * EARTH_RADIUS_KM)) * F.asin(F.sqrt(chord))
