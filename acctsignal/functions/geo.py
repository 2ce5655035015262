"""Distance on the globe."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius and kilometres per statute mile.
EARTH_RADIUS_KM = 6371.009
KM_PER_MILE = 1.609344


def great_circle_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in miles; NULL if any coordinate is NULL or NaN."""
    phi1, lam1, phi2, lam2 = (F.radians(F.when(~F.isnan(c), c)) for c in (lat1, lon1, lat2, lon2))
    half_phi, half_lam = F.sin((phi2 - phi1) / 2), F.sin((lam2 - lam1) / 2)
    chord = half_phi * half_phi + F.cos(phi1) * F.cos(phi2) * half_lam * half_lam
    # rounding may lift the chord of antipodes a hair above 1; least() would turn NULL into 1
    chord = F.when(chord > 1, F.lit(1.0)).otherwise(chord)
    return F.lit(2 * EARTH_RADIUS_KM / KM_PER_MILE) * F.asin(F.sqrt(chord))
