"""Landed feed responses as typed columns.

The jobs read raw response tables; nothing here calls a service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasol.constants import DEFAULT_FALLBACK_READING
from parasol.functions.numeric import as_col, kmh, round_to

OBSERVATION = "rain struct<`1h`:double>, wind struct<speed:double>, weather array<struct<description:string>>, name string"
FORECAST = ("current struct<precipitation:double,wind_speed_10m:double>, "
            "hourly struct<precipitation:array<double>>")
AIR = ("status string, data struct<aqi:int,city:struct<name:string>,iaqi:struct<pm25:struct<v:double>>,"
       "dominentpol:string>")
STORM = "data struct<values:struct<windSpeed:double,windGust:double,precipitationIntensity:double,floodIndex:double>>"
PLACE = ("array<struct<lat:string,lon:string,address:struct<suburb:string,city_district:string,city:string,"
         "town:string,state_district:string>>>")
VISION = ("authentic boolean, confidence double, verdict string, weather_evidence string, reason string, "
          "recommended_action string, is_stock_photo boolean, is_screenshot boolean, is_ai_generated boolean, "
          "score_adjustment int")


def _number(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(0.0))


def duration_from_intensity(rain) -> Column:
    """Minutes implied by an hourly intensity."""
    r = as_col(rain)
    return F.when(r >= 7.5, 60).when(r >= 4.0, 50).when(r >= 1.5, 35).otherwise(15)


def parse_observation(raw: DataFrame, body: str = "body") -> DataFrame:
    parsed = raw.withColumn("_r", F.from_json(body, OBSERVATION))
    return parsed.withColumns({
        "rain_intensity": round_to(_number("_r.rain.1h"), 1),
        "duration": duration_from_intensity(_number("_r.rain.1h")),
        "wind_speed": round_to(kmh(_number("_r.wind.speed")), 1),
        "place": F.col("_r.name"),
        "description": F.coalesce(F.get("_r.weather", F.lit(0))["description"], F.lit("")),
    }).drop("_r", body)


def parse_forecast(raw: DataFrame, body: str = "body") -> DataFrame:
    parsed = raw.withColumn("_r", F.from_json(body, FORECAST))
    wet_hours = F.size(F.filter(F.slice("_r.hourly.precipitation", 1, 24), lambda p: F.coalesce(p, F.lit(0.0)) > 2.0))
    return parsed.withColumns({
        "rain_intensity": round_to(_number("_r.current.precipitation"), 1),
        "duration": F.least(F.greatest(wet_hours, F.lit(0)) * 60, F.lit(180)),
        "wind_speed": round_to(_number("_r.current.wind_speed_10m"), 1),
    }).drop("_r", body)


def parse_air(raw: DataFrame, body: str = "body") -> DataFrame:
    """Only responses whose status is ok."""
    parsed = raw.withColumn("_r", F.from_json(body, AIR)).where("_r.status = 'ok'")
    return parsed.withColumns({
        "aqi": F.coalesce("_r.data.aqi", F.lit(0)),
        "pm25": F.col("_r.data.iaqi.pm25.v"),
        "dominant": F.coalesce("_r.data.dominentpol", F.lit("pm25")),
        "station": F.col("_r.data.city.name"),
    }).drop("_r", body)


def parse_storm(raw: DataFrame, body: str = "body") -> DataFrame:
    parsed = raw.withColumn("_r", F.from_json(body, STORM))
    v = "_r.data.values."
    return parsed.withColumns({
        "wind_speed_kmh": round_to(kmh(_number(v + "windSpeed")), 1),
        "wind_gust_kmh": round_to(kmh(_number(v + "windGust")), 1),
        "precip_mm_hr": round_to(_number(v + "precipitationIntensity"), 2),
        "flood_index": _number(v + "floodIndex"),
    }).drop("_r", body)


def cascade(requests: DataFrame, primary: DataFrame, secondary: DataFrame, fallback: DataFrame,
            key: str) -> DataFrame:
    """First available reading: primary feed, secondary feed, the zone's fixed values.

    ``primary`` and ``secondary`` carry rain_intensity, duration, wind_speed by ``key``.
    """
    fields = ["rain_intensity", "duration", "wind_speed"]

    def side(df, name):
        return df.select(key, F.struct(*fields).alias(name))

    zone = fallback.select(
        "pincode", F.struct(F.col("rain").alias("rain_intensity"), "duration", F.col("wind").alias("wind_speed")).alias("_zone"))
    default = F.struct(
        F.lit(DEFAULT_FALLBACK_READING["rain"]).alias("rain_intensity"),
        F.lit(DEFAULT_FALLBACK_READING["duration"]).alias("duration"),
        F.lit(float(DEFAULT_FALLBACK_READING["wind"])).alias("wind_speed"))
    joined = (requests.join(side(primary, "_first"), key, "left").join(side(secondary, "_second"), key, "left")
              .join(zone, "pincode", "left"))
    chosen = F.coalesce("_first", "_second", "_zone", default)
    source = F.when(F.col("_first").isNotNull(), "observation").when(F.col("_second").isNotNull(), "forecast") \
        .otherwise("zone fallback")
    return joined.select(
        *requests.columns, *[chosen[f].alias(f) for f in fields], source.alias("source"),
        F.coalesce("_first", "_second").isNotNull().alias("is_live"))


def geocode(pins: DataFrame, known: DataFrame, responses: DataFrame) -> DataFrame:
    """Coordinates and place of each pincode: the known list, else the geocoder's answer."""
    known = known.select("pincode", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "place")
    hit = responses.select("pincode", F.get(F.from_json("body", PLACE), F.lit(0)).alias("_hit"))
    a = "_hit.address."
    named = F.coalesce(a + "suburb", a + "city_district", a + "city", a + "town", a + "state_district",
                       F.concat(F.lit("Pincode "), F.col("pincode")))
    return pins.join(known, "pincode", "left").join(hit, "pincode", "left").select(
        *pins.columns,
        F.coalesce("_lat", F.col("_hit.lat").cast("double")).alias("lat"),
        F.coalesce("_lon", F.col("_hit.lon").cast("double")).alias("lon"),
        F.when(F.col("place").isNotNull(), F.col("place")).when(F.col("_hit").isNotNull(), named).alias("place"))


def strip_fence(text) -> Column:
    """Body of a Markdown-fenced answer, or the text itself."""
    t = F.trim(as_col(text))
    inner = F.regexp_replace(F.get(F.split(t, "```"), F.lit(1)), "^json", "")
    return F.trim(F.when(t.startswith("```"), inner).otherwise(t))


def parse_vision(raw: DataFrame, response: str = "response") -> DataFrame:
    """Vision answers as columns; an unreadable answer becomes the neutral result."""
    parsed = raw.withColumn("_v", F.from_json(strip_fence(response), VISION))
    readable = F.coalesce("_v.verdict", "_v.recommended_action").isNotNull() | F.col("_v.authentic").isNotNull()

    def field(name, when_missing, when_unreadable):
        return F.when(readable, F.coalesce(f"_v.{name}", F.lit(when_missing))).otherwise(F.lit(when_unreadable))

    adjustment = F.greatest(F.lit(-30), F.least(F.lit(40), F.coalesce("_v.score_adjustment", F.lit(0))))
    return parsed.withColumns({
        "authentic": field("authentic", True, True),
        "verdict": field("verdict", None, "UNVERIFIED"),
        "weather_evidence": field("weather_evidence", None, "UNKNOWN"),
        "recommended_action": field("recommended_action", None, "MANUAL_REVIEW"),
        "is_stock_photo": field("is_stock_photo", False, False),
        "is_screenshot": field("is_screenshot", False, False),
        "is_ai_generated": field("is_ai_generated", False, False),
        "score_adjustment": F.when(readable, adjustment).otherwise(F.lit(0)),
        "vision_used": readable,
    }).drop("_v", response)
