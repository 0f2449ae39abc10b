"""Column expressions for weather measures: calendar, wind, humidity, radiation, comfort, units."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

TWO_PI = 2 * math.pi


def calendar_angles(ts: str) -> list[Column]:
    """Sine and cosine of hour and day of year; a year counts 365 days."""
    h, d = TWO_PI * F.hour(ts) / 24, TWO_PI * (F.dayofyear(ts) - 1) / 365
    return [F.sin(h).alias("hour_sin"), F.cos(h).alias("hour_cos"), F.sin(d).alias("doy_sin"), F.cos(d).alias("doy_cos")]


def row_spread(columns: Sequence[str]) -> list[Column]:
    """Mean, population deviation, range and largest over columns of one row; nulls are left out, all null gives null."""
    xs = F.array_compact(F.array(*columns))
    n = F.size(xs)
    mean = F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), n)
    square = F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x), n)
    return [mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("std"), (F.array_max(xs) - F.array_min(xs)).alias("range"), F.array_max(xs).alias("largest")]


def sector(degrees: Column) -> Column:
    """One of eight sectors, 0 around north."""
    return (F.floor((degrees + 22.5) / 45) % 8).cast("int")


def quadrant(degrees: Column) -> Column:
    d = F.pmod(degrees, F.lit(360.0))
    return F.when((d >= 315) | (d < 45), "N").when(d < 135, "E").when(d < 225, "S").otherwise("W")


def direction(u: Column, v: Column) -> Column:
    """Degrees that a wind with components (u, v) comes from."""
    return F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))


def in_sector(degrees: Column, start: float, end: float) -> Column:
    """Whether a direction lies clockwise from start to end, which may wrap north."""
    return F.pmod(degrees - start, F.lit(360.0)) <= (end - start) % 360


def mean_direction(sine: Column, cosine: Column) -> Column:
    """Degrees, from 0 to 360, of the mean of directions whose mean sine and cosine these are."""
    return F.pmod(F.degrees(F.atan2(sine, cosine)), F.lit(360.0))


def terrain_block(speed: Column, sine: Column, cosine: Column, dew: Column, pressure: Column, gains: Column, dx: Column, dy: Column) -> dict[str, Column]:
    """Wind over terrain: the mean direction's sine and cosine, the gain of the sector that the wind comes from, uplift, and uplift times specific humidity in g/kg.

    gains: an array by `sector`; dx, dy: the slope to the east and the north. A missing input counts as no wind, no gain or no humidity.
    """
    zero = F.lit(0.0)
    up = F.coalesce(uplift(-speed * sine, -speed * cosine, dx, dy), zero)
    up = F.when(speed.isNull() | sine.isNull() | cosine.isNull(), zero).otherwise(up)
    q = F.when(dew.isNotNull() & (pressure > 0), F.greatest(zero, 1000 * specific_humidity(dew, pressure, magnus_wmo_hpa))).otherwise(zero)
    gain = F.coalesce(F.get(gains, sector(mean_direction(sine, cosine))), zero)
    return {"wind_sin": F.coalesce(sine, zero), "wind_cos": F.coalesce(cosine, zero), "upwind_gain": gain, "uplift": up, "uplift_humidity": up * q}


def onshore(degrees: Column, start: float, end: float, feather: float) -> Column:
    """1 inside a sector, falling to 0 over `feather` degrees on both sides."""
    width = (end - start) % 360
    off = F.abs(F.pmod(degrees - start - width / 2 + 180, F.lit(360.0)) - 180) - width / 2
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - off / feather))


def saturation_hpa(temp: Column) -> Column:
    """Hardy's formula over water; temp in degrees Celsius."""
    # fixed values: coefficients of powers -2 to 4 of the temperature in kelvin
    g = (-2836.5744, -6028.076559, 19.54263612, -0.02737830188, 0.000016261698, 7.0229056e-10, -1.8680009e-13)
    k = temp + 273.15
    return F.exp(2.7150305 * F.log(k) + sum((c * F.pow(k, F.lit(float(i - 2))) for i, c in enumerate(g)), F.lit(0.0))) * 0.01


def magnus_hpa(temp: Column) -> Column:
    return 6.112 * F.exp(17.67 * temp / (temp + 243.5))


def magnus_wmo_hpa(temp: Column) -> Column:
    # fixed values: the coefficients that the terrain block uses
    return 6.112 * F.exp(17.62 * temp / (temp + 243.12))


def relative_humidity(temp: Column, dew: Column) -> Column:
    """Percent, from 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * magnus_hpa(dew) / magnus_hpa(temp)))


def specific_humidity(dew: Column, pressure: Column, vapour=magnus_hpa) -> Column:
    """Kilograms in a kilogram of air; vapour: the formula of the pressure over water at a temperature."""
    e = vapour(dew)
    return 0.622 * e / (pressure - 0.378 * e)


def gust_ratio(gust: Column, speed: Column) -> Column:
    return F.least(F.lit(4.0), F.greatest(F.lit(0.5), gust / F.greatest(speed, F.lit(0.5))))


def uplift(u: Column, v: Column, dx: Column, dy: Column) -> Column:
    return F.greatest(F.lit(0.0), u * dx + v * dy)


# fixed values: the radiation constant, emissivities of ground and person, and the share of shortwave that counts
SIGMA, GROUND, HUMAN, SHORTWAVE = 5.67e-8, 0.97, 0.97, 0.30


def longwave_down(temp: Column, cloud: Column, vapour: Column) -> Column:
    k = temp + 273.15
    # fixed values: Brutsaert's clear-sky emissivity
    clear = 1.24 * F.pow(F.greatest(vapour, F.lit(0.01)) / k, F.lit(1 / 7))
    cc = F.least(F.lit(1.0), F.greatest(F.lit(0.0), cloud))
    return ((1 - cc) * clear + cc) * SIGMA * F.pow(k, F.lit(4.0))


def longwave_up(temp: Column) -> Column:
    return GROUND * SIGMA * F.pow(temp + 273.15, F.lit(4.0))


def sine_altitude(ts: str, latitude: Column | float, longitude: Column | float) -> Column:
    """Sine of the sun's altitude by Spencer's series; ts in UTC, places in degrees, null where one is."""
    day = F.dayofyear(ts) + (F.hour(ts) + F.minute(ts) / 60) / 24
    g = TWO_PI * (day - 1) / 365
    # fixed values: Spencer's coefficients
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    late = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    angle = math.pi / 12 * ((F.hour(ts) * 60 + F.minute(ts) + 4 * longitude + late) / 60 - 12)
    lat = F.radians(latitude if isinstance(latitude, Column) else F.lit(float(latitude)))
    sine = F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(angle)
    return F.when(sine.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sine)))  # least and greatest pass over nulls


def capped_shortwave(sw: Column, cloud: Column, sine: Column) -> Column:
    """Shortwave no larger than a clear sky lets through, less 65 % under full cloud; as it is at night."""
    cc = F.least(F.lit(1.0), F.greatest(F.lit(0.0), cloud))
    some = F.greatest(sw, F.lit(0.0))
    # fixed values: flux above the air, share that a clear sky lets through, share that full cloud takes
    return F.when(sine <= 0, some).otherwise(F.least(some, 1100 * 0.75 * sine * (1 - 0.65 * cc)))


def mean_radiant(temp: Column, sw: Column, cloud: Column, vapour: Column) -> Column:
    flux = SHORTWAVE * F.greatest(sw, F.lit(0.0)) + 0.5 * HUMAN * (longwave_down(temp, cloud, vapour) + longwave_up(temp))
    return F.pow(flux / (HUMAN * SIGMA), F.lit(0.25)) - 273.15


def apparent(temp: Column, vapour: Column, wind: Column) -> Column:
    """Steadman's shade temperature."""
    return temp + 0.33 * vapour - 0.70 * wind - 4.0


def polynomial(terms: Sequence[tuple[float, Sequence[int]]], *variables: Column) -> Column:
    """Sum of coefficient times powers of the variables; the terms are a parameter."""
    out = F.lit(0.0)
    for c, powers in terms:
        term = F.lit(float(c))
        for x, n in zip(variables, powers):
            for _ in range(n):
                term = term * x
        out = out + term
    return out


def exponents(variables: int, degree: int) -> list[tuple[int, ...]]:
    """Powers of all monomials up to a degree, the first variable's running fastest, the last one's slowest."""
    if not variables:
        return [()]
    return [(*rest, last) for last in range(degree + 1) for rest in exponents(variables - 1, degree - last)]


def comfort_index(temp: Column, wind: Column, radiant: Column, vapour_kpa: Column, coefficients: Sequence[float], degree: int = 6) -> Column:
    """Equivalent temperature by the published regression: air temperature plus a polynomial of temperature, wind, radiant excess and vapour pressure.

    coefficients: one for each of `exponents(4, degree)`, 210 for the sixth degree, in that order, which is that of the
    publication. Inputs are held within the range that the regression was made for; null where one is null.
    """
    powers = exponents(4, degree)
    if len(coefficients) != len(powers):
        raise ValueError(f"{len(powers)} coefficients are needed, not {len(coefficients)}")
    within = lambda x, low, high: F.when(x.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))
    # fixed values: the range of the regression
    t, v, excess, pa = within(temp, -50, 50), within(wind, 0.5, 17), within(radiant - temp, -30, 70), within(vapour_kpa, 0, 5)
    return t + polynomial([(c, n) for c, n in zip(coefficients, powers) if c], t, v, excess, pa)


#: fixed values: upper ends of the stress bands, in degrees Celsius
STRESS = ((-40.0, "extreme cold"), (-27.0, "very strong cold"), (-13.0, "strong cold"), (0.0, "moderate cold"), (9.0, "slight cold"), (26.0, "none"), (32.0, "moderate heat"), (38.0, "strong heat"), (46.0, "very strong heat"))


def stress_band(t: Column) -> Column:
    out = F.when(t < STRESS[0][0], STRESS[0][1])
    for limit, name in STRESS[1:]:
        out = out.when(t < limit, name)
    return out.otherwise("extreme heat")


def piecewise(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Straight lines between knots (x, y) in order of x, flat outside: the form of all scoring curves."""
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (a, ya), (b, yb) in zip(knots, knots[1:]):
        out = out.when(x <= b, ya + (x - a) * ((yb - ya) / (b - a)))
    return out.otherwise(float(knots[-1][1]))


def smoothstep(x: Column, low: float, high: float) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))
    return t * t * (3 - 2 * t)


#: fixed values of the scoring curves: knots (input, score) of the straight ones
FRICTION = ((5 - 1 / 0.17, 0.0), (5.0, 1.0), (10.0, 1.0), (25.0, 0.25))
AIR = ((5 - 0.4 / 0.12, 0.0), (5.0, 0.4), (8.0, 1.0), (10.0, 1.0), (20.0, 0.15), (25.0, 0.0))
WIND = ((0.0, 0.6), (5.0, 1.0), (10.0, 1.0), (15.0, 0.5), (35.0, 0.1))
#: fixed values of the smooth ones: (input of score 1, input of the floor, floor)
DEW, SALT, FILM = (3.0, 0.0, 0.15), (85.0, 100.0, 0.35), (0.01, 0.05, 0.08)
#: fixed values: least score of a tier
TIERS = ((0.70, "prime"), (0.50, "good"), (0.30, "marginal"))


def smooth_penalty(x: Column, curve: tuple[float, float, float]) -> Column:
    """1 at the curve's first input, smoothly down to its floor at the second, flat outside."""
    none, full, floor = curve
    share = smoothstep(x, none, full) if full > none else 1 - smoothstep(x, full, none)
    return 1 - (1 - floor) * share


def blended(scores: Column) -> Column:
    """Square root of geometric mean times least, of an array of scores from 0 to 1."""
    logs = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.log(F.greatest(x, F.lit(1e-6))))
    return F.sqrt(F.exp(logs / F.size(scores)) * F.array_min(scores))


def tier(score: Column) -> Column:
    out = F.when(score >= TIERS[0][0], TIERS[0][1])
    for least, name in TIERS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("poor")


#: Factors of units into the ones used here.
KNOTS, MPH, INHG, MILES = 0.514444, 0.44704, 33.8639, 1609.344


def celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32) * 5 / 9


def compass(point: Column) -> Column:
    """Degrees of a 16-point compass name; null for any other."""
    names = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
    return F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, 22.5 * i)]), F.upper(point))


def normal_cdf(z: Column) -> Column:
    """By the error function of Abramowitz and Stegun 7.1.26, good to 1.5e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # fixed values: the approximation's coefficients
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -erf).otherwise(erf))


def exceedance(pi: Column, mu: Column, sigma: Column, y: Column) -> Column:
    """Probability of more than y under a lognormal amount that is there with probability pi."""
    return F.when(y <= 0, pi).otherwise(pi * (1 - normal_cdf((F.log(y) - mu) / sigma)))


def mixed_pit(pi: Column, mu: Column, sigma: Column, y: Column) -> Column:
    """Probability integral transform; a dry outcome is the middle of the dry mass."""
    return F.when(y <= 0, (1 - pi) / 2).otherwise(1 - pi + pi * normal_cdf((F.log(y) - mu) / sigma))


def slug(name: Column) -> Column:
    """Lower-case letters and digits, all else a single hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def feature_hash(columns: Sequence[str], digits: int = 6) -> Column:
    """SHA-256 of a row's features, rounded; nulls are named."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.format_string(f"%.{digits}f", F.col(c)), F.lit("null")) for c in columns]), 256)


def day_range_utc(date: Column, zone: str, start: int, end: int) -> list[Column]:
    """First and last hour of a local day part as UTC, and its hours: summer time moves the start and may change the length."""
    at = [F.convert_timezone(F.lit(zone), F.lit("UTC"), date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(h))) for h in (start, end)]
    return [at[0].alias("utc_start"), at[1].alias("utc_end"), F.timestamp_diff("HOUR", at[0], at[1]).alias("utc_hours")]
