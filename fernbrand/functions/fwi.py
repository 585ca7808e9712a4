"""Fire-weather indices. Each formula works on Columns, through ``PLAIN`` on numbers,
and through ``ARRAYS`` on arrays of numbers.

Nulls give null on Columns, except where a docstring says otherwise.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

COLUMNS = SimpleNamespace(
    exp=F.exp, log=F.log, sqrt=F.sqrt, where=lambda c, a, b: F.when(c, a).otherwise(b), at=lambda table, month: F.try_element_at(F.array(*map(F.lit, table)), month),
    most=lambda x, low: F.when(x < low, F.lit(low)).otherwise(x), least=lambda x, high: F.when(x > high, F.lit(high)).otherwise(x), both=lambda a, b: a & b,
)
PLAIN = SimpleNamespace(
    exp=lambda x: math.exp(min(x, 700)), log=lambda x: math.log(max(x, 1e-300)), sqrt=math.sqrt, where=lambda c, a, b: a if c else b, at=lambda table, month: table[month - 1], most=max, least=min,
    both=lambda a, b: a and b,
)

ARRAYS = SimpleNamespace(
    exp=lambda x: np.exp(np.minimum(x, 700)), log=lambda x: np.log(np.maximum(x, 1e-300)), sqrt=np.sqrt, where=np.where, at=lambda table, month: np.asarray(table)[month - 1], most=np.maximum,
    least=np.minimum, both=np.logical_and,
)

# Day-length factors of the duff moisture code and of the drought code, by month.
DMC_DAY = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
DC_DAY = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)
START = {"ffmc": 85.0, "dmc": 6.0, "dc": 15.0}


def moisture(ffmc):
    """Moisture content in percent from the fine fuel moisture code."""
    return 147.2 * (101.0 - ffmc) / (59.5 + ffmc)


def ffmc_step(temp, rh, wind, rain, before, m=COLUMNS):
    """Fine fuel moisture code of a day from that of the day before."""
    rh, wind, rain = m.least(m.most(rh, 0.0), 100.0), m.most(wind, 0.0), m.most(rain, 0.0)
    mo = moisture(m.least(m.most(before, 0.0), 101.0))
    rf = m.most(rain - 0.5, 1e-9)
    wet = mo + 42.5 * rf * m.exp(-100.0 / m.most(251.0 - mo, 1e-9)) * (1.0 - m.exp(-6.93 / rf))
    wet = wet + m.where(mo > 150.0, 0.0015 * (mo - 150.0) * (mo - 150.0) * m.sqrt(rf), 0.0 * mo)
    mo = m.where(rain > 0.5, m.least(wet, 250.0), mo)
    shared = 0.18 * (21.1 - temp) * (1.0 - m.exp(-0.115 * rh))
    steep = m.exp((rh - 100.0) / 10.0)
    dry_at, wet_at = 0.942 * rh**0.679 + 11.0 * steep + shared, 0.618 * rh**0.753 + 10.0 * steep + shared

    def kept(part):
        rate = (0.424 * (1.0 - part**1.7) + 0.0694 * m.sqrt(wind) * (1.0 - part**8.0)) * 0.581 * m.exp(0.0365 * temp)
        return m.exp(-rate * math.log(10.0))

    left = m.where(mo > dry_at, dry_at + (mo - dry_at) * kept(rh / 100.0), m.where(mo < wet_at, wet_at - (wet_at - mo) * kept((100.0 - rh) / 100.0), mo))
    return m.least(m.most(59.5 * (250.0 - left) / (147.2 + left), 0.0), 101.0)


def dmc_step(temp, rh, rain, before, month, latitude=46.0, m=COLUMNS):
    """Duff moisture code of a day from that of the day before."""
    rh, rain, before = m.least(m.most(rh, 0.0), 100.0), m.most(rain, 0.0), m.most(before, 0.0)
    day = m.at(DMC_DAY, month)
    if abs(latitude - 46.0) > 10:
        day = m.least(m.most(day + (latitude - 46.0) * 0.1, 1.0), 20.0)
    held = m.log(m.most(before, 1e-9))
    slope = m.where(before <= 33.0, 100.0 / (0.5 + 0.3 * before), m.where(before <= 65.0, 14.0 - 1.3 * held, 6.2 * held - 17.2))
    more = 1000.0 * (0.92 * rain - 1.27)
    after = 20.0 + m.exp(5.6348 - before / 43.43) + more / (48.77 + slope * (0.92 * rain - 1.27))
    rained = m.most(244.72 - 43.43 * m.log(m.most(after - 20.0, 1e-9)), 0.0)
    start = m.where(rain > 1.5, rained, before)
    return m.most(start + m.where(temp > -1.1, 100.0 * 1.894 * (temp + 1.1) * (100.0 - rh) * day * 1e-6, 0.0 * temp), 0.0)


def dc_step(temp, rain, before, month, m=COLUMNS):
    """Drought code of a day from that of the day before."""
    rain, before = m.most(rain, 0.0), m.most(before, 0.0)
    after = 800.0 * m.exp(-before / 400.0) + 3.937 * (0.83 * rain - 1.27)
    start = m.where(rain > 2.8, m.most(400.0 * m.log(800.0 / m.most(after, 1e-9)), 0.0), before)
    return m.most(start + 0.5 * m.where(temp > -2.8, m.most(0.36 * (temp + 2.8) + m.at(DC_DAY, month), 0.0), 0.0 * temp), 0.0)


def isi(ffmc, wind, m=COLUMNS):
    """Initial spread index."""
    mo = moisture(ffmc)
    return 0.208 * 91.9 * m.exp(-0.1386 * mo) * (1.0 + m.most(mo, 0.0) ** 5.31 / 4.93e7) * m.exp(0.05039 * wind)


def isi_or_zero(ffmc, wind):
    """Initial spread index of columns of any type; 0 where either isn't a number."""
    number = lambda c: F.when(~F.isnan(c.try_cast("double")), c.try_cast("double"))
    return F.coalesce(isi(number(ffmc), number(wind)), F.lit(0.0))


def bui(dmc, dc, m=COLUMNS):
    """Buildup index; 0 where both codes are 0."""
    both = m.most(dmc + 0.4 * dc, 1e-12)
    return m.where(dmc <= 0.4 * dc, 0.8 * dmc * dc / both, dmc - (1.0 - 0.8 * dc / both) * (0.92 + (0.0114 * m.most(dmc, 0.0)) ** 1.7))


def fwi(isi_, bui_, m=COLUMNS):
    """Fire weather index."""
    duff = m.where(bui_ <= 80.0, 0.626 * m.most(bui_, 0.0) ** 0.809 + 2.0, 1000.0 / (25.0 + 108.64 * m.exp(-0.023 * bui_)))
    b = 0.1 * isi_ * duff
    return m.where(b > 1.0, m.exp(2.72 * (0.434 * m.log(m.most(b, 1.0))) ** 0.647), b)


def dsr(fwi_):
    """Daily severity rating."""
    return 0.0272 * fwi_**1.77
