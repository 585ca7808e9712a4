"""The formulas as functions of Spark SQL, for those who write queries as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fernbrand.functions import fwi, ros


class Text:
    """An expression of SQL that grows by Python's operators."""

    def __init__(self, text) -> None:
        self.text = text.text if isinstance(text, Text) else text if isinstance(text, str) else f"{float(text)!r}D"

    def _with(self, other, sign: str, turned: bool = False) -> Text:
        a, b = self.text, Text(other).text
        return Text(f"({b} {sign} {a})" if turned else f"({a} {sign} {b})")

    def __add__(self, o): return self._with(o, "+")  # noqa: E704
    def __radd__(self, o): return self._with(o, "+", True)  # noqa: E704
    def __sub__(self, o): return self._with(o, "-")  # noqa: E704
    def __rsub__(self, o): return self._with(o, "-", True)  # noqa: E704
    def __mul__(self, o): return self._with(o, "*")  # noqa: E704
    def __rmul__(self, o): return self._with(o, "*", True)  # noqa: E704
    def __truediv__(self, o): return self._with(o, "/")  # noqa: E704
    def __rtruediv__(self, o): return self._with(o, "/", True)  # noqa: E704
    def __gt__(self, o): return self._with(o, ">")  # noqa: E704
    def __le__(self, o): return self._with(o, "<=")  # noqa: E704
    def __lt__(self, o): return self._with(o, "<")  # noqa: E704
    def __neg__(self): return Text(f"(-{self.text})")  # noqa: E704
    def __pow__(self, o): return Text(f"power({self.text}, {Text(o).text})")  # noqa: E704


def _call(name: str):
    return lambda *a: Text(f"{name}({', '.join(Text(x).text for x in a)})")


class _Words:
    exp, log, sqrt = _call("exp"), _call("ln"), _call("sqrt")
    most, least = _call("greatest"), _call("least")

    @staticmethod
    def where(c, a, b):
        return Text(f"CASE WHEN {Text(c).text} THEN {Text(a).text} ELSE {Text(b).text} END")

    @staticmethod
    def at(table, month):
        return Text(f"element_at(array({', '.join(Text(v).text for v in table)}), {Text(month).text})")

    @staticmethod
    def both(a, b):
        return Text(f"({Text(a).text} AND {Text(b).text})")


def definitions() -> dict[str, str]:
    """Name and parameters of each function, and its body."""
    p = lambda *names: [Text(n) for n in names]
    out = {
        "fwi_isi(ffmc DOUBLE, wind DOUBLE)": fwi.isi(*p("ffmc", "wind"), _Words), "fwi_bui(dmc DOUBLE, dc DOUBLE)": fwi.bui(*p("dmc", "dc"), _Words),
        "fwi_fwi(isi DOUBLE, bui DOUBLE)": fwi.fwi(*p("isi", "bui"), _Words), "fwi_dsr(fwi DOUBLE)": fwi.dsr(Text("fwi")),
        "fwi_dmc(temp DOUBLE, rh DOUBLE, rain DOUBLE, before DOUBLE, month INT)": fwi.dmc_step(*p("temp", "rh", "rain", "before", "month"), m=_Words),
        "fwi_dc(temp DOUBLE, rain DOUBLE, before DOUBLE, month INT)": fwi.dc_step(*p("temp", "rain", "before", "month"), m=_Words),
        "fwi_ffmc(temp DOUBLE, rh DOUBLE, wind DOUBLE, rain DOUBLE, before DOUBLE)": fwi.ffmc_step(*p("temp", "rh", "wind", "rain", "before"), m=_Words),
    }
    def curve(fuel):
        a, b, c = ros.CURVES[fuel][:3]
        return a * (1 - _Words.exp(-b * _Words.most(Text("isi"), 0))) ** c

    def rate(fuel):
        start, q, power, k1, k2 = ros.CURVES[fuel][3:]
        if start is None:
            return curve(fuel)
        big = q * _Words.most(Text("bui") - start, 0) ** power
        return curve(fuel) * _Words.where(Text("bui") > start, _Words.exp(k1 * _Words.log(_Words.most(big, 1e-300)) / (k2 + big)), 1)

    plain = [f for f in ros.FUELS if f[0] != "M" and f not in ("C-6", "O-1A", "O-1B")]
    cases = " ".join(f"WHEN '{f}' THEN {rate(f).text}" for f in plain)
    out["ros_head(fuel STRING, isi DOUBLE, bui DOUBLE)"] = f"CASE upper(trim(fuel)) {cases} END"
    return {k: Text(v).text for k, v in out.items()}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; gives their names. ``ros_head`` knows the fuels whose
    rate follows from the two indices alone, and is null for others."""
    names = []
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
        names.append(head.split("(")[0])
    return names
