"""Signal families: a column per signal, in running sums."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.core.shared import once
from sextant.core.tables import DEALS_SQL, bars, bars_sql, deal_tables, deals
from sextant.functions.numbers import half_up_sql, half_up_text
from sextant.operators import rows as R
from sextant.plans.catalog import register

B = f"WITH {DEALS_SQL}, {bars_sql()}"


def by():
    return Window.partitionBy("id").orderBy("d")


class Both:
    """An expression as Spark SQL, made when it is asked for, and as DuckDB text; a division by zero is NULL in both."""

    def __init__(self, col: Callable[[], str], sql: str):
        self.col, self.sql = col, sql

    def __add__(self, other: Both) -> Both:
        return Both(lambda: f"({self.col()} + {other.col()})", f"({self.sql} + {other.sql})")

    def __sub__(self, other: Both) -> Both:
        return Both(lambda: f"({self.col()} - {other.col()})", f"({self.sql} - {other.sql})")

    def __truediv__(self, other: Both) -> Both:
        return Both(lambda: f"try_divide({self.col()}, {other.col()})", f"({self.sql} / nullif({other.sql}, 0))")

    def log(self) -> Both:
        return Both(lambda: f"ln(nullif({self.col()}, 0D))", f"ln(nullif({self.sql}, 0))")


class Spans:
    """Statistics over rows t-far..t-near of a name, in running sums: a span's sum is a difference of two running sums, so its
    cost doesn't grow with its length.  Only minima and maxima keep a frame of rows.  Columns note what they need as they are
    made; ``columns`` then adds every running sum, every lag of it and every frame once."""

    def __init__(self) -> None:
        self.sums: set[str] = set()
        self.lags: set[tuple[str, int]] = set()
        self.frames: dict[str, Column] = {}

    def running(self, v: str, back: int) -> str:
        """Sum of ``v`` up to ``back`` rows ago, 0 before the first row."""
        self.sums.add(v)
        if not back:
            return f"_s_{v}"
        self.lags.add((v, back))
        return f"_l{back}_{v}"

    def total(self, v: str, far: int, near: int = 0) -> str:
        return f"({self.running(v, near)} - {self.running(v, far + 1)})"

    def known(self, v: str, far: int, near: int) -> str:
        return self.total(f"has_{v}", far, near)

    @staticmethod
    def enough(n: int, least: int | None) -> int:
        return max(2, int(0.8 * n)) if least is None else least

    def over(self, v: str, n: int, spark: Callable[[str, Callable[[str], str]], str], sql: str, near: int = 0, least: int | None = None) -> Both:
        """``spark`` gets the count of values and the sum of any column; ``sql`` is an aggregate of ``v``."""
        far, enough = near + n - 1, self.enough(n, least)

        def column() -> str:
            count = self.known(v, far, near)
            return f"CASE WHEN {count} >= {enough} THEN {spark(count, lambda c: self.total(c, far, near))} END"

        frame = f"OVER (PARTITION BY id ORDER BY d ROWS BETWEEN {far} PRECEDING AND {near} PRECEDING)"
        return Both(column, f"CASE WHEN count({v}) {frame} >= {enough} THEN {sql} {frame} END")

    def sum(self, v: str, n: int, near: int = 0, least: int | None = None) -> Both:
        return self.over(v, n, lambda k, s: s(v), f"sum({v})", near, least)

    def mean(self, v: str, n: int, near: int = 0, least: int | None = None) -> Both:
        return self.over(v, n, lambda k, s: f"{s(v)} / {k}", f"avg({v})", near, least)

    def std(self, v: str, n: int) -> Both:
        return self.over(v, n, lambda k, s: f"sqrt(greatest(({s(f'{v}_2')} - {s(v)} * {s(v)} / {k}) / ({k} - 1), 0D))", f"stddev_samp({v})")

    def skew(self, v: str, n: int) -> Both:
        def spark(k: str, s: Callable) -> str:
            m, two = f"({s(v)} / {k})", s(f"{v}_2")
            second, third = f"({two} - {k} * {m} * {m})", f"({s(f'{v}_3')} - 3 * {m} * {two} + 2 * {k} * {m} * {m} * {m})"
            return f"{k} * sqrt({k} - 1) / ({k} - 2) * try_divide({third}, pow({second}, 1.5D))"

        return self.over(v, n, spark, f"skewness({v})")

    def kurt(self, v: str, n: int) -> Both:
        def spark(k: str, s: Callable) -> str:
            m, two = f"({s(v)} / {k})", s(f"{v}_2")
            second = f"({two} - {k} * {m} * {m})"
            fourth = f"({s(f'{v}_4')} - 4 * {m} * {s(f'{v}_3')} + 6 * {m} * {m} * {two} - 3 * {k} * {m} * {m} * {m} * {m})"
            rest = f"(({k} - 2) * ({k} - 3))"
            return f"{k} * ({k} + 1) * ({k} - 1) / {rest} * try_divide({fourth}, {second} * {second}) - 3 * ({k} - 1) * ({k} - 1) / {rest}"

        return self.over(v, n, spark, f"kurtosis({v})")

    def extreme(self, v: str, n: int, how: str) -> Both:
        def column() -> str:
            w = by().rowsBetween(-(n - 1), 0)
            self.frames[f"_{how}_{v}_{n}"] = F.when(F.count(v).over(w) >= self.enough(n, None), getattr(F, how)(v).over(w))
            return f"_{how}_{v}_{n}"

        frame = f"OVER (PARTITION BY id ORDER BY d ROWS {n - 1} PRECEDING)"
        return Both(column, f"CASE WHEN count({v}) {frame} >= {self.enough(n, None)} THEN {how}({v}) {frame} END")

    def columns(self, rows: DataFrame) -> DataFrame:
        def value(v: str) -> Column:
            if v.startswith("has_"):
                return F.col(v[4:]).isNotNull().cast("double")
            base, _, power = v.rpartition("_")
            return F.pow(F.col(base), F.lit(float(power))) if power.isdigit() and base in rows.columns else F.col(v)

        upto = by().rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({f"_s_{v}": F.coalesce(F.sum(value(v)).over(upto), F.lit(0.0)) for v in sorted(self.sums)} | self.frames)
        return rows.withColumns({f"_l{k}_{v}": F.lag(f"_s_{v}", k, 0.0).over(by()) for v, k in sorted(self.lags)})


def panel(spark: SparkSession, p: str) -> DataFrame:
    """``_panel``, written once for all families of a session."""
    return once(spark, "panel", deal_tables(p), lambda: _panel(spark, p))


def _panel(spark: SparkSession, p: str) -> DataFrame:
    """Bars with log return x, the market's mean return m, the day's deal flow, and what the families' spans run over."""
    flow = deals(spark, p).groupBy(F.col("brand").alias("id"), "d").agg(
        F.sum(F.when(F.col("side") == "BUY", F.col("value")).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("side") == "SELL", F.col("value")).otherwise(0.0)).alias("sell")
    )
    before = F.lag("close").over(by())
    x = bars(deals(spark, p)).join(flow, ["id", "d"]).withColumns({"x": F.log(F.col("close") / before), "gap": F.log(F.col("open") / before), "t": F.row_number().over(by()).cast("double")})
    market = x.groupBy("d").agg(F.avg("x").alias("m"))
    # turns of the month: one of the three sessions before or after lies in another month; dates only
    dates, order = x.select("d").distinct(), Window.orderBy("d")
    near = [F.coalesce(F.trunc(f("d", k).over(order), "month") != F.trunc("d", "month"), F.lit(False)) for f in (F.lag, F.lead) for k in (1, 2, 3)]
    turn = dates.select("d", (near[0] | near[1] | near[2] | near[3] | near[4] | near[5]).alias("turn"))
    x = x.join(market, "d").join(turn, "d")
    one = x.withColumns({
        "up": (F.col("x") > 0).cast("double"), "neg": F.when(F.col("x").isNotNull(), F.least("x", F.lit(0.0))), "intra": F.log(F.col("close") / F.col("open")), "hl2": F.pow(F.log(F.col("high") / F.col("low")), F.lit(2.0)),
        "hlr": (F.col("high") - F.col("low")) / F.col("close"), "rel": F.col("x") - F.col("m"), "mx": F.when(F.col("x").isNotNull(), F.col("m")), "xm": F.col("x") * F.col("m"), "lv": F.log("volume"),
        "illiq": F.abs("x") / F.col("turnover") * 1e6, "zero": (F.abs("x") < 1e-9).cast("double"), "x1": F.lag("x").over(by()), "upv": F.when(F.col("x") > 0, F.col("volume")).otherwise(0.0),
        "net": F.col("buy") - F.col("sell"), "busy": ((F.col("buy") + F.col("sell")) > 0).cast("double"), "tx": F.when(F.col("turn"), F.col("x")),
    })
    one = one.withColumns({"dv": F.col("lv") - F.lag("lv").over(by()), "xx1": F.col("x") * F.col("x1"), **{f"ewm{h}": R.ewm("net", "t", h, ["id"]) for h in (10, 42)}})
    one = one.withColumns({"cx": F.when(F.col("dv").isNotNull(), F.col("x")), "cv": F.when(F.col("x").isNotNull(), F.col("dv")), "cxv": F.col("x") * F.col("dv")})
    s = Spans()
    vol21, mean63 = s.std("x", 21).col(), s.mean("volume", 63, near=1).col()
    two = s.columns(one).withColumns({"vol21": F.expr(vol21), "big": F.expr(f"CAST(volume > 2 * {mean63} AS DOUBLE)")})
    return two.select(*one.columns, "vol21", F.coalesce("big", F.lit(0.0)).alias("big"))


_ONE = "OVER (PARTITION BY id ORDER BY d)"
_NEAR = " OR ".join(f"coalesce(date_trunc('month', {f}(d, {k}) OVER (ORDER BY d)) <> date_trunc('month', d), false)" for f in ("lag", "lead") for k in (1, 2, 3))
PANEL_SQL = f"""{B}, flow AS (SELECT brand AS id, d, coalesce(sum(value) FILTER (side = 'BUY'), 0) AS buy, coalesce(sum(value) FILTER (side = 'SELL'), 0) AS sell FROM deals GROUP BY ALL),
xr AS (SELECT bars.*, buy, sell, ln(close / lag(close) {_ONE}) AS x, ln(open / lag(close) {_ONE}) AS gap, row_number() {_ONE} AS t FROM bars JOIN flow USING (id, d)), mk AS (SELECT d, avg(x) AS m FROM xr GROUP BY 1),
turns AS (SELECT d, {_NEAR} AS turn FROM (SELECT DISTINCT d FROM xr)),
p1 AS (SELECT xr.*, m, (x > 0)::INT AS up, CASE WHEN x IS NOT NULL THEN least(x, 0) END AS neg, ln(close / open) AS intra, pow(ln(high / low), 2) AS hl2, (high - low) / close AS hlr, x - m AS rel,
  CASE WHEN x IS NOT NULL THEN m END AS mx, ln(volume) AS lv, abs(x) / turnover * 1e6 AS illiq, (abs(x) < 1e-9)::INT AS zero, lag(x) {_ONE} AS x1, CASE WHEN x > 0 THEN volume ELSE 0 END AS upv, buy - sell AS net,
  (buy + sell > 0)::INT AS busy, CASE WHEN turn THEN x END AS tx FROM xr JOIN mk USING (d) JOIN turns USING (d)),
p2 AS (SELECT *, lv - lag(lv) {_ONE} AS dv, x * x1 AS xx1, CASE WHEN count(x) OVER (PARTITION BY id ORDER BY d ROWS 20 PRECEDING) >= 16 THEN stddev_samp(x) OVER (PARTITION BY id ORDER BY d ROWS 20 PRECEDING) END AS vol21,
  coalesce(CASE WHEN count(volume) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) >= 50 THEN (volume > 2 * avg(volume) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING))::INT END, 0) AS big FROM p1),
panel AS (SELECT *, CASE WHEN dv IS NOT NULL THEN x END AS cx FROM p2)"""


def family(name: str, make: Callable[[Spans], dict[str, Both]]) -> None:
    """Registers one query with a column per signal; all share the sort by (id, d)."""
    signals = make(Spans())
    sql = f"{PANEL_SQL} SELECT id, d, {', '.join(f'{half_up_sql(s.sql, 5)} AS {key}' for key, s in signals.items())} FROM panel"

    def query(spark: SparkSession, p: str) -> DataFrame:
        spans = Spans()
        columns = [f"{half_up_text(s.col(), 5)} AS {key}" for key, s in make(spans).items()]
        return spans.columns(panel(spark, p)).selectExpr("id", "d", *columns)

    register(name, sql)(query)


def plain(column: str) -> Both:
    return Both(lambda: column, column)


def _momentum(s: Spans) -> dict[str, Both]:
    close = plain("close")
    out = {f"mom_{n}_skip{k}": s.sum("x", n - k, near=k) for n, k in itertools.product((21, 42, 63, 126, 189, 252), (0, 5, 21)) if k < n}
    for n in (63, 126, 252):
        out[f"ram_{n}"] = s.sum("x", n) / s.std("x", n)
        out[f"hi_{n}"] = close / s.extreme("close", n, "max")
    out |= {f"ma_ratio_{n}": close / s.mean("close", n) for n in (10, 20, 50, 100, 200)}
    out |= {f"ma_cross_{a}_{n}": s.mean("close", a) / s.mean("close", n) for a, n in ((5, 20), (10, 50), (20, 100), (50, 200))}
    out |= {f"updays_{n}": s.mean("up", n) for n in (21, 63, 126, 252)}
    out |= {f"mom_accel_{n}": s.sum("x", n) - s.sum("x", n, near=n) for n in (63, 126)}
    return out


def _reversal(s: Spans) -> dict[str, Both]:
    close = plain("close")
    out = {"rev_1": plain("x"), "gap_1": plain("gap"), "intraday_1": plain("intra")} | {f"rev_{n}": s.sum("x", n) for n in (2, 3, 5, 10)}
    for n in (5, 10, 21):
        out[f"gap_{n}"], out[f"intraday_{n}"] = s.mean("gap", n), s.mean("intra", n)
    for n in (5, 21, 63):
        low = s.extreme("low", n, "min")
        out[f"maxret_{n}"], out[f"minret_{n}"] = s.extreme("x", n, "max"), s.extreme("x", n, "min")
        out[f"off_low_{n}"] = close / s.extreme("close", n, "min")
        out[f"range_pos_{n}"] = (close - low) / (s.extreme("high", n, "max") - low)
    return out


def _volatility(s: Spans) -> dict[str, Both]:
    out = {f"vol_{n}": s.std("x", n) for n in (10, 21, 63, 126, 252)} | {f"downvol_{n}": s.std("neg", n) for n in (21, 63, 126)}
    for n in (10, 21, 63):
        mean = s.mean("hl2", n)
        out[f"parkinson_{n}"] = Both(lambda mean=mean: f"sqrt(({mean.col()}) / 2.772588722239781D)", f"sqrt(({mean.sql}) / 2.772588722239781)")
    out |= {f"ivol_{n}": s.std("rel", n) for n in (63, 126)} | {"volvol_63": s.std("vol21", 63)}
    for n in (63, 126, 252):
        out[f"skew_{n}"] = s.skew("x", n)
        slope = lambda k, t: f"try_divide({t('xm')} - {t('x')} * {t('mx')} / {k}, {t('mx_2')} - {t('mx')} * {t('mx')} / {k})"
        out[f"beta_{n}"] = s.over("x", n, slope, "regr_slope(x, mx)")
    out |= {f"kurt_{n}": s.kurt("x", n) for n in (63, 252)} | {f"hl_range_{n}": s.mean("hlr", n) for n in (5, 21)}
    return out | {"vol_ratio_21_126": s.std("x", 21) / s.std("x", 126)}


def _volume(s: Spans) -> dict[str, Both]:
    out = {f"lturn_{n}": s.mean("turnover", n).log() for n in (5, 21, 63)} | {"vsurge_1_21": plain("volume") / s.mean("volume", 21)}
    out |= {f"vsurge_{a}_{n}": s.mean("volume", a) / s.mean("volume", n) for a, n in ((5, 21), (5, 63), (21, 126), (21, 252))}
    for n in (21, 63):
        out[f"vstd_{n}"] = s.std("lv", n)
        both = lambda k, t: f"try_divide({t('cxv')} - {t('cx')} * {t('cv')} / {k}, sqrt(({t('cx_2')} - {t('cx')} * {t('cx')} / {k}) * ({t('cv_2')} - {t('cv')} * {t('cv')} / {k})))"
        out[f"pvcorr_{n}"] = s.over("cx", n, both, "corr(x, dv)")
        out[f"upvol_{n}"] = s.sum("upv", n) / s.sum("volume", n)
        out[f"abvol_{n}"] = s.sum("big", n)
    return out | {"turn_trend": s.mean("turnover", 21).log() - s.mean("turnover", 126).log(), "lturn_level": plain("turnover").log()}


def _liquidity(s: Spans) -> dict[str, Both]:
    out = {f"amihud_{n}": s.mean("illiq", n) for n in (5, 21, 63, 126, 252)} | {f"zeroret_{n}": s.mean("zero", n) for n in (21, 63, 126)}
    for n in (21, 63):
        a, b, c = s.mean("xx1", n), s.mean("x", n), s.mean("x1", n)

        def spread(a: Both = a, b: Both = b, c: Both = c) -> str:
            x, y, z = a.col(), b.col(), c.col()
            return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL AND {z} IS NOT NULL THEN 2 * sqrt(greatest({y} * {z} - {x}, 0D)) END"

        out[f"roll_{n}"] = Both(spread, f"CASE WHEN ({a.sql}) IS NOT NULL AND ({b.sql}) IS NOT NULL AND ({c.sql}) IS NOT NULL THEN 2 * sqrt(greatest(({b.sql}) * ({c.sql}) - ({a.sql}), 0)) END")
        out[f"turn_cv_{n}"] = s.std("turnover", n) / s.mean("turnover", n)
    return out | {"log_price": plain("close").log(), "illiq_trend": s.mean("illiq", 21) / s.mean("illiq", 126)}


def _seasonal(s: Spans) -> dict[str, Both]:
    """The coming window's returns in past years: rows t+h-252k back to t+1-252k; and mean returns at turns of the month."""

    def same_window(years: range, h: int = 21) -> Both:
        parts = [s.sum("x", h, near=252 * k - h) for k in years]
        if len(parts) == 1:
            return parts[0]

        def mean() -> str:
            each = [q.col() for q in parts]
            return f"try_divide({' + '.join(f'coalesce({q}, 0D)' for q in each)}, {' + '.join(f'CASE WHEN {q} IS NULL THEN 0 ELSE 1 END' for q in each)})"

        return Both(mean, f"list_avg([{', '.join(q.sql for q in parts)}])")

    out = {f"hs_last{k}y": same_window(range(1, k + 1)) for k in (1, 2, 3, 5)} | {"hs_years2to5": same_window(range(2, 6))}
    out |= {f"hs63_last{k}y": same_window(range(1, k + 1), 63) for k in (1, 2)} | {"annual_rev": s.sum("x", 21, near=252)}
    return out | {f"tom_{k}m": s.mean("tx", 21 * k, least=4 * k) for k in (12, 24, 36)}


def _institutional(s: Spans) -> dict[str, Both]:
    out = {f"dnet_{n}": s.sum("net", n) / s.sum("turnover", n) for n in (5, 21, 63, 126)}
    for n in (21, 63):
        out[f"dbuy_{n}"], out[f"dsell_{n}"], out[f"ddays_{n}"] = s.sum("buy", n) / s.sum("turnover", n), s.sum("sell", n) / s.sum("turnover", n), s.sum("busy", n)
    for h in (10, 42):
        sql = f"sum(net * pow(2, t / {h}.0)) OVER (PARTITION BY id ORDER BY d ROWS UNBOUNDED PRECEDING) / sum(pow(2, t / {h}.0)) OVER (PARTITION BY id ORDER BY d ROWS UNBOUNDED PRECEDING)"
        out[f"dnet_ewm{h}"] = Both(lambda h=h: f"ewm{h}", sql) / s.mean("turnover", 63)
    return out


FAMILIES = {"g01_momentum": _momentum, "g02_reversal": _reversal, "g03_volatility": _volatility, "g04_volume": _volume, "g05_liquidity": _liquidity, "g06_seasonal": _seasonal, "g07_institutional": _institutional}
for _name, _family in FAMILIES.items():
    family(_name, _family)
