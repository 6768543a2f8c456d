"""Research tables derived from the generic order/line-item tables.

All dates are data dates; ``as_of`` is the last bar date, never the wall clock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import fiscal_quarter, fiscal_year, period_end
from tickloom.session import materialise


def supplier_symbol(key: str) -> Column:
    return F.concat(F.lit("S"), F.col(key).cast("string"), F.lit(".NS"))


@dataclass(frozen=True)
class Tables:
    """Lazy views over one data folder."""

    spark: SparkSession
    root: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def with_stored_bars(self) -> Tables:
        """The same views with the bars written once to the shared folder, the way a
        price table is; for jobs that read them several times. Deliveries are summed in the
        same pass, and result dates follow from the days of the bars."""
        if "_stored" in self.__dict__:
            return self
        stored = Tables(self.spark, self.root)
        daily = materialise(self._ohlcv("symbol", "trade_date", _kept=F.sum(self._delivered)))
        own = stored.__dict__
        own["_stored"] = {}
        own["bars"] = daily.drop("_kept")
        own["delivery"] = daily.select(
            "symbol", "trade_date", self._delivery_pct(F.col("_kept"), F.col("volume"))
        )
        own["earnings_dates"] = self._earnings_dates(daily)
        return stored

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """``build()``; of views with stored bars it is stored too, for all parts of a job."""
        stored = self.__dict__.get("_stored")
        if stored is None:
            return build()
        if name not in stored:
            stored[name] = materialise(build(), name)
        return stored[name]

    def keep(self, view: str) -> None:
        """Store a view for all parts of a job."""
        self.__dict__[view] = self.once(view, lambda: getattr(self, view))

    @cached_property
    def lines(self) -> DataFrame:
        li = self.read("lineitem")
        return li.select(
            supplier_symbol("l_suppkey").alias("symbol"),
            F.col("l_shipdate").cast("date").alias("trade_date"),
            F.try_divide("l_extendedprice", "l_quantity").alias("px"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_suppkey",
        )

    def _ohlcv(self, *keys: str, **more: Column) -> DataFrame:
        # One fixed-width ordering key keeps the aggregation in hash buffers with
        # map-side combine; 38 digits hold order, line and part numbers.
        seq = (
            F.col("l_orderkey").cast("decimal(20,0)") * F.lit(10**15).cast("decimal(16,0)")
            + (F.col("l_linenumber").cast("long") * F.lit(10**12) + F.col("l_partkey"))
        ).cast("decimal(38,0)")
        return (
            self.lines.withColumn("seq", seq)
            .groupBy(*keys)
            .agg(
                F.min_by("px", "seq").alias("open"),
                F.max("px").alias("high"),
                F.min("px").alias("low"),
                F.max_by("px", "seq").alias("close"),
                F.sum("l_quantity").alias("volume"),
                *[value.alias(name) for name, value in more.items()],
            )
        )

    @cached_property
    def bars(self) -> DataFrame:
        return self._ohlcv("symbol", "trade_date")

    @cached_property
    def bars_two_source(self) -> DataFrame:
        bars = self._ohlcv("symbol", "trade_date", "l_linestatus")
        source = F.when(F.col("l_linestatus") == "F", F.lit("kite")).otherwise(F.lit("yfinance"))
        return bars.withColumn("source", source).drop("l_linestatus")

    @cached_property
    def as_of(self) -> Column:
        return self.read("lineitem").select(F.max("l_shipdate").cast("date")).scalar()

    @cached_property
    def universe(self) -> DataFrame:
        s, n, r = self.read("supplier"), self.read("nation"), self.read("region")
        bucket = (
            F.when(F.col("s_acctbal") < 2000, F.lit("small"))
            .when(F.col("s_acctbal") < 6000, F.lit("mid"))
            .otherwise(F.lit("large"))
        )
        joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return joined.select(
            supplier_symbol("s_suppkey").alias("symbol"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            bucket.alias("market_cap_bucket"),
        )

    def _statement(self, *keys: str) -> DataFrame:
        li = self.lines.withColumns(
            {
                "fiscal_year": fiscal_year("trade_date"),
                "fiscal_quarter": fiscal_quarter("trade_date"),
                "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            }
        )
        ep, net, returned = F.col("l_extendedprice"), F.col("net"), F.col("l_returnflag") == "R"
        is_open = F.col("l_linestatus") == "O"
        sums = li.groupBy("symbol", *keys).agg(
            F.sum(net).alias("revenue"),
            F.sum(F.when(~returned, net)).alias("gross_profit"),
            F.sum(F.when(returned, net)).alias("cost_of_revenue"),
            F.sum(ep * F.col("l_tax")).alias("_tax"),
            F.sum(ep * F.col("l_discount")).alias("_disc"),
            F.sum(ep).alias("_ep"),
            F.sum(F.when(~is_open, net)).alias("_cash_in"),
            F.sum("l_quantity").alias("_qty"),
            F.sum(F.when(returned, ep)).alias("total_liabilities"),
            F.sum(F.when(is_open, ep)).alias("current_assets"),
            F.sum(F.when(returned & is_open, ep)).alias("current_liabilities"),
        )
        # Counted apart: with the sums, a distinct count would send every line and all its sums.
        parts = li.select(
            *[F.col(name).alias(f"_{name}") for name in ("symbol", *keys)], "l_partkey"
        ).distinct()
        shares = parts.groupBy(*[f"_{name}" for name in ("symbol", *keys)]).agg(
            F.count("l_partkey").cast("double").alias("shares_outstanding")
        )
        for name in ("symbol", *keys):
            of_same = F.col(name).eqNullSafe(F.col(f"_{name}"))
            same = of_same if name == "symbol" else same & of_same
        sums = sums.join(shares, same)
        ebit = F.col("gross_profit") - F.col("_tax")
        income = F.col("gross_profit") - F.col("_tax") - F.col("_disc")
        return sums.select(
            "symbol", *keys, "revenue", "gross_profit", "cost_of_revenue",
            ebit.alias("ebit"),
            (ebit + F.col("_ep") * 0.01).alias("ebitda"),
            income.alias("net_income"),
            (F.col("_cash_in") - F.col("_tax")).alias("operating_cash_flow"),
            (F.col("_ep") * -0.02).alias("capital_expenditure"),
            (F.col("revenue") + 100 * F.col("_qty")).alias("total_assets"),
            "total_liabilities", "current_assets", "current_liabilities", "shares_outstanding",
            F.try_divide(income, F.col("shares_outstanding")).alias("eps"),
        )

    @cached_property
    def annual(self) -> DataFrame:
        df = self._statement("fiscal_year")
        running = Window.partitionBy("symbol").orderBy("fiscal_year")
        equity = F.col("total_assets") - F.col("total_liabilities")
        return df.withColumns(
            {
                "retained_earnings": F.sum("net_income").over(
                    running.rowsBetween(Window.unboundedPreceding, 0)
                ),
                "period_end": period_end("fiscal_year"),
                "net_debt": F.col("total_liabilities") * 0.5 - F.col("current_assets") * 0.1,
                "book_value": equity,
                "free_cash_flow": F.lit(None).cast("double"),
                "interest_expense": F.col("total_liabilities") * -0.05,
                "accounts_receivable": F.col("current_assets") * 0.4,
                "inventory": F.col("current_assets") * 0.3,
                "accounts_payable": F.col("current_liabilities") * 0.5,
                "source": F.lit("derived"),
            }
        )

    @cached_property
    def quarterly(self) -> DataFrame:
        df = self._statement("fiscal_year", "fiscal_quarter")
        return df.withColumns(
            {"period_end": period_end("fiscal_year", "fiscal_quarter"), "source": F.lit("derived")}
        )

    @cached_property
    def annual_two_source(self) -> DataFrame:
        key = F.regexp_extract("symbol", r"(\d+)", 1).cast("long")
        factor = 1 + 0.03 * F.pmod(key, F.lit(4))
        first = self.annual.withColumn("source", F.lit("A"))
        second = self.annual.withColumns(
            {"source": F.lit("B"), "revenue": F.col("revenue") * factor}
        )
        return first.unionByName(second)

    @cached_property
    def splits(self) -> DataFrame:
        s = self.read("supplier").select("s_suppkey", supplier_symbol("s_suppkey").alias("symbol"))
        offset = (F.col("s_suppkey") % 1000).cast("int")
        first = s.where(F.col("s_suppkey") % 4 == 0).select(
            "symbol",
            F.date_add(F.lit("1998-01-01").cast("date"), offset).alias("ex_date"),
            F.lit(2.0).alias("value"),
        )
        second = s.where(F.col("s_suppkey") % 8 == 0).select(
            "symbol",
            F.date_add(F.lit("2000-01-01").cast("date"), offset).alias("ex_date"),
            F.lit(5.0).alias("value"),
        )
        return first.unionByName(second).withColumn("action_type", F.lit("split"))

    @staticmethod
    def _earnings_dates(days: DataFrame) -> DataFrame:
        return days.select(
            "symbol", period_end(fiscal_year("trade_date")).alias("event_date")
        ).distinct()

    @cached_property
    def earnings_dates(self) -> DataFrame:
        return self._earnings_dates(self.lines)

    @property
    def _delivered(self) -> Column:
        return F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))

    @staticmethod
    def _delivery_pct(kept: Column, traded: Column) -> Column:
        return F.try_divide(100.0 * F.coalesce(kept, F.lit(0.0)), traded).alias("delivery_pct")

    @cached_property
    def delivery(self) -> DataFrame:
        return self.lines.groupBy("symbol", "trade_date").agg(
            self._delivery_pct(F.sum(self._delivered), F.sum("l_quantity"))
        )

    @cached_property
    def market_flows(self) -> DataFrame:
        o = self.read("orders")
        who = F.when(
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("FII")
        ).otherwise(F.lit("DII"))
        price, status = F.col("o_totalprice"), F.col("o_orderstatus")
        sums = o.groupBy(
            F.col("o_orderdate").cast("date").alias("trade_date"), who.alias("participant")
        ).agg(
            (F.coalesce(F.sum(F.when(status == "O", price)), F.lit(0.0)) / 1e7).alias("buy_value_cr"),
            (F.coalesce(F.sum(F.when(status == "F", price)), F.lit(0.0)) / 1e7).alias("sell_value_cr"),
        )
        return sums.withColumn("net_value_cr", F.col("buy_value_cr") - F.col("sell_value_cr"))
