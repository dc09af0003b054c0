"""The driver tables in the role of the study's five input tables.

An order is a birth record: its customer is the mother, its week the week of birth. Lines of the order
shipped within the follow-up are hospital episodes; lines of odd and even number are answers at the
two visits, and orders often have several of them that disagree. Codes for "unknown" come from price bands and the priority
``4-NOT SPECIFIED``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itspark.functions.axis import study_window
from itspark.functions.recode import sentinel_to_null
from itspark.operators.link import SourceSpec, link_left
from itspark.plans.cohort import build_cohort
from itspark.plans.linkage import default_sources, link_cohort

FIRST_DAY = "1995-01-01"
# First day of week 210: the study weeks end before it. A date, so that the condition reaches the scan.
DAY_AFTER = "1999-01-03"
# Last week before the switch, and the first day after it.
SWITCH_WEEK = 105
SWITCH_DAY = "1997-01-05"
KEY = ("MOTHERID", "WEEKS_BEFORE_AFTER", "COHORT_IDENTIFIER")


def raw_week() -> Column:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit(FIRST_DAY).cast("date"))
    return (F.floor(days / 7) + 1).cast("int")


def _band(low: int, high: int) -> Column:
    price = F.col("o_totalprice")
    return (price >= low * 1000) & (price < high * 1000)


class Study:
    """Stand-in tables over one data folder; each file is opened once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._open: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._open[name]

    def all_records(self) -> DataFrame:
        """Every order, inside the study weeks or not, with the unknown priority as null."""
        known = sentinel_to_null(F.col("o_orderpriority"), "4-NOT SPECIFIED").alias("priority")
        return self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", known)

    def keyed_orders(self, whole: bool = False) -> DataFrame:
        """Orders of the study weeks, or all of them, with the linkage key of a birth record."""
        r, ordered = F.col("r"), F.col("o_orderdate")
        before = ordered < F.lit(SWITCH_DAY).cast("timestamp_ntz")
        key = {
            "MOTHERID": F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")),
            # Weeks count away from the switch in both arms; of the two distances one is positive.
            "WEEKS_BEFORE_AFTER": F.greatest(SWITCH_WEEK + 1 - r, r - SWITCH_WEEK).cast("int"),
            "COHORT_IDENTIFIER": F.when(before, "UNEXPOSED").otherwise("EXPOSED"),
        }
        orders = self.table("orders")
        if not whole:
            orders = orders.filter(ordered < F.lit(DAY_AFTER).cast("timestamp_ntz"))
        return orders.withColumn("r", raw_week()).withColumns(key)

    def records(self) -> DataFrame:
        """The orders alone on the study axis, under plain names, priority with its unknown code as null."""
        named = self.keyed_orders().select(
            "o_orderkey",
            "o_custkey",
            "o_orderstatus",
            "o_totalprice",
            sentinel_to_null(F.col("o_orderpriority"), "4-NOT SPECIFIED").alias("priority"),
            F.col("WEEKS_BEFORE_AFTER").alias("weeks_rel"),
            F.col("COHORT_IDENTIFIER").alias("cohort_id"),
        )
        return study_window(named)

    def labelled_documents(self) -> DataFrame:
        """Documents with the labels that exist for some of them."""
        documents = self.table("documents").select("doc_id", "lang", "source", "n_chars")
        return link_left(documents, self.table("labels"), ["doc_id"], na_matches=False)

    def sources(self) -> list[SourceSpec]:
        return default_sources(self.admissions("F"), self.admissions("O"), self.visits(1), self.visits(2))

    def linked(self, status: bool = False) -> DataFrame:
        return link_cohort(build_cohort(self.births()), self.sources(), status=status)

    def births(self) -> DataFrame:
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        customer = F.col("o_custkey")
        columns = {
            "num_of_births_this_pregnancy": F.when(_band(0, 10), 2).otherwise(1),
            "outcome_of_pregnancy_baby_1": F.when(_band(10, 15), 2).otherwise(1),
            "sex_baby_1": F.when(_band(485, 490), 0).when(_band(490, 495), 9)
            .otherwise((F.col("o_orderkey") % 2 + 1).cast("int")),
            "condition_on_discharge": F.when(_band(495, 1000), 4).otherwise(3),
            "APGAR_5_MINUTES_BABY_1": F.lit(None).cast("int"),
            "BIRTHWEIGHT_BABY_1": F.floor("o_totalprice").cast("int"),
            "FEED_ON_DISCHARGE_BABY1": F.when(_band(15, 20), 9).when(_band(20, 25), 3)
            .when(status == "F", 1).when(status == "O", 2).otherwise(4),
            "MARITAL_STATUS": F.lit(None).cast("int"),
            "TOTAL_PREVIOUS_PREGNANCIES": F.when(_band(25, 30), 99).when(_band(30, 35), 16)
            .when(_band(35, 36), 15).otherwise((customer % 4).cast("int")),
            "BOOKING_SMOKING_HISTORY": F.when(priority == "4-NOT SPECIFIED", 9).when(priority == "1-URGENT", 1)
            .when(priority == "5-LOW", 2).otherwise(0),
            "SMOKER_DURING_PREGNANCY": F.when(_band(36, 40), 9).when(status == "F", 1).otherwise(0),
            "MODE_OF_DELIVERY_BABY_1": F.lit(None).cast("int"),
            "ETHNIC_GROUP": F.lit(None).cast("int"),
            "MOTHER_AGE_GRPS": F.concat(F.lit("band "), F.floor(F.col("o_totalprice") / 100000).cast("string")),
            "simd2016_sc_quintile": (customer % 5 + 1).cast("int"),
        }
        return self.keyed_orders().select(*KEY, *[c.alias(name) for name, c in columns.items()])

    def admissions(self, status: str) -> DataFrame:
        """Lines of one status within 26 and 52 weeks of the order, per order that has any line of it.

        Lines are counted per order and ship date before they meet the orders, so an order with very many
        lines is a few thousand rows in the join.
        """
        lines = self.table("lineitem").filter(F.col("l_linestatus") == status)
        per_day = lines.groupBy("l_orderkey", "l_shipdate").agg(F.count(F.lit(1)).alias("n"))
        orders = self.keyed_orders().select("o_orderkey", "o_orderdate", *KEY)
        lag = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))

        def within(days: int) -> Column:
            return F.coalesce(F.sum(F.when((lag >= 0) & (lag < days), F.col("n"))), F.lit(0)).cast("int")

        counts = orders.join(per_day, F.col("o_orderkey") == F.col("l_orderkey"), "inner").groupBy("o_orderkey", *KEY)
        return counts.agg(
            within(182).alias("EPISODES_WITHIN_26_WEEKS"), within(364).alias("EPISODES_WITHIN_52_WEEKS")
        ).drop("o_orderkey")

    def visits(self, number: int) -> DataFrame:
        """Answers given at visit ``number``: the lines of odd or even number, each a record of its own."""
        flag, status, discount, quantity = (
            F.col(c) for c in ("l_returnflag", "l_linestatus", "l_discount", "l_quantity")
        )
        answers = {
            "smoker_pc": F.when(flag == "R", "Y").when(flag == "A", "N").otherwise("Unknown/Invalid"),
            "second_hand_smoke": F.when(discount > 0, F.when(status == "F", "Y").otherwise("N")),
            "feed_2016": F.when(quantity <= 15, "Breast").when(quantity <= 35, "Formula")
            .when(quantity <= 45, "Mixed").otherwise("Unknown/Invalid"),
            "sleep_pr": F.when(flag == "R", "Y").when(flag == "A", "N"),
            "sleep_su": F.when(status == "F", "Y").otherwise("N"),
            "sleep_si": F.when(discount > 0.05, "Y").when(discount > 0, "N"),
        }
        lines = self.table("lineitem").filter(F.col("l_linenumber") % 2 == number % 2)
        given = lines.select("l_orderkey", *[c.alias(name) for name, c in answers.items()])
        orders = self.keyed_orders().select("o_orderkey", *KEY)
        return orders.join(given, F.col("o_orderkey") == F.col("l_orderkey"), "inner").select(*KEY, *answers)
