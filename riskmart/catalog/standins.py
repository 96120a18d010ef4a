"""Raw mart sources derived from the given tables.

The tables hold no loans, so each raw source is a projection of whole tables:
line items with their orders play loan months, customers and orders play
customer finances and attributes, events play click features. Text noise of the
kind the cleaning rules expect is derived from integer keys. The select lists
are plain SQL that Spark and the checking engine both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(cents: str) -> str:
    """Text of an amount given in whole cents."""
    return f"CAST(CAST({cents} AS DECIMAL(18, 0)) * 0.01 AS STRING)"


LOAN_COLUMNS = [
    "CAST(l_orderkey AS STRING) AS loan_id",
    "CAST(o_custkey AS STRING) AS Customer_ID",
    "CAST(o_orderdate AS DATE) AS loan_start_date",
    "CAST(l_quantity AS INT) AS tenure",
    "l_linenumber AS installment_num",
    "l_extendedprice AS loan_amt",
    # Some instalments are so small that the overdue amount covers tens of thousands of years of them.
    "CASE WHEN l_partkey % 89 = 0 THEN NULL WHEN l_partkey % 83 = 0 THEN 0.01 "
    "ELSE l_extendedprice * l_tax END AS due_amt",
    "l_quantity AS paid_amt",
    "CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_extendedprice * l_discount END AS overdue_amt",
    "o_totalprice AS balance",
    "CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date",
]

# A date in either of the two text forms, from a key k.
DATE_TEXT = (
    "CASE WHEN k % 3 = 0 THEN CAST(2023 + k % 2 AS STRING) || '-' || "
    "lpad(CAST(1 + k % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + k % 28 AS STRING), 2, '0') "
    "WHEN k % 53 = 0 THEN 'soon' WHEN k % 59 = 0 THEN NULL "
    "ELSE CAST(1 + k % 28 AS STRING) || '/' || CAST(1 + k % 12 AS STRING) || '/' || "
    "CAST(2023 + k % 2 AS STRING) END"
)

# Finances from (k, cust, c): an integer key, the customer, an amount in cents.
FINANCIAL_COLUMNS = [
    "CAST(cust AS STRING) AS Customer_ID",
    "CASE WHEN k % 41 = 0 THEN 'NA' WHEN k % 43 = 0 THEN 'nan' WHEN k % 47 = 0 THEN '' "
    f"WHEN k % 37 = 0 THEN NULL WHEN k % 5 = 0 THEN {money('c')} || '_' ELSE {money('c')} END "
    "AS Annual_Income",
    f"CASE WHEN k % 31 = 0 THEN NULL WHEN k % 29 = 0 THEN '0' ELSE {money('c % 1200000')} END "
    "AS Monthly_Inhand_Salary",
    "CASE WHEN k % 53 = 0 THEN '-1' WHEN k % 59 = 0 THEN NULL WHEN k % 151 = 0 THEN '10.5' "
    "WHEN k % 149 = 0 THEN '9.5' ELSE CAST(k % 12 AS STRING) END "
    "AS Num_Bank_Accounts",
    "CASE WHEN k % 61 = 0 THEN 'abc' WHEN k % 67 = 0 THEN NULL WHEN k % 71 = 0 THEN '1499' "
    "ELSE CAST(k % 22 AS STRING) END AS Num_Credit_Card",
    "CASE WHEN k % 73 = 0 THEN '5797' WHEN k % 4 = 0 THEN CAST(k % 35 AS STRING) || '.75' "
    "ELSE CAST(k % 35 AS STRING) END AS Interest_Rate",
    "CASE WHEN k % 17 = 0 THEN '-100' WHEN k % 79 = 0 THEN NULL WHEN k % 83 = 0 THEN '1447' "
    "WHEN k % 19 = 0 THEN CAST(k % 10 AS STRING) || '_' ELSE CAST(k % 10 AS STRING) END "
    "AS Num_of_Loan",
    "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '' WHEN k % 2 = 0 THEN 'Auto Loan' "
    "ELSE 'Student Loan, and Payday Loan' END AS Type_of_Loan",
    "CASE WHEN k % 83 = 0 THEN NULL WHEN k % 157 = 0 THEN '-0.5' ELSE CAST(k % 65 - 3 AS STRING) END AS Delay_from_due_date",
    "CASE WHEN k % 89 = 0 THEN '4344' WHEN k % 97 = 0 THEN NULL "
    "WHEN k % 7 = 0 THEN CAST(k % 28 AS STRING) || '_' ELSE CAST(k % 28 - 1 AS STRING) END "
    "AS Num_of_Delayed_Payment",
    f"CASE WHEN k % 101 = 0 THEN '_' WHEN k % 6 = 0 THEN '-' || {money('c % 3000')} "
    f"ELSE {money('c % 3000')} END AS Changed_Credit_Limit",
    "CASE WHEN k % 103 = 0 THEN NULL WHEN k % 107 = 0 THEN '2589' WHEN k % 139 = 0 THEN '50.5' "
    "ELSE CAST(k % 20 - 2 AS STRING) END AS Num_Credit_Inquiries",
    "CASE k % 5 WHEN 0 THEN '_' WHEN 1 THEN 'Good' WHEN 2 THEN 'Bad' ELSE 'Standard' END "
    "AS Credit_Mix",
    f"CASE WHEN k % 9 = 0 THEN {money('c % 500000')} || '_' ELSE {money('c % 500000')} END "
    "AS Outstanding_Debt",
    f"{money('2000 + c % 3000')} AS Credit_Utilization_Ratio",
    "CASE WHEN k % 23 = 0 THEN NULL WHEN k % 109 = 0 THEN 'NA' "
    "ELSE CAST(k % 33 AS STRING) || ' Years and ' || CAST(k % 12 AS STRING) || ' Months' END "
    "AS Credit_History_Age",
    "CASE k % 3 WHEN 0 THEN 'NM' WHEN 1 THEN 'Yes' ELSE 'No' END AS Payment_of_Min_Amount",
    f"CASE WHEN k % 113 = 0 THEN '-' || {money('c % 40000')} ELSE {money('c % 40000')} END "
    "AS Total_EMI_per_month",
    "CASE WHEN k % 25 = 0 THEN '__10000__' WHEN k % 127 = 0 THEN NULL "
    f"ELSE {money('c % 90000')} END AS Amount_invested_monthly",
    "CASE k % 7 WHEN 0 THEN '!@9#%8' WHEN 1 THEN 'High_spent_Small_value_payments' "
    "WHEN 2 THEN 'Low_spent_Large_value_payments' WHEN 3 THEN 'High_spent_Large_value_payments' "
    "ELSE 'Low_spent_Small_value_payments' END AS Payment_Behaviour",
    "CASE WHEN k % 131 = 0 THEN '__-333333333333333333333333333__' WHEN k % 10 = 0 THEN '-5.25' "
    f"WHEN k % 137 = 0 THEN NULL WHEN k % 14 = 0 THEN '_' || {money('c % 150000')} "
    f"ELSE {money('c % 150000')} END AS Monthly_Balance",
    f"{DATE_TEXT} AS snapshot_date",
]

ORDER_KEYS = [
    "o_orderkey AS k",
    "o_custkey AS cust",
    "CAST(round(o_totalprice * 100) AS BIGINT) AS c",
]
CUSTOMER_KEYS = [
    "c_custkey AS k",
    "c_custkey AS cust",
    "CAST(round(c_acctbal * 100) AS BIGINT) + 100000 AS c",
]

# Attributes from a customer row.
ATTRIBUTE_COLUMNS = [
    "CAST(c_custkey AS STRING) AS Customer_ID",
    "c_name AS Name",
    "'821-00-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS SSN",
    "CASE WHEN c_custkey % 13 = 0 THEN '-500' WHEN c_custkey % 17 = 0 THEN NULL "
    "WHEN c_custkey % 23 = 0 THEN '150' "
    "WHEN c_custkey % 19 = 0 THEN CAST(18 + CAST(round((c_acctbal + 1000) * 100) AS BIGINT) % 60 "
    "AS STRING) || '_' "
    "ELSE CAST(18 + CAST(round((c_acctbal + 1000) * 100) AS BIGINT) % 60 AS STRING) END AS Age",
    "CASE WHEN c_custkey % 8 = 0 THEN '_______' WHEN c_custkey % 21 = 0 THEN NULL "
    "ELSE c_mktsegment END AS Occupation",
    "CAST(1 + c_custkey % 28 AS STRING) || '/7/2023' AS snapshot_date",
]

# Events are spread over the months the loans cover.
CLICK_KEYS = [
    "CAST(user_id AS STRING) AS Customer_ID",
    "make_date(1995 + CAST(floor((event_id % 84) / 12) AS INT), 1 + CAST(event_id % 12 AS INT), 1)"
    " AS snapshot_date",
    "event_id AS e",
]
CLICK_SUMS = [
    f"CASE WHEN sum(e) % {40 + i} = 0 THEN 'n/a' "
    f"ELSE CAST(sum((e * {2 * i + 1}) % 31 - 15) AS STRING) END AS fe_{i}"
    for i in range(1, 21)
]

# A score that rises with the overdue share, from all line items.
SCORE = (
    "CAST((l_orderkey * 7919 + l_partkey * 104729) % 400003 AS DOUBLE) / 1000003 "
    "+ l_discount * 5 AS model_predictions"
)
PREDICTION_COLUMNS = [
    "CAST(o_custkey AS STRING) AS Customer_ID",
    "CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date",
    SCORE,
]
DOCUMENT_COLUMNS = [
    "make_date(2024, 1 + CAST(doc_id % 12 AS INT), 1) AS snapshot_date",
    "CAST(n_chars % 1000 AS DOUBLE) / 1000 AS model_predictions",
    "quality AS label",
]


# Arrivals of a month's four sources, one per line number and month: some come weeks late, some never.
ARRIVALS_SQL = (
    "SELECT k, snapshot_date, first_day, months, CASE WHEN k = 3 AND months % 5 = 0 THEN 40 ELSE k * 2 END AS delay FROM ("
    "SELECT l_linenumber % 4 AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date, "
    "min(CAST(l_shipdate AS DATE)) AS first_day, max(year(l_shipdate) * 12 + month(l_shipdate)) AS months "
    "FROM lineitem GROUP BY 1, 2) AS grouped WHERE NOT (k = 2 AND months % 7 = 0)"
)


def _select(columns: list[str], source: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
LOANS_SQL = _select(LOAN_COLUMNS, LINES)
ORDER_FINANCES_SQL = _select(FINANCIAL_COLUMNS, f"({_select(ORDER_KEYS, 'orders')}) AS keyed")
CUSTOMER_FINANCES_SQL = _select(
    FINANCIAL_COLUMNS, f"({_select(CUSTOMER_KEYS, 'customer')}) AS keyed"
)
ATTRIBUTES_SQL = _select(ATTRIBUTE_COLUMNS, "customer")
CLICKS_SQL = (
    _select(
        ["Customer_ID", "snapshot_date", *CLICK_SUMS], f"({_select(CLICK_KEYS, 'events')}) AS keyed"
    )
    + " GROUP BY Customer_ID, snapshot_date"
)
PREDICTIONS_SQL = _select(PREDICTION_COLUMNS, LINES)
SCORED_DOCUMENTS_SQL = _select(
    DOCUMENT_COLUMNS, "(SELECT labels.doc_id, quality, n_chars FROM labels "
    "JOIN documents ON labels.doc_id = documents.doc_id) AS joined"
)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )


def loans_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).selectExpr(*LOAN_COLUMNS)


def order_finances_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*ORDER_KEYS).selectExpr(*FINANCIAL_COLUMNS)


def customer_finances_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "customer").selectExpr(*CUSTOMER_KEYS)
    return keyed.selectExpr(*FINANCIAL_COLUMNS)


def attributes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*ATTRIBUTE_COLUMNS)


def clicks_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Most customers have one event a month: the events are shuffled, three columns, and not their sums.
    keyed = table(spark, sf_dir, "events").selectExpr(*CLICK_KEYS).repartition("Customer_ID", "snapshot_date")
    return keyed.groupBy("Customer_ID", "snapshot_date").agg(*[F.expr(s) for s in CLICK_SUMS])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).selectExpr(*PREDICTION_COLUMNS)


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return joined.selectExpr(*DOCUMENT_COLUMNS)


def source_arrivals(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(source, snapshot_date, arrived_at)."""
    lines = table(spark, sf_dir, "lineitem")
    month = F.trunc("l_shipdate", "month").alias("snapshot_date")
    grouped = lines.groupBy((F.col("l_linenumber") % 4).alias("k"), month).agg(
        F.min(F.to_date("l_shipdate")).alias("first_day"),
        F.max(F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("months"),
    )
    kept = grouped.where("not (k = 2 and months % 7 = 0)")
    delay = F.when((F.col("k") == 3) & (F.col("months") % 5 == 0), 40).otherwise(F.col("k") * 2)
    source = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1)
    return kept.select(source.alias("source"), "snapshot_date", F.date_add("first_day", delay).cast("timestamp").alias("arrived_at"))
