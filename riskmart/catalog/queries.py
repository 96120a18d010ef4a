"""Registered queries: each runs a library operator over whole given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart import functions as rf
from riskmart.catalog import oracles as o
from riskmart.catalog import standins as s
from riskmart.operators import drift, encoding, gold, joins, metrics, profiling, quantiles
from riskmart.operators import scaling, silver, splitting
from riskmart.plans import mart as mart_jobs
from riskmart.plans import changes, monitoring, scoring, training
from riskmart.plans.layout import Mart
from riskmart.sources import (
    overwrite_snapshots,
    overwrite_table,
    read_merged,
    read_range,
    read_table,
    working_folder,
)
from riskmart.sources.session import tune
from riskmart.sources.schemas import (
    ATTRIBUTE_CATEGORIES,
    CLICK_FEATURES,
    CLICKSTREAM_RAW_SCHEMA,
    FINANCIAL_CATEGORIES,
    LOAN_TYPES,
)
from riskmart.streaming import ingest, readiness

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# A search space of small trees: several points are drawn, each is fitted on three folds.
CHECK_GRID = {"n_estimators": [2, 4], "max_depth": [2, 3], "learning_rate": [0.1, 0.3], "scale_pos_weight": [1, 3]}
CHECK_DRAWS = 3
# More points, halved from two trees on: 20 on two trees, 7 on up to six, 3 on up to eight.
HALVING_GRID = {**CHECK_GRID, "n_estimators": [2, 4, 8], "subsample": [0.8, 1.0]}
HALVING_DRAWS = 20

TRAIN_DATE = dt.date(1999, 1, 1)
BASELINE = dt.date.fromisoformat(o.BASELINE)
SWEEP = [(30, 3), (60, 3), (30, 6), (90, 6), (150, 7)]


def query(name: str, oracle: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def shown(df: DataFrame) -> DataFrame:
    """Dates as text and floating point numbers with six digits, for comparing engines."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            c = c.cast("double")
            # Rounding goes by decimals; a whole number (and what is not finite) is its own. + 0.0 has no -0.0 left.
            c = F.when(F.rint(c) == c, c + F.lit(0.0)).otherwise(F.round(c, 6))
        out.append(c.alias(field.name))
    return df.select(*out)


def shown_loans(df: DataFrame) -> DataFrame:
    """As shown(), with the first missed date as days since 1970: engines write far years differently."""
    days = F.datediff(F.col("first_missed_date"), F.lit(dt.date(1970, 1, 1)))
    return shown(df.withColumn("first_missed_date", days))


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.silver_loan(s.loans_raw(spark, sf_dir))


# --- loans -----------------------------------------------------------------


@query("silver_loan", o.with_(*o.LOANS) + f"SELECT {o.LOAN_OUT} FROM loans")
def silver_loan(spark, sf_dir):
    return shown_loans(loans(spark, sf_dir))


@query("fill_all_numeric", o.with_(*o.LOANS_FILLED) + f"SELECT {o.LOAN_OUT} FROM loans")
def fill_all_numeric(spark, sf_dir):
    return shown_loans(silver.silver_loan(s.loans_raw(spark, sf_dir), fill_numeric=True))


@query(
    "gold_label_store",
    o.with_(*o.LOANS, o.LABELS)
    + f"SELECT loan_id, Customer_ID, label, label_def, {o.day()} FROM labels_at",
)
def gold_label_store(spark, sf_dir):
    return shown(gold.gold_labels(loans(spark, sf_dir)))


@query(
    "label_definition_sweep",
    o.with_(*o.LOANS)
    + " UNION ALL ".join(
        f"SELECT {o.day()}, '{d}dpd_{m}mob' AS label_def, count(*) AS loans, "
        f"count(*) FILTER (dpd >= {d}) AS bads FROM loans WHERE mob = {m} GROUP BY snapshot_date"
        for d, m in SWEEP
    ),
)
def label_definition_sweep(spark, sf_dir):
    return shown(gold.label_sweep(loans(spark, sf_dir), SWEEP))


@query(
    "gold_loan_features",
    o.with_(*o.LOANS, o.LOAN_FEATURES)
    + f"SELECT loan_id, Customer_ID, {o.r6('payment_ratio')}, {o.r6('overdue_ratio')}, balance, "
    f"{o.day()}, installments_missed, dpd FROM loan_features",
)
def gold_loan_features(spark, sf_dir):
    return shown(gold.gold_loan_features(loans(spark, sf_dir)))


@query(
    "bad_rate_by_mob",
    o.with_(*o.LOANS)
    + f"SELECT mob, {o.r6('avg(CASE WHEN dpd >= 30 THEN 1 ELSE 0 END)', 'bad_rate')}, "
    "count(*) AS n, CAST(count(*) FILTER (dpd >= 30) AS BIGINT) AS bads FROM loans "
    "WHERE loan_start_date < DATE '1998-01-01' GROUP BY mob",
)
def bad_rate_by_mob(spark, sf_dir):
    return shown(metrics.bad_rate_by_mob(loans(spark, sf_dir), dt.date(1998, 1, 1)))


@query(
    "snapshot_filter",
    o.with_(*o.LOANS)
    + f"SELECT {o.LOAN_OUT} FROM loans WHERE snapshot_date = DATE '1998-06-01'",
)
def snapshot_filter(spark, sf_dir):
    return shown_loans(silver.at_snapshot(loans(spark, sf_dir), dt.date(1998, 6, 1)))


@query(
    "window_range_filter",
    o.with_(*o.LOANS)
    + f"SELECT {o.day()}, CASE WHEN snapshot_date <= DATE '1998-11-30' THEN 'train_test' "
    "ELSE 'oot' END AS part, count(*) AS n FROM loans "
    "WHERE snapshot_date BETWEEN DATE '1997-12-01' AND DATE '1998-12-31' GROUP BY snapshot_date",
)
def window_range_filter(spark, sf_dir):
    windows = splitting.training_windows(TRAIN_DATE)
    part = splitting.window_of(windows, F.col("snapshot_date"))
    rows = loans(spark, sf_dir).select("snapshot_date", part.alias("part"))
    return shown(
        rows.where(F.col("part").isNotNull())
        .groupBy("snapshot_date", "part")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "month_series",
    "WITH span AS (SELECT o_custkey, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS a, "
    "CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY o_custkey) "
    "SELECT o_custkey, CAST(CAST(unnest(generate_series(CAST(a AS TIMESTAMP), "
    "CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS VARCHAR) AS month FROM span",
)
def month_series(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    span = s.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min(day).alias("a"), F.max(day).alias("b")
    )
    months = rf.month_series(F.col("a"), F.col("b"))
    return shown(span.select("o_custkey", F.explode(months).alias("month")))


# --- scalar rules ----------------------------------------------------------


@query(
    "range_to_null",
    f"WITH raw AS ({s.ORDER_FINANCES_SQL}) SELECT Customer_ID, "
    + o.between(o.integer(o.digits(o.stripped("Num_of_Loan"))), 0, 50)
    + " AS loans, "
    + o.between(o.integer(o.digits(o.stripped("Num_of_Delayed_Payment"))), 0, 100)
    + " AS delayed, "
    + f"CASE WHEN {o.integer('Delay_from_due_date')} >= 0 THEN {o.integer('Delay_from_due_date')} "
    "END AS delay, "
    + f"CASE WHEN {o.integer('Num_Credit_Inquiries')} <= 50 THEN "
    f"{o.integer('Num_Credit_Inquiries')} END AS inquiries FROM raw",
)
def range_to_null(spark, sf_dir):
    raw = s.order_finances_raw(spark, sf_dir)

    def whole(name):
        return rf.text_to_int(rf.keep_if_digits(rf.strip_underscores(F.col(name))))

    return raw.select(
        "Customer_ID",
        rf.null_outside(whole("Num_of_Loan"), 0, 50).alias("loans"),
        rf.null_outside(whole("Num_of_Delayed_Payment"), 0, 100).alias("delayed"),
        rf.null_outside(rf.text_to_int(F.col("Delay_from_due_date")), 0).alias("delay"),
        rf.null_outside(rf.text_to_int(F.col("Num_Credit_Inquiries")), None, 50).alias("inquiries"),
    )


@query(
    "token_defaults",
    f"WITH raw AS ({s.ORDER_FINANCES_SQL}) SELECT Customer_ID, "
    "CASE WHEN Credit_Mix = '_' THEN 'Unknown' ELSE Credit_Mix END AS mix, "
    "CASE WHEN Payment_of_Min_Amount = 'NM' THEN 'Unknown' ELSE Payment_of_Min_Amount END AS pay, "
    "CASE WHEN Payment_Behaviour = '!@9#%8' THEN 'Unknown' ELSE Payment_Behaviour END AS behaviour, "
    "CASE WHEN Amount_invested_monthly = '__10000__' THEN '0' ELSE Amount_invested_monthly END "
    "AS invested, "
    "CASE WHEN Annual_Income IN ('NA', 'nan', '') THEN '0' ELSE Annual_Income END AS income, "
    "CASE WHEN Type_of_Loan IS NULL OR Type_of_Loan = '' THEN 'Unknown' ELSE Type_of_Loan END "
    "AS loan_type FROM raw",
)
def token_defaults(spark, sf_dir):
    return s.order_finances_raw(spark, sf_dir).select(
        "Customer_ID",
        rf.tokens_to(F.col("Credit_Mix"), ["_"], "Unknown").alias("mix"),
        rf.tokens_to(F.col("Payment_of_Min_Amount"), ["NM"], "Unknown").alias("pay"),
        rf.tokens_to(F.col("Payment_Behaviour"), ["!@9#%8"], "Unknown").alias("behaviour"),
        rf.tokens_to(F.col("Amount_invested_monthly"), ["__10000__"], "0").alias("invested"),
        rf.tokens_to(F.col("Annual_Income"), silver.INCOME_BLANKS, "0").alias("income"),
        rf.blank_to(F.col("Type_of_Loan"), "Unknown").alias("loan_type"),
    )


@query(
    "strip_and_cast",
    f"WITH raw AS ({s.ORDER_FINANCES_SQL}) SELECT Customer_ID, "
    + o.r6(o.real(o.stripped("Outstanding_Debt")), "debt")
    + ", "
    + o.integer(o.stripped("Outstanding_Debt"))
    + " AS whole_debt, "
    + o.r6(o.double("Interest_Rate"), "rate")
    + ", "
    + o.integer("Interest_Rate")
    + " AS whole_rate, "
    + o.integer("Num_of_Loan")
    + " AS loans_as_is FROM raw",
)
def strip_and_cast(spark, sf_dir):
    debt = rf.strip_underscores(F.col("Outstanding_Debt"))
    return shown(
        s.order_finances_raw(spark, sf_dir).select(
            "Customer_ID",
            rf.text_to_float(debt).alias("debt"),
            rf.text_to_int(debt).alias("whole_debt"),
            rf.text_to_double(F.col("Interest_Rate")).alias("rate"),
            rf.text_to_int(F.col("Interest_Rate")).alias("whole_rate"),
            rf.text_to_int(F.col("Num_of_Loan")).alias("loans_as_is"),
        )
    )


@query(
    "regex_validate",
    f"WITH raw AS ({s.ORDER_FINANCES_SQL}) SELECT Customer_ID, "
    + o.digits("Num_Credit_Card")
    + " AS cards, CASE WHEN regexp_full_match(Changed_Credit_Limit, '-?[0-9]+([.][0-9]+)?') "
    "THEN Changed_Credit_Limit END AS credit_limit, "
    "CASE WHEN NOT contains(Monthly_Balance, '__') THEN Monthly_Balance END AS unmasked FROM raw",
)
def regex_validate(spark, sf_dir):
    return s.order_finances_raw(spark, sf_dir).select(
        "Customer_ID",
        rf.keep_if_digits(F.col("Num_Credit_Card")).alias("cards"),
        rf.keep_if_signed_decimal(F.col("Changed_Credit_Limit")).alias("credit_limit"),
        rf.mask_to_null(F.col("Monthly_Balance"), "__").alias("unmasked"),
    )


@query(
    "history_months",
    f"WITH raw AS ({s.ORDER_FINANCES_SQL}) SELECT Customer_ID, Credit_History_Age, "
    "TRY_CAST(regexp_extract(Credit_History_Age, '([0-9]+)\\s*Years', 1) AS INTEGER) * 12 + "
    "TRY_CAST(regexp_extract(Credit_History_Age, '([0-9]+)\\s*Months', 1) AS INTEGER) AS months "
    "FROM raw",
)
def history_months(spark, sf_dir):
    return s.order_finances_raw(spark, sf_dir).select(
        "Customer_ID",
        "Credit_History_Age",
        rf.history_months(F.col("Credit_History_Age")).alias("months"),
    )


@query(
    "date_parse_mixed",
    f"WITH raw AS ({s.ORDER_FINANCES_SQL}) SELECT Customer_ID, snapshot_date AS source_text, "
    f"CAST({o.date_of('snapshot_date')} AS VARCHAR) AS parsed FROM raw",
)
def date_parse_mixed(spark, sf_dir):
    return shown(
        s.order_finances_raw(spark, sf_dir).select(
            "Customer_ID",
            F.col("snapshot_date").alias("source_text"),
            rf.parse_date(F.col("snapshot_date")).alias("parsed"),
        )
    )


@query(
    "upper_bound_filters",
    f"WITH raw AS ({s.ORDER_FINANCES_SQL}) SELECT Customer_ID, "
    f"{o.integer('Num_Bank_Accounts')} AS accounts, {o.integer('Interest_Rate')} AS rate, "
    f"{o.integer('Delay_from_due_date')} AS delay FROM raw "
    f"WHERE {o.integer('Num_Bank_Accounts')} <= 10 AND {o.integer('Interest_Rate')} <= 100 "
    f"AND {o.integer('Delay_from_due_date')} IS NOT NULL",
)
def upper_bound_filters(spark, sf_dir):
    typed = s.order_finances_raw(spark, sf_dir).select(
        "Customer_ID",
        rf.text_to_int(F.col("Num_Bank_Accounts")).alias("accounts"),
        rf.text_to_int(F.col("Interest_Rate")).alias("rate"),
        rf.text_to_int(F.col("Delay_from_due_date")).alias("delay"),
    )
    return typed.where(
        (F.col("accounts") <= 10) & (F.col("rate") <= 100) & F.col("delay").isNotNull()
    )


@query(
    "guarded_ratio",
    "SELECT l_orderkey, l_linenumber, "
    + o.r6("CAST(CASE WHEN l_discount <> 0 THEN l_tax / l_discount ELSE 0 END AS FLOAT)", "ratio")
    + ", CAST(CASE WHEN l_tax <> 0 THEN ceil(l_discount / l_tax) ELSE 0 END AS INTEGER) AS missed "
    "FROM lineitem",
)
def guarded_ratio(spark, sf_dir):
    tax, discount = F.col("l_tax"), F.col("l_discount")
    return shown(
        s.table(spark, sf_dir, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            rf.ratio_or_zero(tax, discount).alias("ratio"),
            rf.instalments_missed(discount, tax).alias("missed"),
        )
    )


# --- silver and gold of the other sources ----------------------------------


@query(
    "clip_features",
    o.with_(*o.CLICKS) + f"SELECT Customer_ID, {o.day()}, {', '.join(CLICK_FEATURES)} FROM clicks",
)
def clip_features(spark, sf_dir):
    return shown(silver.silver_clickstream(s.clicks_raw(spark, sf_dir)))


@query(
    "gold_clickstream",
    o.with_(*o.CLICKS) + f"SELECT {', '.join(CLICK_FEATURES)}, Customer_ID, {o.day()} FROM clicks",
)
def gold_clickstream(spark, sf_dir):
    return shown(gold.gold_clickstream(silver.silver_clickstream(s.clicks_raw(spark, sf_dir))))


@query(
    "drop_pii_median_age",
    o.with_(*o.ATTRIBUTES) + f"SELECT Customer_ID, Age, Occupation, {o.day()} FROM attributes",
)
def drop_pii_median_age(spark, sf_dir):
    return shown(silver.silver_attributes(s.attributes_raw(spark, sf_dir)))


@query(
    "financials_rules",
    o.with_(*o.finances(s.ORDER_FINANCES_SQL))
    + f"SELECT {o.FINANCE_OUT}, {o.r6('Interest_Rate')} FROM finances",
)
def financials_rules(spark, sf_dir):
    return shown(silver.silver_financials(s.order_finances_raw(spark, sf_dir)))


@query(
    "financials_rules_capped_rate",
    o.with_(*o.finances(s.ORDER_FINANCES_SQL, 100))
    + f"SELECT {o.FINANCE_OUT}, Interest_Rate FROM finances",
)
def financials_rules_capped_rate(spark, sf_dir):
    raw = s.order_finances_raw(spark, sf_dir)
    return shown(silver.silver_financials(raw, max_interest_rate=100))


@query(
    "financials_losses",
    o.with_(*o.finances(s.ORDER_FINANCES_SQL, 100)) + o.finance_losses(100),
)
def financials_losses(spark, sf_dir):
    """What each rule drops, observed by the job that writes the cleaned rows."""
    root = working_folder(spark, "finances")
    raw = s.order_finances_raw(spark, sf_dir)
    mart_jobs.financials_job(raw, f"{root}/silver", f"{root}/losses", max_interest_rate=100)
    return read_table(spark, f"{root}/losses")


def _finances(spark, sf_dir):
    return silver.silver_financials(s.customer_finances_raw(spark, sf_dir))


def _attributes(spark, sf_dir):
    return silver.silver_attributes(s.attributes_raw(spark, sf_dir))


@query(
    "gold_financials",
    o.with_(*o.finances(s.CUSTOMER_FINANCES_SQL), *o.GOLD_FINANCES)
    + f"SELECT Customer_ID, {', '.join(o.GOLD_FINANCE_OUT)} FROM gold_finances",
)
def gold_financials(spark, sf_dir):
    finances = _finances(spark, sf_dir)
    return shown(
        gold.gold_financials(finances, encoding.fit_vocabulary(finances, FINANCIAL_CATEGORIES))
    )


@query(
    "one_hot",
    o.with_(*o.ATTRIBUTES, *o.GOLD_ATTRIBUTES) + "SELECT * FROM gold_attributes",
)
def one_hot(spark, sf_dir):
    attributes = _attributes(spark, sf_dir)
    vocabulary = encoding.fit_vocabulary(attributes, ATTRIBUTE_CATEGORIES)
    return gold.gold_attributes(attributes, vocabulary)


@query(
    "one_hot_vector_expand",
    "WITH rank_o_orderpriority AS (SELECT o_orderpriority AS category, "
    "row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS idx FROM orders "
    "GROUP BY o_orderpriority) SELECT o_orderkey, "
    + ", ".join(o.flags("o_orderpriority", 5))
    + " FROM orders",
)
def one_hot_vector_expand(spark, sf_dir):
    orders = s.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    names = encoding.fit_vocabulary(orders, ["o_orderpriority"])["o_orderpriority"]
    vectors = encoding.one_hot_vector(orders, "o_orderpriority", names).drop("o_orderpriority")
    return encoding.expand_vector(vectors, "o_orderpriority_ohe", len(names))


@query(
    "category_ranks",
    "SELECT 'o_orderpriority' AS feature, o_orderpriority AS category, count(*) AS n "
    "FROM orders GROUP BY ALL UNION ALL "
    "SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY ALL",
)
def category_ranks(spark, sf_dir):
    return encoding.category_ranks(
        s.table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"]
    )


def _store(spark, sf_dir):
    finances, attributes = _finances(spark, sf_dir), _attributes(spark, sf_dir)
    return gold.feature_store(
        gold.gold_loan_features(loans(spark, sf_dir)),
        gold.gold_financials(finances, encoding.fit_vocabulary(finances, FINANCIAL_CATEGORIES)),
        gold.gold_attributes(attributes, encoding.fit_vocabulary(attributes, ATTRIBUTE_CATEGORIES)),
        gold.gold_clickstream(silver.silver_clickstream(s.clicks_raw(spark, sf_dir))),
    )


@query("feature_store_join", o.with_(*o.STORE) + f"SELECT {o.STORE_OUT} FROM store")
def feature_store_join(spark, sf_dir):
    return shown(_store(spark, sf_dir))


@query(
    "training_join_dropna",
    o.with_(*o.STORE, o.LABELS)
    + "SELECT l.loan_id, l.Customer_ID, CAST(l.snapshot_date AS VARCHAR) AS snapshot_date, "
    "l.label, f.balance, f.Age, f.Num_of_Loan, f.fe_1, f.fe_20 FROM labels_at AS l "
    "JOIN store AS f ON l.Customer_ID = f.Customer_ID AND l.snapshot_date = f.snapshot_date "
    "WHERE "
    + " AND ".join(
        f'f."{c}" IS NOT NULL'
        for c in [*o.TRAIN_FEATURES, "balance", "dpd", "installments_missed"]
        if c != "Customer_ID"
    )
    + " AND f.payment_ratio IS NOT NULL AND f.overdue_ratio IS NOT NULL",
)
def training_join_dropna(spark, sf_dir):
    joined = splitting.training_set(gold.gold_labels(loans(spark, sf_dir)), _store(spark, sf_dir))
    return shown(
        joined.select(
            "loan_id",
            "Customer_ID",
            "snapshot_date",
            "label",
            "balance",
            "Age",
            "Num_of_Loan",
            "fe_1",
            "fe_20",
        )
    )


@query(
    "hot_key_left_join",
    "SELECT c_custkey AS k, c_mktsegment, o_orderkey, o_orderpriority FROM customer "
    "LEFT JOIN orders ON c_custkey = o_custkey",
)
def hot_key_left_join(spark, sf_dir):
    left = s.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    right = s.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), "o_orderkey", "o_orderpriority"
    )
    return joins.spread_left_join(left, right, ["k"], rows=8)


# --- labels, splits, scaling -----------------------------------------------


@query(
    "training_left_join",
    o.with_(*o.STORE, o.LABELS)
    + "SELECT l.loan_id, l.Customer_ID, CAST(l.snapshot_date AS VARCHAR) AS snapshot_date, "
    "l.label, f.balance, f.Age, f.Num_of_Loan, f.fe_1 FROM labels_at AS l "
    "LEFT JOIN store AS f ON l.Customer_ID = f.Customer_ID AND l.snapshot_date = f.snapshot_date",
)
def training_left_join(spark, sf_dir):
    """Every label, with its features where there are any."""
    joined = splitting.training_set(gold.gold_labels(loans(spark, sf_dir)), _store(spark, sf_dir), complete_only=False)
    return shown(joined.select("loan_id", "Customer_ID", "snapshot_date", "label", "balance", "Age", "Num_of_Loan", "fe_1"))


def _labelled(spark, sf_dir):
    return s.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


_KEYED = (
    "keyed AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, "
    "md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, '{seed}')) AS k "
    "FROM lineitem), placed AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY k) AS r, "
    "count(*) OVER (PARTITION BY label) AS n FROM keyed)"
)
_SPLIT_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "stratified_split",
    f"WITH {_KEYED.format(seed=42)} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label, "
    "CASE WHEN r <= round(0.8 * n) THEN 'train' ELSE 'val' END AS split FROM placed",
)
def stratified_split(spark, sf_dir):
    return splitting.stratified_split(_labelled(spark, sf_dir), _SPLIT_KEYS)


@query(
    "stratified_folds",
    f"WITH {_KEYED.format(seed=43)} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label, "
    "CAST(CASE WHEN r <= round(n * (1 / 3.0::DOUBLE)) THEN 0 "
    "WHEN r <= round(n * (2 / 3.0::DOUBLE)) THEN 1 ELSE 2 END AS INTEGER) AS fold FROM placed",
)
def stratified_folds(spark, sf_dir):
    return splitting.stratified_folds(_labelled(spark, sf_dir), 3, _SPLIT_KEYS)


@query(
    "split_stats",
    f"WITH {_KEYED.format(seed=42)} SELECT CASE WHEN r <= round(0.8 * n) THEN 'train' "
    "ELSE 'val' END AS split, count(*) AS n, round(avg(label), 2) AS label_rate FROM placed "
    "GROUP BY 1",
)
def split_stats(spark, sf_dir):
    return metrics.split_stats(stratified_split(spark, sf_dir))


@query(
    "training_split",
    o.with_(
        *o.LOANS,
        o.LABELS,
        (
            "keyed",
            "SELECT *, snapshot_date >= DATE '1998-11-01' AS held, md5(concat_ws(':', loan_id, "
            "Customer_ID, CAST(snapshot_date AS VARCHAR), '42')) AS k FROM labels_at "
            "WHERE snapshot_date BETWEEN DATE '1997-11-01' AND DATE '1998-12-31'",
        ),
        (
            "placed",
            "SELECT *, rank() OVER (PARTITION BY held, label ORDER BY k) AS r, "
            "count(*) OVER (PARTITION BY held, label) AS n FROM keyed",
        ),
    )
    + f"SELECT loan_id, Customer_ID, {o.day()}, label, CASE WHEN held THEN 'oot' "
    "WHEN r <= round(0.8 * n) THEN 'train' ELSE 'val' END AS split FROM placed",
)
def training_split(spark, sf_dir):
    windows = splitting.training_windows(TRAIN_DATE, oot_months=2)
    labels = gold.gold_labels(loans(spark, sf_dir)).drop("label_def")
    return shown(splitting.split_training_set(labels, windows))


@query(
    "standard_scale",
    "WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
    "1 AS constant FROM lineitem), m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, "
    "avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM t) "
    "SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 4) + 0.0 AS l_quantity, "
    "round((l_extendedprice - mp) / sp, 4) + 0.0 AS l_extendedprice, 0.0::DOUBLE AS constant "
    "FROM t CROSS JOIN m",
)
def standard_scale(spark, sf_dir):
    rows = s.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.lit(1).alias("constant"),
    )
    names = ["l_quantity", "l_extendedprice", "constant"]
    scaled = scaling.apply_scaler(rows, scaling.fit_scaler(rows, names))
    return scaled.withColumns({c: F.round(c, 4) for c in names})


# --- performance -----------------------------------------------------------


def _scored(spark, sf_dir):
    return monitoring.predictions_with_labels(
        s.predictions(spark, sf_dir), gold.gold_labels(loans(spark, sf_dir))
    )


@query(
    "prediction_label_join",
    o.with_(*o.SCORED)
    + f"SELECT Customer_ID, {o.day()}, {o.r6('model_predictions')}, binary_prediction, label "
    "FROM scored",
)
def prediction_label_join(spark, sf_dir):
    return shown(_scored(spark, sf_dir))


@query(
    "f1_by_snapshot",
    o.with_(*o.SCORED, o.F1) + f"SELECT {o.day()}, {o.r6('f1')} FROM f1",
)
def f1_by_snapshot(spark, sf_dir):
    return shown(metrics.f1_by_group(_scored(spark, sf_dir)))


@query(
    "auc_by_snapshot",
    o.with_(*o.SCORED, *o.auc())
    + f"SELECT {o.day()}, positives, negatives, {o.r6('auc')}, "
    "round(2 * auc - 1, 3) + 0.0 AS gini FROM auc",
)
def auc_by_snapshot(spark, sf_dir):
    return shown(metrics.auc_by_group(_scored(spark, sf_dir)))


@query(
    "auc_of_document_quality",
    o.with_(o.DOCUMENTS, *o.auc())
    + f"SELECT {o.day()}, positives, negatives, {o.r6('auc')}, "
    "round(2 * auc - 1, 3) + 0.0 AS gini FROM auc",
)
def auc_of_document_quality(spark, sf_dir):
    return shown(metrics.auc_by_group(s.scored_documents(spark, sf_dir)))


_SEVERITY = (
    "CASE WHEN auc < 0.70 THEN 'critical' WHEN auc < 0.75 THEN 'warning' ELSE 'healthy' END "
    "AS severity"
)


@query(
    "auc_severity",
    o.with_(*o.SCORED, o.F1, *o.auc())
    + f"SELECT {o.day()}, {o.r6('f1')}, {o.r6('auc')}, {_SEVERITY} FROM auc "
    "JOIN f1 USING (snapshot_date)",
)
def auc_severity(spark, sf_dir):
    return shown(metrics.performance(_scored(spark, sf_dir)))


# --- drift -----------------------------------------------------------------


def _psi(spark, sf_dir):
    rows = loans(spark, sf_dir).select("snapshot_date", *o.DRIFT_FEATURES)
    bins = drift.fit_drift_bins(silver.at_snapshot(rows, BASELINE), o.DRIFT_FEATURES)
    return drift.psi_by_feature(rows.where(F.col("snapshot_date") > F.lit(BASELINE)), bins)


@query("psi_by_feature", o.with_(*o.DRIFT) + f"SELECT {o.day()}, feature, {o.r6('psi')} FROM psi")
def psi_by_feature(spark, sf_dir):
    return shown(_psi(spark, sf_dir))


@query(
    "drift_rollup",
    o.with_(*o.DRIFT, o.ROLLUP, o.ALERT)
    + f"SELECT {o.day()}, n_features, n_critical, n_warning, n_unknown, {o.r6('share_drifted')}, alert "
    "FROM alerts",
)
def drift_rollup(spark, sf_dir):
    return shown(drift.drift_rollup(_psi(spark, sf_dir)))


@query(
    "quantile_edges",
    "WITH long AS (SELECT 'l_extendedprice' AS feature, l_extendedprice AS x FROM lineitem "
    "UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem "
    "UNION ALL SELECT 'l_discount', l_discount FROM lineitem), "
    "q AS (SELECT feature, unnest(range(1, 10)) AS decile, "
    "unnest(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS value "
    "FROM long GROUP BY feature) "
    "SELECT feature, CAST(decile AS INTEGER) AS decile, round(value, 6) AS value FROM q",
)
def quantile_edges(spark, sf_dir):
    names = ["l_extendedprice", "l_quantity", "l_discount"]
    found = quantiles.exact_quantiles(
        s.table(spark, sf_dir, "lineitem"), names, [i / 10 for i in range(1, 10)]
    )
    rows = [(c, i + 1, v) for c in names for i, v in enumerate(found[c])]
    return shown(spark.createDataFrame(rows, "feature string, decile int, value double"))


def _flags(spark, sf_dir):
    perf = monitoring.performance_flags(metrics.performance(_scored(spark, sf_dir)))
    feat = monitoring.feature_flags(drift.drift_rollup(_psi(spark, sf_dir)))
    return perf.unionByName(feat).withColumn("model_name", F.lit("credit_model"))


#: Months that are monitored: a plain one, one without a feature, one with one class of labels, one without rows.
WATCHED = [dt.date(1997, 7, 1), dt.date(1997, 9, 1), dt.date(1997, 10, 1), dt.date(2031, 1, 1)]
_LOST, _ONE_CLASS = "1997-09-01", "1997-10-01"
_IN_WATCHED = "snapshot_date IN (" + ", ".join(f"DATE '{d}'" for d in WATCHED) + ")"
_WATCHED_SCORES = (
    *o.SCORED[:-1],
    (
        "scored",
        "SELECT Customer_ID, snapshot_date, model_predictions, "
        f"CASE WHEN snapshot_date = DATE '{_ONE_CLASS}' THEN 0 ELSE label END AS label "
        f"FROM preds JOIN labels_at USING (Customer_ID, snapshot_date) WHERE {_IN_WATCHED}",
    ),
)


def _monitored(spark, sf_dir):
    """A mart of written labels, scores and features, monitored month by month."""
    mart = Mart(working_folder(spark, "monitored"))
    rows = loans(spark, sf_dir)
    day = F.col("snapshot_date")
    kept = day.isin([*WATCHED, BASELINE])
    labels = gold.gold_labels(rows).withColumn("label", F.when(day == F.lit(_ONE_CLASS).cast("date"), 0).otherwise(F.col("label")))
    overwrite_snapshots(labels.where(kept), mart.label_store)
    scores = s.predictions(spark, sf_dir).where(kept).withColumn("model_name", F.lit("credit_model"))
    overwrite_snapshots(scores, mart.predictions, ["model_name", "snapshot_date"])
    features = rows.where(kept).select("Customer_ID", "snapshot_date", *o.DRIFT_FEATURES)
    lost = day == F.lit(_LOST).cast("date")
    overwrite_snapshots(features.where(~lost), mart.feature_store)
    overwrite_snapshots(features.where(lost).drop("balance"), mart.feature_store)
    for month in WATCHED:
        monitoring.monitor(spark, mart, "credit_model", month, BASELINE)
    return mart


@query(
    "performance_written",
    o.with_(*_WATCHED_SCORES, o.F1, *o.auc())
    + f"SELECT 'credit_model' AS model_name, {o.day()}, {o.r6('f1')}, {o.r6('auc')}, {_SEVERITY} FROM auc "
    "JOIN f1 USING (snapshot_date)",
)
def performance_written(spark, sf_dir):
    """The metrics table after four monitored months; one class or no rows leave no metrics."""
    return shown(read_table(spark, _monitored(spark, sf_dir).performance))


@query(
    "drift_flags_written",
    o.with_(*o.DRIFT)
    + f", seen AS (SELECT * FROM psi WHERE {_IN_WATCHED} AND NOT (snapshot_date = DATE '{_LOST}' AND feature = 'balance')), "
    f"rolled AS ({o.ROLLUP[1].replace('FROM psi', 'FROM seen')}), "
    f"warned AS ({o.ALERT[1].replace('FROM rollup_', 'FROM rolled')}), "
    + ", ".join(f"{name} AS ({sql})" for name, sql in (*_WATCHED_SCORES[len(o.LOANS) :], o.F1, *o.auc()))
    + ", months AS (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in WATCHED) + "]) AS snapshot_date), "
    f"known AS (SELECT snapshot_date, 'performance' AS kind, {_SEVERITY}, "
    "format('area under the curve: {:.3f}', auc) AS detail FROM auc UNION ALL "
    "SELECT snapshot_date, 'feature', CASE WHEN n_unknown = n_features THEN 'unknown' WHEN alert THEN 'critical' "
    "WHEN n_critical + n_warning > 0 THEN 'warning' ELSE 'healthy' END, "
    "format('of {} features {} strongly and {} slightly shifted, {} not comparable', n_features, n_critical, n_warning, n_unknown) "
    "FROM warned) "
    f"SELECT {o.day()}, kind, 'credit_model' AS model_name, coalesce(severity, 'unknown') AS severity, detail "
    "FROM (SELECT snapshot_date, unnest(['performance', 'feature']) AS kind FROM months) AS asked "
    "LEFT JOIN known USING (snapshot_date, kind)",
)
def drift_flags_written(spark, sf_dir):
    """The flags table after four monitored months; what cannot be computed is unknown."""
    flags = read_table(spark, _monitored(spark, sf_dir).drift_flags)
    return shown(flags.select("snapshot_date", "kind", "model_name", "severity", "detail"))


@query(
    "retrain_decision",
    o.with_(*o.DRIFT, o.ROLLUP, o.ALERT, *o.SCORED[len(o.LOANS) :], *o.auc())
    + f"SELECT {o.day()}, 'credit_model' AS model_name, bool_or(bad) AS retrain FROM ("
    "SELECT snapshot_date, alert AS bad FROM alerts UNION ALL "
    "SELECT snapshot_date, auc < 0.70 FROM auc) AS flagged GROUP BY snapshot_date",
)
def retrain_decision(spark, sf_dir):
    return shown(monitoring.retrain_decisions(_flags(spark, sf_dir)))


# --- tables, jobs, streams -------------------------------------------------


@query(
    "upsert_log",
    o.with_(*o.LOANS)
    + f"SELECT {o.day()}, CASE WHEN snapshot_date >= DATE '1998-01-01' THEN 2 ELSE 1 END AS run, "
    "count(*) AS n FROM loans GROUP BY snapshot_date",
)
def upsert_log(spark, sf_dir):
    path = working_folder(spark, "upsert") + "/log"
    counted = loans(spark, sf_dir).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"))
    monitoring.upsert_snapshots(counted.withColumn("run", F.lit(1)), path)
    later = counted.where(F.col("snapshot_date") >= F.lit(dt.date(1998, 1, 1)))
    monitoring.upsert_snapshots(later.withColumn("run", F.lit(2)), path)
    return shown(read_table(spark, path).select("snapshot_date", "run", "n"))


@query(
    "merged_schema_read",
    "SELECT CASE WHEN l_linenumber <= 3 THEN 'a' ELSE 'b' END AS part, l_orderkey, l_linenumber, "
    "l_quantity, CASE WHEN l_linenumber > 3 THEN l_discount END AS l_discount FROM lineitem",
)
def merged_schema_read(spark, sf_dir):
    path = working_folder(spark, "merged") + "/table"
    lines = s.table(spark, sf_dir, "lineitem")
    early = F.col("l_linenumber") <= 3
    narrow = lines.where(early).select("l_orderkey", "l_linenumber", "l_quantity")
    wide = lines.where(~early).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    overwrite_snapshots(narrow.withColumn("part", F.lit("a")), path, ["part"], compact=False)
    overwrite_snapshots(wide.withColumn("part", F.lit("b")), path, ["part"], compact=False)
    return read_merged(spark, path).select(
        "part", "l_orderkey", "l_linenumber", "l_quantity", "l_discount"
    )


@query(
    "profile",
    o.with_(*o.LOANS)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS data_type, count(*) AS n_rows, "
        f"count(*) - count({c}) AS n_null FROM loans"
        for c, t in [
            *LOAN_TYPES.items(),
            ("mob", "int"),
            ("installments_missed", "int"),
            ("first_missed_date", "date"),
            ("dpd", "int"),
        ]
    ),
)
def profile(spark, sf_dir):
    return profiling.profile(loans(spark, sf_dir))


@query(
    "preview",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem "
    "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20",
)
def preview(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return profiling.preview(s.table(spark, sf_dir, "lineitem").select(*keys), keys)


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(spark, sf_dir):
    return gold.duplicate_keys(s.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _write_raw(spark, sf_dir, root):
    """The raw sources as CSV files, all columns as text, and the first and last snapshot of loans and clicks."""
    tune(spark)
    raw = {
        "lms_loan_daily": s.loans_raw(spark, sf_dir),
        "feature_clickstream": s.clicks_raw(spark, sf_dir),
        "features_financials": s.customer_finances_raw(spark, sf_dir),
        "features_attributes": s.attributes_raw(spark, sf_dir),
    }
    paths, ends = {}, []
    for name, df in raw.items():
        paths[name] = f"{root}/raw/{name}"
        rows = df.select(*mart_jobs.SOURCES[name].schema.names)
        if mart_jobs.SOURCES[name].split:
            # Seen by the job that writes the rows: they are not derived once more for it.
            seen = Observation(f"months of {name}")
            rows = rows.observe(seen, F.min("snapshot_date").alias("first"), F.max("snapshot_date").alias("last"))
            ends.append(seen)
        rows.write.option("header", True).csv(paths[name])
    return paths, min(e.get["first"] for e in ends), max(e.get["last"] for e in ends)


def _months(*raw: DataFrame) -> tuple[dt.date, dt.date]:
    """First and last snapshot of some raw sources."""
    ends = [df.agg(F.min("snapshot_date"), F.max("snapshot_date")).first() for df in raw]
    return min(e[0] for e in ends), max(e[1] for e in ends)


def _backfilled(spark, sf_dir):
    mart = Mart(working_folder(spark, "mart"))
    paths, first, last = _write_raw(spark, sf_dir, mart.root)
    mart_jobs.backfill(spark, mart, paths, first, last)
    return mart


@query(
    "backfill_changed_month",
    o.with_(*o.LOANS)
    + f"SELECT {o.day()}, count(*) * CASE WHEN snapshot_date = DATE '1995-06-01' THEN 2 ELSE 1 END AS loans, "
    "snapshot_date = DATE '1995-06-01' AS built_again FROM loans GROUP BY snapshot_date",
)
def backfill_changed_month(spark, sf_dir):
    """All months are built, then a file with one month's loans arrives once more and only its month is built."""
    mart = Mart(working_folder(spark, "mart"))
    paths, first, last = _write_raw(spark, sf_dir, mart.root)
    changes.backfill_changed(spark, mart, paths, first, last)
    name = "lms_loan_daily"
    again = s.loans_raw(spark, sf_dir).where("snapshot_date = DATE '1995-06-01'").select(*mart_jobs.SOURCES[name].schema.names)
    again.write.mode("append").option("header", True).csv(paths[name])
    built = changes.backfill_changed(spark, mart, paths, first, last)
    silver_loans = read_table(spark, mart.silver(name))
    months = silver_loans.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("loans"))
    return shown(months.withColumn("built_again", F.col("snapshot_date").isin(*built)))


@query("backfill_feature_store", o.with_(*o.STORE_FROM_FILES) + f"SELECT {o.STORE_OUT} FROM store")
def backfill_feature_store(spark, sf_dir):
    mart = _backfilled(spark, sf_dir)
    return shown(read_table(spark, mart.feature_store))


@query("stream_ingest", o.with_(*o.LOANS) + f"SELECT {o.LOAN_OUT} FROM loans")
def stream_ingest(spark, sf_dir):
    tune(spark)
    root = working_folder(spark, "stream")
    raw = s.loans_raw(spark, sf_dir)
    early = F.col("installment_num") <= 3
    for rows in (raw.where(early), raw.where(~early)):
        rows.write.mode("append").option("header", True).option("compression", "gzip").csv(f"{root}/raw")
        ingest.ingest_available(
            spark, f"{root}/raw", f"{root}/bronze", f"{root}/silver", f"{root}/checkpoint"
        )
    names = [*LOAN_TYPES, "mob", "installments_missed", "first_missed_date", "dpd"]
    return shown_loans(read_table(spark, f"{root}/silver").select(*names))


@query(
    "stream_ingest_clicks",
    o.with_(*o.CLICKS) + f"SELECT Customer_ID, {o.day()}, {', '.join(CLICK_FEATURES)} FROM clicks",
)
def stream_ingest_clicks(spark, sf_dir):
    """Click files that arrive in two batches, both with rows for the same months."""
    tune(spark)
    root = working_folder(spark, "stream")
    raw = s.clicks_raw(spark, sf_dir).select(*CLICKSTREAM_RAW_SCHEMA.names)
    early = F.crc32(F.col("Customer_ID").cast("binary")) % 2 == 0
    for rows in (raw.where(early), raw.where(~early)):
        rows.write.mode("append").option("header", True).option("compression", "gzip").csv(f"{root}/raw")
        ingest.ingest_available(
            spark,
            f"{root}/raw",
            f"{root}/bronze",
            f"{root}/silver",
            f"{root}/checkpoint",
            CLICKSTREAM_RAW_SCHEMA,
            silver.silver_clickstream,
        )
    got = read_table(spark, f"{root}/silver")
    return shown(got.select("Customer_ID", "snapshot_date", *CLICK_FEATURES))


#: Days after a month's first source within which the others are expected.
SOURCE_DAYS = 14
_NAMES = ", ".join(f"'{n}'" for n in readiness.SOURCES)


@query(
    "sources_ready",
    f"WITH arrivals AS ({s.ARRIVALS_SQL}), timed AS (SELECT snapshot_date, k, first_day + CAST(delay AS INTEGER) AS day FROM arrivals), "
    "months AS (SELECT snapshot_date, min(day) AS first, max(day) AS last, count(*) AS n FROM timed GROUP BY 1), "
    f"ends AS (SELECT *, first + {SOURCE_DAYS} AS limit_day FROM months), "
    "short AS (SELECT e.snapshot_date, limit_day, count(t.k) AS arrived, list(t.k) AS ks FROM ends e JOIN timed t "
    "ON e.snapshot_date = t.snapshot_date AND t.day <= limit_day WHERE n < 4 OR last > limit_day GROUP BY ALL) "
    "SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, CASE WHEN last > limit_day THEN 'late' ELSE 'ready' END AS status, "
    "4 AS arrived, '' AS missing, CAST(last AS VARCHAR) AS day FROM ends WHERE n = 4 UNION ALL "
    "SELECT CAST(snapshot_date AS VARCHAR), 'incomplete', CAST(arrived AS INTEGER), "
    f"array_to_string(list_filter([{_NAMES}], lambda x, i: NOT list_contains(ks, i - 1)), ','), CAST(limit_day AS VARCHAR) FROM short",
)
def sources_ready(spark, sf_dir):
    """Months whose four sources arrive in a stream, file by file: complete, incomplete at the limit, or late."""
    readiness.use_state_store(spark)
    root = working_folder(spark, "arrivals")
    overwrite_table(s.source_arrivals(spark, sf_dir, list(readiness.SOURCES)), f"{root}/all")
    held = read_table(spark, f"{root}/all")
    half = F.lit(held.agg(F.percentile_approx("arrived_at", 0.5)).first()[0])
    # The stream's clock runs past the last limit once two later arrivals were seen.
    after = [spark.createDataFrame([("none", dt.date(2100, i, 1), dt.datetime(2100, i, 1))], held.schema) for i in (1, 2)]
    for part in [held.where(F.col("arrived_at") <= half), held.where(F.col("arrived_at") > half), *after]:
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    reader = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1)
    months = readiness.months_ready(reader.parquet(f"{root}/in"), SOURCE_DAYS)
    months.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    told = spark.read.schema(readiness.READY_SCHEMA).parquet(f"{root}/out")
    return told.select(
        F.col("snapshot_date").cast("string").alias("snapshot_date"), "status", "arrived", "missing", F.to_date("at").cast("string").alias("day")
    )


def _written_loans(spark, sf_dir):
    """Silver loans as a table of snapshots."""
    path = working_folder(spark, "loans")
    overwrite_snapshots(loans(spark, sf_dir), path)
    return path


@query(
    "snapshot_read",
    o.with_(*o.LOANS)
    + f"SELECT {o.LOAN_OUT} FROM loans WHERE snapshot_date BETWEEN DATE '1997-03-01' AND DATE '1997-04-01'",
)
def snapshot_read(spark, sf_dir):
    """Two snapshots opened by their folders."""
    names = [*LOAN_TYPES, "mob", "installments_missed", "first_missed_date", "dpd"]
    got = read_range(spark, _written_loans(spark, sf_dir), dt.date(1997, 3, 1), dt.date(1997, 4, 1))
    return shown_loans(got.select(*names))


@query(
    "rerun_emptied_month",
    o.with_(*o.LOANS)
    + f"SELECT {o.day()}, count(*) AS n FROM loans WHERE snapshot_date <> DATE '1997-06-01' GROUP BY snapshot_date",
)
def rerun_emptied_month(spark, sf_dir):
    """A run over a year again, in which June has no rows any more: no row of June is left."""
    path = _written_loans(spark, sf_dir)
    year = (dt.date(1997, 1, 1), dt.date(1997, 12, 1))
    again = loans(spark, sf_dir).where(
        F.col("snapshot_date").between(*[F.lit(d) for d in year])
        & (F.col("snapshot_date") != F.lit(dt.date(1997, 6, 1)))
    )
    overwrite_snapshots(again, path, replaced={"snapshot_date": year})
    got = read_table(spark, path).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"))
    return shown(got)


@query(
    "relabel_other_mob",
    o.with_(*o.LOANS)
    + f"SELECT {o.day()}, '30dpd_3mob' AS label_def, count(*) AS n FROM loans WHERE mob = 3 GROUP BY snapshot_date",
)
def relabel_other_mob(spark, sf_dir):
    """Labels at month three after labels at month six: nothing of the old definition stays."""
    mart = Mart(working_folder(spark, "labels"))
    overwrite_snapshots(loans(spark, sf_dir), mart.silver("lms_loan_daily"))
    first, last = _months(s.loans_raw(spark, sf_dir))
    for mob in (6, 3):
        mart_jobs.build_labels(spark, mart, first, last, mob=mob)
    got = read_table(spark, mart.label_store).groupBy("snapshot_date", "label_def")
    return shown(got.agg(F.count(F.lit(1)).alias("n")))


def _gold_tables(spark, sf_dir, root):
    """Label store and feature store as written tables; every source is read and cleaned once."""
    tune(spark)

    def written(df, name):
        overwrite_table(df, f"{root}/{name}")
        return read_table(spark, f"{root}/{name}")

    # All loan rows that labels and loan features are made of.
    at_month = written(loans(spark, sf_dir).where(F.col("mob") == gold.MOB), "silver_loans")
    # A file of one piece is read, and so cleaned, by one task: the customers are dealt out first.
    written(s.table(spark, sf_dir, "customer").repartition("c_custkey"), "given/customer.parquet")
    finances = written(_finances(spark, f"{root}/given"), "silver_finances")
    attributes = written(_attributes(spark, f"{root}/given"), "silver_attributes")
    store = gold.feature_store(
        gold.gold_loan_features(at_month),
        gold.gold_financials(finances, encoding.fit_vocabulary(finances, FINANCIAL_CATEGORIES)),
        gold.gold_attributes(attributes, encoding.fit_vocabulary(attributes, ATTRIBUTE_CATEGORIES)),
        gold.gold_clickstream(silver.silver_clickstream(s.clicks_raw(spark, sf_dir))),
    )
    return written(gold.gold_labels(at_month), "labels"), written(store, "features")


@query(
    "train_score_gbt",
    o.with_(*o.STORE)
    + f"SELECT {o.day()}, count(*) AS n, TRUE AS same_when_reloaded, TRUE AS probabilities "
    "FROM store GROUP BY snapshot_date",
)
def train_score_gbt(spark, sf_dir):
    """Search on scaled click features of twelve months; every month scored, and again after a reload."""
    root = working_folder(spark, "model")
    labels, features = _gold_tables(spark, sf_dir, root)
    trained = training.train_model(
        spark,
        labels,
        features,
        TRAIN_DATE,
        f"{root}/bank",
        oot_months=2,
        grid=CHECK_GRID,
        draws=CHECK_DRAWS,
        feature_columns=CLICK_FEATURES,
        scale=True,
        keep_missing=True,
    )
    again = training.load_model(spark, f"{root}/bank", trained.version)
    for name, model in (("fresh", trained), ("reloaded", again)):
        overwrite_table(scoring.score(features, model), f"{root}/{name}")
    sums = [
        read_table(spark, f"{root}/{name}")
        .groupBy("snapshot_date")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("model_predictions").alias(name),
            F.bool_and(F.col("model_predictions").between(0, 1)).alias("probabilities"),
        )
        for name in ("fresh", "reloaded")
    ]
    both = sums[0].join(sums[1].select("snapshot_date", "reloaded"), "snapshot_date")
    same = F.abs(F.col("fresh") - F.col("reloaded")) < 1e-6
    return shown(both.select("snapshot_date", "n", same.alias("same_when_reloaded"), "probabilities"))


@query("model_bank_entry", "SELECT TRUE AS auc_is_that_of_the_scores, TRUE AS best_point_chosen, 3 AS points, TRUE AS no_leakage")
def model_bank_entry(spark, sf_dir):
    """A model on all features: its stored figures recomputed, its choice, and what it looked at."""
    root = working_folder(spark, "model")
    labels, features = _gold_tables(spark, sf_dir, root)
    trained = training.train_model(
        spark,
        labels,
        features,
        TRAIN_DATE,
        f"{root}/bank",
        oot_months=2,
        grid=CHECK_GRID,
        draws=CHECK_DRAWS,
        keep_missing=True,
    )
    windows = splitting.training_windows(TRAIN_DATE, 2)
    late = F.col("snapshot_date").between(F.lit(windows.oot_start), F.lit(windows.oot_end))
    rows = splitting.training_set(labels.where(late), features.where(late), False)
    scored = training.model_inputs(rows, trained.features, trained.scaler, True)
    scored = trained.model.transform(scored).select("label", training.positive_probability().alias("model_predictions"))
    auc = metrics.auc_by_group(scored, []).select(F.col("auc").alias("again"))
    stored = training.bank_entries(spark, f"{root}/bank").where("split = 'oot'").select(F.col("auc").alias("stored"))
    # One rung: all points at their full number of trees.
    searched = read_table(spark, f"{root}/bank/searches").agg(
        (F.max("mean_auc") == F.max(F.when(F.col("chosen"), F.col("mean_auc")))).alias("best_point_chosen"),
        F.count(F.lit(1)).cast("int").alias("points"),
    )
    leaking = set(trained.features) & {"dpd", "installments_missed", "overdue_ratio", "payment_ratio", "balance", "label"}
    one = F.lit(1).alias("one")
    joined = auc.select("again", one).join(stored.select("stored", one), "one").join(searched.select("*", one), "one")
    return joined.select(
        (F.abs(F.col("again") - F.col("stored")) < 1e-6).alias("auc_is_that_of_the_scores"),
        "best_point_chosen",
        "points",
        F.lit(not leaking).alias("no_leakage"),
    )


@query(
    "halving_search",
    o.with_(
        *o.STORE,
        o.LABELS,
        (
            "joined",
            "SELECT l.loan_id, l.Customer_ID, l.snapshot_date, l.label FROM labels_at AS l LEFT JOIN store AS f "
            "ON l.Customer_ID = f.Customer_ID AND l.snapshot_date = f.snapshot_date "
            "WHERE l.snapshot_date BETWEEN DATE '1997-11-01' AND DATE '1998-10-31'",
        ),
        (
            "placed",
            "SELECT rank() OVER (PARTITION BY label ORDER BY k) AS r, count(*) OVER (PARTITION BY label) AS n FROM "
            "(SELECT label, md5(concat_ws(':', loan_id, Customer_ID, CAST(snapshot_date AS VARCHAR), '42')) AS k FROM joined)",
        ),
        ("train", "SELECT count(*) AS n FROM placed WHERE r <= round(0.8 * n)"),
    )
    + "SELECT CAST(rung AS INTEGER) AS rung, CAST(most AS INTEGER) AS most_trees, CAST(points AS BIGINT) AS points, "
    "CAST(kept AS BIGINT) AS kept, CAST(points * n AS BIGINT) AS rows_scored, TRUE AS best_go_on, TRUE AS aucs "
    "FROM train, (VALUES (0, 2, 20, 7), (1, 6, 7, 3), (2, 8, 3, 1)) AS v(rung, most, points, kept)",
)
def halving_search(spark, sf_dir):
    """20 points on three folds by successive halving: every row is held out once per point, the best ones go on."""
    root = working_folder(spark, "model")
    labels, features = _gold_tables(spark, sf_dir, root)
    training.train_model(
        spark,
        labels,
        features,
        TRAIN_DATE,
        f"{root}/bank",
        oot_months=2,
        grid=HALVING_GRID,
        draws=HALVING_DRAWS,
        feature_columns=CLICK_FEATURES,
        scale=True,
        keep_missing=True,
        parallelism=8,
        rung_trees=2,
    )
    least_kept, most_left = (F.min(F.when(F.col("kept"), F.col("mean_auc"))), F.max(F.when(~F.col("kept"), F.col("mean_auc"))))
    return (
        read_table(spark, f"{root}/bank/searches")
        .groupBy("rung")
        .agg(
            F.max("budget").alias("most_trees"),
            F.count(F.lit(1)).alias("points"),
            F.count_if("kept").alias("kept"),
            F.sum("rows").alias("rows_scored"),
            (least_kept >= F.coalesce(most_left, F.lit(0.0))).alias("best_go_on"),
            F.bool_and(F.col("mean_auc").between(0, 1)).alias("aucs"),
        )
    )
