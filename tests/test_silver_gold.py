import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from riskmart.operators import casting, encoding, gold, joins, profiling, silver
from riskmart.plans import mart as mart_jobs
from riskmart.sources import schemas
from tests.helpers import as_set, finance_rows, loan_rows, text_rows, values


def test_loan_past_due(spark):
    df = silver.silver_loan(
        loan_rows(
            spark,
            [
                dict(loan_id="a", overdue_amt="250"),
                dict(loan_id="b", overdue_amt="0"),
                dict(loan_id="c", overdue_amt="250", due_amt="0"),
                dict(loan_id="d", overdue_amt=None),
                dict(loan_id="e", overdue_amt="bad", installment_num="x"),
            ],
        )
    )
    got = {r["loan_id"]: r for r in df.collect()}
    assert got["a"]["installments_missed"] == 3
    assert got["a"]["first_missed_date"] == dt.date(2023, 4, 1)
    assert got["a"]["dpd"] == 91
    assert (got["b"]["installments_missed"], got["b"]["dpd"]) == (0, 0)
    assert (got["c"]["installments_missed"], got["c"]["dpd"]) == (0, None)
    assert (got["d"]["installments_missed"], got["d"]["dpd"]) == (None, 0)
    assert (got["e"]["mob"], got["e"]["overdue_amt"]) == (None, None)
    assert dict(df.dtypes)["loan_amt"] == "float"


def test_loan_with_all_numeric_gaps_filled(spark):
    df = silver.silver_loan(loan_rows(spark, [dict(overdue_amt=None, balance="?")]), True)
    assert values(df, "overdue_amt", "balance", "installments_missed", "dpd") == [(0.0, 0.0, 0, 0)]


def test_label_counts_unknown_as_good(spark):
    loans = silver.silver_loan(
        loan_rows(
            spark,
            [
                dict(loan_id="bad", overdue_amt="50"),
                dict(loan_id="unknown", overdue_amt="50", due_amt="0"),
                dict(loan_id="early", installment_num="5", overdue_amt="50"),
            ],
        )
    )
    labels = gold.gold_labels(loans)
    assert sorted(values(labels, "loan_id", "label", "label_def")) == [
        ("bad", 1, "30dpd_6mob"),
        ("unknown", 0, "30dpd_6mob"),
    ]
    assert values(gold.gold_labels(loans, dpd=31), "label") == [(0,), (0,)]
    sweep = gold.label_sweep(loans, [(30, 6), (31, 6), (30, 5)])
    assert sorted(values(sweep, "label_def", "loans", "bads")) == [
        ("30dpd_5mob", 1, 1),
        ("30dpd_6mob", 2, 1),
        ("31dpd_6mob", 2, 0),
    ]


def test_clickstream_clips(spark):
    raw = text_rows(
        spark,
        schemas.CLICKSTREAM_RAW_SCHEMA,
        [dict(fe_1="-3", fe_2="0", fe_3="7", fe_4=None, fe_5="x", fe_6="2.9")],
        Customer_ID="C1",
        snapshot_date="2023-07-01",
    )
    row = silver.silver_clickstream(raw).first()
    assert [row[f"fe_{i}"] for i in range(1, 8)] == [0, 0, 7, 0, 0, 2, 0]


def test_attributes(spark):
    ages = ["20", "30_", "40", "50", "-500", "101", None]
    raw = text_rows(
        spark,
        schemas.ATTRIBUTES_RAW_SCHEMA,
        [dict(Customer_ID=str(i), Age=a) for i, a in enumerate(ages)]
        + [dict(Customer_ID="m", Age="60", Occupation="_______")],
        Name="N",
        SSN="1",
        snapshot_date="1/7/2023",
    )
    df = silver.silver_attributes(raw)
    assert df.columns == ["Customer_ID", "Age", "Occupation", "snapshot_date"]
    got = dict(values(df, "Customer_ID", "Age"))
    # 20 30 40 50 60: the lower median is 40.
    assert [got[str(i)] for i in range(7)] == [20, 30, 40, 50, 40, 40, 40]
    assert {r[0] for r in values(df, "Occupation")} == {"Unknown"}


def test_attributes_lower_median_of_even_count_and_of_nothing(spark):
    def ages(texts):
        raw = text_rows(
            spark, schemas.ATTRIBUTES_RAW_SCHEMA, [dict(Age=a) for a in texts], Occupation="x"
        )
        return sorted(values(silver.silver_attributes(raw), "Age"), key=str)

    assert ages(["10", "20", "30", "40", None]) == [(10,), (20,), (20,), (30,), (40,)]
    assert ages([None, "-1"]) == [(None,), (None,)]


@pytest.mark.parametrize(
    "column, text, expected",
    [
        ("Annual_Income", "NA", 0.0),
        ("Annual_Income", "", 0.0),
        ("Annual_Income", "nan", 0.0),
        ("Annual_Income", "52312.5_", 52312.5),
        ("Annual_Income", None, None),
        ("Num_Bank_Accounts", "-1", "drop"),
        ("Num_Bank_Accounts", "10", 10),
        ("Num_Bank_Accounts", "11", "drop"),
        ("Num_Bank_Accounts", None, "drop"),
        ("Num_Credit_Card", "20", 20),
        ("Num_Credit_Card", "21", "drop"),
        ("Num_Credit_Card", "abc", 0),
        ("Num_Credit_Card", None, 0),
        ("Interest_Rate", "5000", 5000.0),
        ("Num_of_Loan", "3_", 3),
        ("Num_of_Loan", "-100", "drop"),
        ("Num_of_Loan", "50", 50),
        ("Num_of_Loan", "51", "drop"),
        ("Num_of_Loan", None, "drop"),
        ("Type_of_Loan", None, "Unknown"),
        ("Type_of_Loan", "", "Unknown"),
        ("Delay_from_due_date", "-3", "drop"),
        ("Delay_from_due_date", "0", 0),
        ("Delay_from_due_date", None, "drop"),
        ("Num_of_Delayed_Payment", "8_", 8),
        ("Num_of_Delayed_Payment", "-1", "drop"),
        ("Num_of_Delayed_Payment", "100", 100),
        ("Num_of_Delayed_Payment", "101", "drop"),
        ("Changed_Credit_Limit", "_", "drop"),
        ("Changed_Credit_Limit", "-3.5", -3.5),
        ("Changed_Credit_Limit", None, "drop"),
        ("Num_Credit_Inquiries", "-2", 0),
        ("Num_Credit_Inquiries", None, 0),
        ("Num_Credit_Inquiries", "50", 50),
        ("Num_Credit_Inquiries", "51", None),
        ("Credit_Mix", "_", "Unknown"),
        ("Credit_Mix", None, None),
        ("Outstanding_Debt", "809.5_", 809.5),
        ("Payment_of_Min_Amount", "NM", "Unknown"),
        ("Total_EMI_per_month", "-1", None),
        ("Total_EMI_per_month", "0", 0.0),
        ("Amount_invested_monthly", "__10000__", 0.0),
        ("Payment_Behaviour", "!@9#%8", "Unknown"),
        ("Monthly_Balance", "__-33__", 0.0),
        ("Monthly_Balance", "-5", 0.0),
        ("Monthly_Balance", None, 0.0),
        ("Monthly_Balance", "words", None),
        ("Monthly_Balance", "_7.25", 7.25),
    ],
)
def test_finance_rules(spark, column, text, expected):
    got = values(silver.silver_financials(finance_rows(spark, [{column: text}])), column)
    assert got == ([] if expected == "drop" else [(expected,)])


@pytest.mark.parametrize(
    "changes, expected",
    [
        ({"Monthly_Inhand_Salary": None}, 0.0),
        ({"Monthly_Inhand_Salary": "0"}, 0.0),
        ({"Monthly_Inhand_Salary": "4000", "Amount_invested_monthly": "80"}, 0.02),
        ({"Amount_invested_monthly": None}, None),
    ],
)
def test_investment_ratio(spark, changes, expected):
    df = silver.silver_financials(finance_rows(spark, [changes]))
    got = values(df, "`Investment Ratio`")[0][0]
    assert got == (None if expected is None else pytest.approx(expected, rel=1e-6))
    assert dict(df.dtypes)["Investment Ratio"] == "double"


def test_finance_rate_cap(spark):
    rows = finance_rows(spark, [{"Interest_Rate": r} for r in ("12.9", "100", "101", None)])
    kept = silver.silver_financials(rows, max_interest_rate=100)
    assert sorted(values(kept, "Interest_Rate")) == [(12,), (100,)]
    assert silver.silver_financials(rows).count() == 4


def test_vocabulary_orders_by_count_then_name(spark):
    df = spark.createDataFrame(
        [("b",), ("b",), ("c",), ("a",), (None,)], "kind string"
    )
    vocabulary = encoding.fit_vocabulary(df, ["kind"])
    assert vocabulary == {"kind": ["b", "a", "c"]}
    stored = encoding.vocabulary_frame(spark, vocabulary)
    assert encoding.read_vocabulary(stored) == vocabulary
    more = spark.createDataFrame([("a",), ("new",), (None,)], "kind string")
    coded = encoding.one_hot(more, vocabulary)
    assert coded.columns == ["kind_ohe_0", "kind_ohe_1", "kind_ohe_2"]
    assert values(coded, *coded.columns) == [(0.0, 1.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    vector = encoding.expand_vector(
        encoding.one_hot_vector(more, "kind", vocabulary["kind"]), "kind_ohe", 3
    )
    assert values(vector, *coded.columns) == values(coded, *coded.columns)


def test_vocabulary_matches_the_ml_encoder(spark):
    from pyspark.ml.feature import StringIndexer

    df = spark.createDataFrame([(w,) for w in "q w e w q z q".split()], "kind string")
    fitted = StringIndexer(inputCol="kind", outputCol="i", handleInvalid="keep").fit(df)
    assert encoding.fit_vocabulary(df, ["kind"])["kind"] == list(fitted.labels)


def test_vocabulary_of_very_many_categories(spark):
    df = spark.range(30_000).selectExpr("cast(id % 20000 as string) as kind", "id")
    table = encoding.vocabulary_table(df, ["kind"])
    assert table.count() == 20_000
    found = encoding.fit_vocabulary(df, ["kind"])["kind"]
    assert len(found) == 20_000
    rows = spark.createDataFrame([(found[0],), (found[19_999],), ("new",), (None,)], "kind string")
    got = encoding.one_hot_sparse(rows, "kind", table).collect()
    by = {r["kind"]: r["kind_ohe"] for r in got}
    assert {len(v) for v in by.values()} == {20_000}
    assert [by[k].indices.tolist() for k in (found[0], found[19_999], "new", None)] == [[0], [19_999], [], []]


def test_bounds_hold_before_numbers_are_cut(spark):
    rows = [
        dict(Customer_ID="ok", Num_Bank_Accounts="9.5", Num_Credit_Inquiries="-0.5"),
        dict(Customer_ID="banks", Num_Bank_Accounts="10.5"),
        dict(Customer_ID="delay", Delay_from_due_date="-0.5"),
        dict(Customer_ID="asked", Num_Credit_Inquiries="50.5"),
    ]
    got = {r["Customer_ID"]: r for r in silver.silver_financials(finance_rows(spark, rows)).collect()}
    assert set(got) == {"ok", "asked"}
    assert got["ok"]["Num_Bank_Accounts"] == 9 and got["ok"]["Num_Credit_Inquiries"] == 0
    assert got["asked"]["Num_Credit_Inquiries"] is None


def test_feature_store_equals_chained_joins_with_repeated_customers(spark):
    day = dt.date(2023, 7, 1)
    loans = spark.createDataFrame(
        [("l1", "A", day), ("l2", "A", day), ("l3", "B", day), ("l4", "X", day), ("l5", None, day)],
        "loan_id string, Customer_ID string, snapshot_date date",
    )
    fin = spark.createDataFrame(
        [("A", 1), ("A", 2), ("C", 3), (None, 4)], "Customer_ID string, income int"
    )
    att = spark.createDataFrame([("A", 30), ("B", 40), ("B", 41)], "Customer_ID string, Age int")
    clicks = spark.createDataFrame(
        [("A", day, 5), ("B", dt.date(2023, 8, 1), 6)],
        "Customer_ID string, snapshot_date date, fe_1 int",
    )
    chained = (
        loans.join(fin, "Customer_ID", "left")
        .join(att, "Customer_ID", "left")
        .join(clicks, ["Customer_ID", "snapshot_date"], "left")
    )
    store = gold.feature_store(loans, fin, att, clicks)
    assert store.columns == chained.columns
    assert as_set(store) == as_set(chained)
    assert store.count() == 8

    spread = gold.feature_store(loans, fin, att, clicks, spread=True)
    assert sorted(spread.columns) == sorted(chained.columns)
    assert as_set(spread) == as_set(chained)


def test_loans_meet_their_clicks_before_they_are_widened(spark):
    """The join on customer and month shuffles the loans: before the wide sources are joined to them."""
    day = dt.date(2023, 7, 1)
    loans = spark.createDataFrame([("l1", "A", day)], "loan_id string, Customer_ID string, snapshot_date date")
    wide = spark.createDataFrame([("A", 1)], "Customer_ID string, income int")
    ages = spark.createDataFrame([("A", 30)], "Customer_ID string, Age int")
    clicks = spark.createDataFrame([("A", day, 5)], "Customer_ID string, snapshot_date date, fe_1 int")
    store = gold.feature_store(loans, wide, ages, clicks)
    plan = store._jdf.queryExecution().optimizedPlan().toString()
    joins_on = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(joins_on) == 3 and "snapshot_date" in joins_on[-1] and "snapshot_date" not in "".join(joins_on[:-1])
    assert store.columns == ["Customer_ID", "snapshot_date", "loan_id", "income", "Age", "fe_1"]


def test_customers_of_one_file_are_cleaned_by_many_tasks(spark, tmp_path):
    """Stores from a customer file of one piece: its rows are dealt out, all of them, before they are cleaned."""
    from riskmart.catalog import queries

    given = f"{tmp_path}/sf"
    customers = spark.range(120_000).selectExpr(
        "id as c_custkey", "'Customer#' || sha2(string(id), 256) as c_name", "cast(id % 25 as int) as c_nationkey",
        "cast(id % 9999 as double) as c_acctbal", "'BUILDING' as c_mktsegment",
    )
    customers.coalesce(1).write.parquet(f"{given}/customer.parquet")
    at = "timestamp'1998-03-01'"
    spark.range(10).selectExpr("id as o_orderkey", "id as o_custkey", "100.5 as o_totalprice", f"{at} as o_orderdate").write.parquet(f"{given}/orders.parquet")
    spark.range(10).selectExpr(
        "id as l_orderkey", "id as l_partkey", "6 as l_linenumber", "5.0 as l_quantity", "100.0 as l_extendedprice",
        "0.05 as l_discount", "0.01 as l_tax", f"{at} as l_shipdate",
    ).write.parquet(f"{given}/lineitem.parquet")
    spark.range(10).selectExpr("id as event_id", "id as user_id").write.parquet(f"{given}/events.parquet")
    one_piece = spark.read.parquet(f"{given}/customer.parquet").select(F.spark_partition_id()).distinct()
    assert one_piece.count() == 1
    labels, features = queries._gold_tables(spark, given, f"{tmp_path}/out")
    assert labels.count() == features.count() == 10
    dealt = spark.read.parquet(f"{tmp_path}/out/given/customer.parquet")
    assert dealt.exceptAll(customers).isEmpty() and dealt.count() == 120_000
    assert len(dealt.inputFiles()) > 1
    assert spark.read.parquet(f"{tmp_path}/out/silver_attributes").count() == 120_000


def test_dealt_keys_keep_every_row_and_copy(spark):
    left = spark.range(40).selectExpr("cast(id % 4 as string) as k", "id")
    left = left.union(spark.createDataFrame([(None, 99)], "k string, id bigint"))
    hot_rows = spark.range(900).selectExpr("'1' as k", "cast(7 as bigint) as v")
    right = hot_rows.union(spark.createDataFrame([("2", 5), (None, 6)], "k string, v bigint"))
    buckets = {r["k"]: r["__buckets"] for r in joins.hot_keys(right, ["k"], 60).collect()}
    assert buckets == {"1": 15}
    plain = left.join(right, "k", "left")
    for rows in (1, 60, 100_000):
        spread = joins.spread_left_join(left, right, ["k"], rows)
        assert spread.count() == plain.count() == 9000 + 31
        assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()


def test_dealing_survives_a_retry(spark):
    """A lost task may find its rows in another order: buckets follow from rows, not from places."""
    rows = spark.range(4000).selectExpr("cast(id % 3 as string) as k", "id % 700 as v", "cast(id % 7 as double) as w")
    one = rows.repartition(7, "v")
    other = rows.orderBy(F.col("v").desc()).repartition(3)
    hot = joins.hot_keys(one, ["k"], 100)
    assert hot.count() == 3
    first, second = (joins.dealt(r, hot, ["k"]) for r in (one, other))
    assert first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()
    assert first.drop("__bucket").exceptAll(rows).isEmpty() and first.count() == 4000
    sizes = [r["count"] for r in first.groupBy("k", "__bucket").count().collect()]
    assert len(sizes) == 3 * 14 and max(sizes) < 250


def test_equal_rows_are_dealt_evenly(spark):
    rows = spark.range(1000).selectExpr("'a' as k", "1 as v")
    hot = joins.hot_keys(rows, ["k"], 100)
    assert {r["count"] for r in joins.dealt(rows, hot, ["k"]).groupBy("__bucket").count().collect()} == {100}


def test_keys_beyond_the_hottest_join_all_the_same(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_KEYS", 2)
    left = spark.range(12).selectExpr("id % 6 as k", "id")
    right = spark.range(600).selectExpr("id % 5 as k", "id as v")
    assert joins.hot_keys(right, ["k"], 10).count() == 2
    spread, plain = joins.spread_left_join(left, right, ["k"], 10), left.join(right, "k", "left")
    assert spread.exceptAll(plain).isEmpty() and plain.exceptAll(spread).isEmpty()


def test_a_customer_without_a_loan_builds_no_pairs(spark):
    day = dt.date(2023, 7, 1)
    loans = spark.createDataFrame([("l1", "A", day)], "loan_id string, Customer_ID string, snapshot_date date")
    many = spark.range(100_000).selectExpr("'big' as Customer_ID", "id as income")
    others = many.selectExpr("Customer_ID", "income as age")
    clicks = spark.createDataFrame([("A", day, 1)], "Customer_ID string, snapshot_date date, fe_1 int")
    for spread in (False, True):
        assert gold.feature_store(loans, many, others, clicks, spread).count() == 1


def test_loan_features_truncate_balance(spark):
    loans = silver.silver_loan(
        loan_rows(spark, [dict(balance="400.9", paid_amt="50", overdue_amt="10", due_amt="0")])
    )
    row = gold.gold_loan_features(loans).first()
    assert (row["balance"], row["payment_ratio"]) == (400, 0.0)
    assert row["overdue_ratio"] == pytest.approx(0.01)


def test_gold_tables_have_the_contract_columns(spark):
    fin = silver.silver_financials(finance_rows(spark, [{}, {"Credit_Mix": "_"}]))
    coded = gold.gold_financials(fin, encoding.fit_vocabulary(fin, schemas.FINANCIAL_CATEGORIES))
    assert coded.columns[:18] == list(schemas.FINANCIAL_FEATURE_TYPES)
    assert "Type_of_Loan" not in coded.columns
    assert [c for c in coded.columns if c.startswith("Credit_Mix")] == [
        "Credit_Mix_ohe_0",
        "Credit_Mix_ohe_1",
    ]


def test_whole_frame_helpers(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "a"), (None, 2.0, "b"), (3, float("nan"), None)], "fe_1 int, x double, s string"
    )
    assert casting.prefixed_columns(df) == ["fe_1"]
    assert casting.numeric_columns(df, ["x"]) == ["fe_1"]
    assert casting.common_numeric_columns(df, df.drop("x"), []) == ["fe_1"]
    assert values(casting.drop_any_null(df), "fe_1") == [(1,)]
    assert [r[0] for r in df.select(casting.is_complete(df)).collect()] == [True, False, False]
    assert values(casting.fill_all_numeric(df), "fe_1", "x", "s")[2] == (3, 0.0, None)
    with pytest.raises(ValueError):
        casting.cast_columns(df, {"nope": "int"})
    stats = {r["column"]: (r["n_rows"], r["n_null"]) for r in profiling.profile(df).collect()}
    assert stats == {"fe_1": (3, 1), "x": (3, 0), "s": (3, 1)}
    assert values(profiling.preview(df, ["fe_1"], 1), "s") == [("b",)]
    doubled = df.union(df)
    assert gold.duplicate_keys(doubled.where(F.col("s").isNotNull()), ["s"]).count() == 2


def test_the_most_overdue_loans_are_bad(spark):
    rows = [dict(loan_id="tiny", due_amt="0.01", overdue_amt="2000"), dict(loan_id="tiniest", due_amt="0.0000001", overdue_amt="2000")]
    loans = silver.silver_loan(loan_rows(spark, rows))
    got = {r["loan_id"]: r["dpd"] for r in loans.select("loan_id", "dpd").collect()}
    assert got["tiny"] > 6_000_000 and got["tiniest"] > 2_000_000_000
    assert [r["label"] for r in gold.gold_labels(loans).collect()] == [1, 1]


@pytest.mark.parametrize("rate", [None, 30])
def test_losses_are_observed_by_the_job_that_writes(spark, tmp_path, rate):
    rows = [
        {},
        {"Num_Bank_Accounts": "11"},
        {"Num_Bank_Accounts": "x", "Num_of_Loan": "-1"},
        {"Num_of_Loan": "51", "Changed_Credit_Limit": "_"},
        {"Changed_Credit_Limit": None},
        {"Interest_Rate": "31"},
        {"Interest_Rate": None},
    ]
    mart_jobs.financials_job(finance_rows(spark, rows), f"{tmp_path}/silver", f"{tmp_path}/losses", rate)
    got = {r.rule: (r.failed, r.dropped, r.rows) for r in spark.read.parquet(f"{tmp_path}/losses").collect()}
    expected = {
        "Num_Bank_Accounts": (2, 2, 7),
        "Num_Credit_Card": (0, 0, 7),
        "Num_of_Loan": (2, 1, 7),
        "Delay_from_due_date": (0, 0, 7),
        "Num_of_Delayed_Payment": (0, 0, 7),
        "Changed_Credit_Limit": (2, 1, 7),
    }
    assert got == expected | ({"Interest_Rate": (2, 2, 7)} if rate else {})
    kept = spark.read.parquet(f"{tmp_path}/silver").count()
    assert kept == 7 - sum(dropped for _, dropped, _ in got.values())


def test_no_rows_lose_nothing(spark, tmp_path):
    none = finance_rows(spark, [{}]).where("Customer_ID is null")
    mart_jobs.financials_job(none, f"{tmp_path}/silver", f"{tmp_path}/losses")
    assert spark.read.parquet(f"{tmp_path}/silver").count() == spark.read.parquet(f"{tmp_path}/losses").count() == 0


def test_observing_losses_costs_no_scan(spark, tmp_path):
    path = f"{tmp_path}/raw"
    finance_rows(spark, [{}]).write.parquet(path)
    df = silver.silver_financials(spark.read.parquet(path), losses=Observation("plan"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan and "Exchange" not in plan
