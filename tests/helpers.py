"""Small row builders for the unit tests."""

from __future__ import annotations

from riskmart.sources import schemas


def text_rows(spark, schema, rows, **defaults):
    """Rows of text columns; unnamed columns take the default or NULL."""
    filled = [
        tuple({**defaults, **row}.get(name) for name in schema.names) for row in rows
    ]
    return spark.createDataFrame(filled, schema)


def loan_rows(spark, rows):
    return text_rows(
        spark,
        schemas.LOAN_RAW_SCHEMA,
        rows,
        loan_id="L1",
        Customer_ID="C1",
        loan_start_date="1/1/2023",
        tenure="10",
        installment_num="6",
        loan_amt="1000",
        due_amt="100",
        paid_amt="0",
        overdue_amt="0",
        balance="400",
        snapshot_date="1/7/2023",
    )


GOOD_FINANCES = dict(
    Customer_ID="C1",
    Annual_Income="50000.5",
    Monthly_Inhand_Salary="4000",
    Num_Bank_Accounts="3",
    Num_Credit_Card="4",
    Interest_Rate="12",
    Num_of_Loan="2",
    Type_of_Loan="Auto Loan",
    Delay_from_due_date="5",
    Num_of_Delayed_Payment="7",
    Changed_Credit_Limit="11.27",
    Num_Credit_Inquiries="4",
    Credit_Mix="Good",
    Outstanding_Debt="809.98",
    Credit_Utilization_Ratio="26.8",
    Credit_History_Age="22 Years and 1 Months",
    Payment_of_Min_Amount="No",
    Total_EMI_per_month="49.5",
    Amount_invested_monthly="80",
    Payment_Behaviour="High_spent_Small_value_payments",
    Monthly_Balance="312.4",
    snapshot_date="1/7/2023",
)


def finance_rows(spark, rows):
    return text_rows(spark, schemas.FINANCIALS_RAW_SCHEMA, rows, **GOOD_FINANCES)


def values(df, *columns):
    return [tuple(row) for row in df.select(*columns).collect()]


def as_set(df):
    return sorted((tuple(sorted(r.asDict().items(), key=str)) for r in df.collect()), key=str)


__all__ = ["as_set", "finance_rows", "loan_rows", "text_rows", "values"]
