"""Column contracts of the raw, silver and gold tables.

Fixed values: the column names and types below are the data contract of the mart.
"""

from __future__ import annotations

from pyspark.sql import types as T

SNAPSHOT = "snapshot_date"
CUSTOMER = "Customer_ID"
LOAN = "loan_id"
LABEL = "label"

CLICK_FEATURES = [f"fe_{i}" for i in range(1, 21)]

LOAN_TYPES = {
    "loan_id": "string",
    "Customer_ID": "string",
    "loan_start_date": "date",
    "tenure": "int",
    "installment_num": "int",
    "loan_amt": "float",
    "due_amt": "float",
    "paid_amt": "float",
    "overdue_amt": "float",
    "balance": "float",
    "snapshot_date": "date",
}

CLICKSTREAM_TYPES = {
    **{name: "int" for name in CLICK_FEATURES},
    "Customer_ID": "string",
    "snapshot_date": "date",
}

FINANCIALS_RAW = [
    "Customer_ID",
    "Annual_Income",
    "Monthly_Inhand_Salary",
    "Num_Bank_Accounts",
    "Num_Credit_Card",
    "Interest_Rate",
    "Num_of_Loan",
    "Type_of_Loan",
    "Delay_from_due_date",
    "Num_of_Delayed_Payment",
    "Changed_Credit_Limit",
    "Num_Credit_Inquiries",
    "Credit_Mix",
    "Outstanding_Debt",
    "Credit_Utilization_Ratio",
    "Credit_History_Age",
    "Payment_of_Min_Amount",
    "Total_EMI_per_month",
    "Amount_invested_monthly",
    "Payment_Behaviour",
    "Monthly_Balance",
    "snapshot_date",
]

ATTRIBUTES_RAW = ["Customer_ID", "Name", "SSN", "Age", "Occupation", "snapshot_date"]

INVESTMENT_RATIO = "Investment Ratio"

LOAN_FEATURE_TYPES = {
    "loan_id": "string",
    "Customer_ID": "string",
    "payment_ratio": "float",
    "overdue_ratio": "float",
    "balance": "int",
    "snapshot_date": "date",
    "installments_missed": "int",
    "dpd": "int",
}

FINANCIAL_FEATURE_TYPES = {
    "Customer_ID": "string",
    "Annual_Income": "float",
    "Monthly_Inhand_Salary": "float",
    "Num_Bank_Accounts": "int",
    "Num_Credit_Card": "int",
    "Interest_Rate": "int",
    "Num_of_Loan": "int",
    "Delay_from_due_date": "int",
    "Num_of_Delayed_Payment": "int",
    "Changed_Credit_Limit": "float",
    "Num_Credit_Inquiries": "int",
    "Outstanding_Debt": "float",
    "Credit_Utilization_Ratio": "double",
    "Total_EMI_per_month": "double",
    "Amount_invested_monthly": "double",
    "Monthly_Balance": "double",
    "Credit_History_Age_In_Months": "int",
    "Investment Ratio": "double",
}

FINANCIAL_CATEGORIES = ["Credit_Mix", "Payment_of_Min_Amount", "Payment_Behaviour"]
ATTRIBUTE_CATEGORIES = ["Occupation"]

# Columns that carry the outcome itself and must never reach a model.
LEAKAGE = ["payment_ratio", "overdue_ratio", "balance", "installments_missed", "dpd"]
# Keys and label columns that are no model inputs either.
NOT_FEATURES = ["Customer_ID", "snapshot_date", "loan_id", "label", "label_def", *LEAKAGE]


def all_text(columns) -> T.StructType:
    """Raw files are read as text; typing happens in silver."""
    return T.StructType([T.StructField(name, T.StringType(), True) for name in columns])


LOAN_RAW_SCHEMA = all_text(LOAN_TYPES)
CLICKSTREAM_RAW_SCHEMA = all_text(CLICKSTREAM_TYPES)
FINANCIALS_RAW_SCHEMA = all_text(FINANCIALS_RAW)
ATTRIBUTES_RAW_SCHEMA = all_text(ATTRIBUTES_RAW)
