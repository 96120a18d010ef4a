"""Raw (bronze) rows -> typed, cleaned silver rows. No I/O and no actions in here."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskmart.functions import (
    blank_to,
    clip_to_zero,
    digits_to_int,
    digits_to_int_or_zero,
    first_missed_date,
    history_months,
    instalments_missed,
    mask_to_null,
    null_outside,
    signed_decimal_to_float,
    strip_underscores,
    text_to_double,
    text_to_float,
    text_to_int,
    tokens_to,
)
from riskmart.operators.casting import cast_column, cast_columns, fill_all_numeric
from riskmart.sources.schemas import (
    CLICK_FEATURES,
    CLICKSTREAM_TYPES,
    INVESTMENT_RATIO,
    LOAN_TYPES,
    SNAPSHOT,
)

# Placeholders found in the raw files and what stands in for them.
UNKNOWN = "Unknown"
INCOME_BLANKS = ["NA", "nan", ""]
CREDIT_MIX_BLANK = "_"
MIN_AMOUNT_BLANK = "NM"
BEHAVIOUR_BLANK = "!@9#%8"
INVESTED_BLANK = "__10000__"
OCCUPATION_MASK = "_______"

# Plausible ranges.
AGE_RANGE = (0, 100)
MAX_BANK_ACCOUNTS = 10
MAX_CREDIT_CARDS = 20
LOANS_RANGE = (0, 50)
DELAYED_PAYMENTS_RANGE = (0, 100)
MAX_INQUIRIES = 50


def parse_snapshot(df: DataFrame) -> DataFrame:
    """Give the snapshot column a date type (text in either date form, or a date)."""
    return cast_columns(df, {SNAPSHOT: "date"})


def at_snapshot(df: DataFrame, day: dt.date) -> DataFrame:
    return df.where(F.col(SNAPSHOT) == F.lit(day))


def silver_loan(df: DataFrame, fill_numeric: bool = False) -> DataFrame:
    """Typed loan months with month on book, missed instalments and days past due.

    `fill_numeric` additionally zeroes every numeric NULL before the past-due
    columns are derived, as the simpler variants of the mart do.
    """
    typed = cast_columns(df.select(*LOAN_TYPES), LOAN_TYPES).withColumns(
        {
            "mob": F.col("installment_num"),
            "installments_missed": instalments_missed(F.col("overdue_amt"), F.col("due_amt")),
        }
    )
    if fill_numeric:
        typed = fill_all_numeric(typed)
    missed_on = first_missed_date(F.col(SNAPSHOT), F.col("installments_missed"))
    return typed.withColumn("first_missed_date", missed_on).withColumn(
        "dpd",
        F.when(
            F.col("overdue_amt") > 0, F.datediff(F.col(SNAPSHOT), F.col("first_missed_date"))
        ).otherwise(F.lit(0)),
    )


def silver_clickstream(df: DataFrame) -> DataFrame:
    """Typed click features; anything that is not a positive number counts as zero."""
    typed = cast_columns(df.select(*CLICKSTREAM_TYPES), CLICKSTREAM_TYPES)
    return typed.withColumns({name: clip_to_zero(F.col(name)) for name in CLICK_FEATURES})


def silver_attributes(df: DataFrame) -> DataFrame:
    """Customer attributes without personal data; implausible ages become the median age.

    The median is the exact lower one. Ages are whole numbers of a range of 101
    values, so the percentile buffer holds at most 101 entries whatever the row
    count, and the value reaches the rows as a scalar subquery inside the plan.
    """
    age = null_outside(text_to_int(strip_underscores(F.col("Age").cast("string"))), *AGE_RANGE)
    cleaned = parse_snapshot(df.drop("Name", "SSN")).withColumns(
        {
            "Customer_ID": F.col("Customer_ID").cast("string"),
            "Age": age,
            "Occupation": mask_to_null(F.col("Occupation").cast("string"), OCCUPATION_MASK),
        }
    )
    median_age = cleaned.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY Age)")).scalar()
    return cleaned.na.fill({"Occupation": UNKNOWN}).withColumn(
        "Age", F.coalesce(F.col("Age"), median_age).cast("int")
    )


def rule_counts(rules: Mapping[str, Column]) -> list[Column]:
    """Aggregates `failed_<i>` and `dropped_<i>` per rule: rows that break it, and rows that break it first.

    A rule that is NULL for a row is broken.
    """
    broken = [~F.coalesce(rule, F.lit(False)) for rule in rules.values()]
    first = reduce(lambda case, i: case.when(broken[i], F.lit(i)), range(len(broken)), F)
    counts = [F.count_if(b).alias(f"failed_{i}") for i, b in enumerate(broken)]
    return counts + [F.count_if(first == i).alias(f"dropped_{i}") for i in range(len(broken))]


def silver_financials(
    df: DataFrame,
    max_interest_rate: int | None = None,
    ratio_name: str = INVESTMENT_RATIO,
    losses: Observation | None = None,
) -> DataFrame:
    """Clean the 22 columns of customer finances and drop rows that break a hard rule.

    Every rule reads its own column only: one projection types the text, one
    conjunctive filter drops rows, one projection applies the range rules. With
    `max_interest_rate` the rate is a whole number and rows above the bound go;
    without it the rate stays as read. `losses` observes, in the job that reads the
    result and without another scan, what each rule drops (see financial_losses).
    """
    raw = {name: F.col(name).cast("string") for name in df.columns}

    rate = text_to_double(raw["Interest_Rate"])
    if max_interest_rate is not None:
        rate = text_to_int(raw["Interest_Rate"])
    income = strip_underscores(tokens_to(raw["Annual_Income"], INCOME_BLANKS, "0"))
    invested = tokens_to(raw["Amount_invested_monthly"], [INVESTED_BLANK], "0")
    balance = F.coalesce(strip_underscores(raw["Monthly_Balance"]), F.lit("0"))

    typed = {
        "Customer_ID": raw["Customer_ID"],
        "Annual_Income": text_to_float(income),
        "Monthly_Inhand_Salary": text_to_float(raw["Monthly_Inhand_Salary"]),
        "Num_Bank_Accounts": text_to_int(raw["Num_Bank_Accounts"]),
        "Num_Credit_Card": digits_to_int_or_zero(raw["Num_Credit_Card"]),
        "Interest_Rate": rate,
        "Num_of_Loan": digits_to_int(strip_underscores(raw["Num_of_Loan"])),
        "Type_of_Loan": blank_to(raw["Type_of_Loan"], UNKNOWN),
        "Delay_from_due_date": text_to_int(raw["Delay_from_due_date"]),
        "Num_of_Delayed_Payment": digits_to_int(strip_underscores(raw["Num_of_Delayed_Payment"])),
        "Changed_Credit_Limit": signed_decimal_to_float(raw["Changed_Credit_Limit"]),
        "Num_Credit_Inquiries": text_to_int(raw["Num_Credit_Inquiries"]),
        "Credit_Mix": tokens_to(raw["Credit_Mix"], [CREDIT_MIX_BLANK], UNKNOWN),
        "Outstanding_Debt": text_to_float(strip_underscores(raw["Outstanding_Debt"])),
        "Credit_Utilization_Ratio": text_to_double(raw["Credit_Utilization_Ratio"]),
        "Payment_of_Min_Amount": tokens_to(
            raw["Payment_of_Min_Amount"], [MIN_AMOUNT_BLANK], UNKNOWN
        ),
        "Total_EMI_per_month": text_to_double(raw["Total_EMI_per_month"]),
        "Amount_invested_monthly": text_to_double(invested),
        "Payment_Behaviour": tokens_to(raw["Payment_Behaviour"], [BEHAVIOUR_BLANK], UNKNOWN),
        "Monthly_Balance": text_to_double(balance),
        SNAPSHOT: cast_column(F.col(SNAPSHOT), df.schema[SNAPSHOT].dataType, "date"),
        "Credit_History_Age_In_Months": history_months(raw["Credit_History_Age"]),
    }
    # Bounds hold for the number as read; only then is it cut to a whole one.
    read = {
        "_banks": text_to_double(raw["Num_Bank_Accounts"]),
        "_delay": text_to_double(raw["Delay_from_due_date"]),
        "_asked": text_to_double(raw["Num_Credit_Inquiries"]),
    }
    # A comparison with NULL is no match, so these also drop what could not be typed.
    row_rules = {
        "Num_Bank_Accounts": F.col("Num_Bank_Accounts").isNotNull()
        & F.col("_banks").between(0, MAX_BANK_ACCOUNTS),
        "Num_Credit_Card": F.col("Num_Credit_Card") <= MAX_CREDIT_CARDS,
        "Num_of_Loan": F.col("Num_of_Loan").between(*LOANS_RANGE),
        "Delay_from_due_date": F.col("Delay_from_due_date").isNotNull() & (F.col("_delay") >= 0),
        "Num_of_Delayed_Payment": F.col("Num_of_Delayed_Payment").between(*DELAYED_PAYMENTS_RANGE),
        "Changed_Credit_Limit": F.col("Changed_Credit_Limit").isNotNull(),
    }
    if max_interest_rate is not None:
        row_rules["Interest_Rate"] = F.col("Interest_Rate") <= max_interest_rate

    asked = F.col("Num_Credit_Inquiries")
    salary = F.col("Monthly_Inhand_Salary")
    ratio = F.try_divide(F.col("Amount_invested_monthly"), salary).cast("float").cast("double")
    ranged = {
        # No number or a negative one means no activity; an implausible one is unknown.
        "Num_Credit_Inquiries": F.when(asked.isNull() | (F.col("_asked") < 0), F.lit(0)).when(
            F.col("_asked") <= MAX_INQUIRIES, asked
        ),
        "Total_EMI_per_month": null_outside(F.col("Total_EMI_per_month"), 0),
        "Monthly_Balance": F.when(F.col("Monthly_Balance") < 0, F.lit(0.0)).otherwise(
            F.col("Monthly_Balance")
        ),
        ratio_name: F.when(salary.isNull() | (salary == 0), F.lit(0.0)).otherwise(ratio),
    }
    rows = df.select(*[c.alias(name) for name, c in {**typed, **read}.items()])
    if losses is not None:
        names = F.lit(",".join(row_rules))
        rows = rows.observe(losses, F.count(F.lit(1)).alias("rows"), F.max(names).alias("rules"), *rule_counts(row_rules))
    return rows.where(reduce(and_, row_rules.values())).withColumns(ranged).drop(*read)


LOSS_SCHEMA = "position int, rule string, failed long, dropped long, rows long"


def financial_losses(found: Mapping[str, int | str | None]) -> list[tuple]:
    """Rows of LOSS_SCHEMA from what was observed; no rows where nothing was read.

    `failed` counts all rows that break the rule, `dropped` those that no earlier rule dropped.
    """
    names = (found.get("rules") or "").split(",") if found.get("rows") else []
    return [
        (i, name, found[f"failed_{i}"], found[f"dropped_{i}"], found["rows"])
        for i, name in enumerate(names)
    ]
