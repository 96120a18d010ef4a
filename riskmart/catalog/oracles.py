"""SQL that computes the registered queries a second time, for the checking engine.

Written on its own from the rules of the mart; only the select lists that turn
the given tables into raw sources are shared with the Spark side. Dates are
shown as text and floating point numbers rounded to six digits on both sides.
"""

from __future__ import annotations

from riskmart.catalog import standins as s
from riskmart.sources.schemas import CLICK_FEATURES, FINANCIAL_FEATURE_TYPES


def r6(expression: str, name: str | None = None) -> str:
    shown = f"round(CAST({expression} AS DOUBLE), 6) + 0.0"
    return f"{shown} AS {name or expression}"


def day(name: str = "snapshot_date") -> str:
    return f"CAST({name} AS VARCHAR) AS {name}"


def with_(*tables: tuple[str, str]) -> str:
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in tables) + " "


def integer(text: str) -> str:
    """Truncating text -> int of plain decimals, everything else NULL."""
    return (
        f"(CASE WHEN regexp_full_match(trim({text}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') "
        f"THEN TRY_CAST(trunc(CAST(trim({text}) AS DOUBLE)) AS INTEGER) END)"
    )


def real(text: str) -> str:
    return f"TRY_CAST({text} AS FLOAT)"


def double(text: str) -> str:
    return f"TRY_CAST({text} AS DOUBLE)"


def stripped(text: str) -> str:
    return f"replace({text}, '_', '')"


def digits(text: str) -> str:
    return f"(CASE WHEN regexp_full_match({text}, '[0-9]+') THEN {text} END)"


def date_of(text: str) -> str:
    return (
        f"COALESCE(CAST(try_strptime({text}, '%d/%m/%Y') AS DATE), "
        f"CAST(try_strptime({text}, '%Y-%m-%d') AS DATE))"
    )


def between(value: str, low: int, high: int) -> str:
    return f"(CASE WHEN {value} >= {low} AND {value} <= {high} THEN {value} END)"


# --- loans -----------------------------------------------------------------

_TYPED = (
    "SELECT loan_id, Customer_ID, loan_start_date, tenure, installment_num, "
    "CAST(loan_amt AS FLOAT) AS loan_amt, CAST(due_amt AS FLOAT) AS due_amt, "
    "CAST(paid_amt AS FLOAT) AS paid_amt, CAST(overdue_amt AS FLOAT) AS overdue_amt, "
    "CAST(balance AS FLOAT) AS balance, snapshot_date, installment_num AS mob FROM loan_raw"
)
_MISSED = (
    "SELECT *, CAST(CASE WHEN due_amt <> 0 THEN "
    "ceil(CAST(overdue_amt AS DOUBLE) / CAST(due_amt AS DOUBLE)) ELSE 0 END AS INTEGER) "
    "AS installments_missed FROM typed"
)
_FIRST = (
    "SELECT *, CASE WHEN installments_missed > 0 THEN "
    "CAST(snapshot_date - to_months(installments_missed) AS DATE) END AS first_missed_date "
    "FROM missed"
)
_DPD = (
    "SELECT *, CAST(CASE WHEN overdue_amt > 0 THEN "
    "date_diff('day', first_missed_date, snapshot_date) ELSE 0 END AS INTEGER) AS dpd FROM dated"
)
LOANS = (
    ("loan_raw", s.LOANS_SQL),
    ("typed", _TYPED),
    ("missed", _MISSED),
    ("dated", _FIRST),
    ("loans", _DPD),
)
_FILLED = (
    "SELECT * REPLACE (COALESCE(due_amt, 0) AS due_amt, COALESCE(overdue_amt, 0) AS overdue_amt, "
    "COALESCE(installments_missed, 0) AS installments_missed) FROM missed_gaps"
)
LOANS_FILLED = (
    ("loan_raw", s.LOANS_SQL),
    ("typed", _TYPED),
    ("missed_gaps", _MISSED),
    ("missed", _FILLED),
    ("dated", _FIRST),
    ("loans", _DPD),
)
LOAN_OUT = ", ".join(
    [
        "loan_id",
        "Customer_ID",
        day("loan_start_date"),
        "tenure",
        "installment_num",
        r6("loan_amt"),
        r6("due_amt"),
        r6("paid_amt"),
        r6("overdue_amt"),
        r6("balance"),
        day(),
        "mob",
        "installments_missed",
        "date_diff('day', DATE '1970-01-01', first_missed_date)::INTEGER AS first_missed_date",
        "dpd",
    ]
)
LABELS = (
    "labels_at",
    "SELECT loan_id, Customer_ID, CASE WHEN dpd >= 30 THEN 1 ELSE 0 END AS label, "
    "'30dpd_6mob' AS label_def, snapshot_date FROM loans WHERE mob = 6",
)
_RATIO = "CAST(CASE WHEN {d} <> 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE 0 END AS FLOAT)"
LOAN_FEATURES = (
    "loan_features",
    "SELECT loan_id, Customer_ID, "
    + _RATIO.format(n="paid_amt", d="due_amt")
    + " AS payment_ratio, "
    + _RATIO.format(n="overdue_amt", d="loan_amt")
    + " AS overdue_ratio, CAST(trunc(balance) AS INTEGER) AS balance, snapshot_date, "
    "installments_missed, dpd FROM loans WHERE mob = 6",
)

# --- click features, attributes, finances ----------------------------------

CLICKS = (
    ("click_raw", s.CLICKS_SQL),
    (
        "clicks",
        "SELECT Customer_ID, snapshot_date, "
        + ", ".join(f"GREATEST(COALESCE(TRY_CAST({f} AS INTEGER), 0), 0) AS {f}" for f in CLICK_FEATURES)
        + " FROM click_raw",
    ),
)
ATTRIBUTES = (
    ("attribute_raw", s.ATTRIBUTES_SQL),
    (
        "aged",
        "SELECT Customer_ID, " + between(integer(stripped("Age")), 0, 100) + " AS Age, "
        "COALESCE(CASE WHEN NOT contains(Occupation, '_______') THEN Occupation END, 'Unknown') "
        "AS Occupation, " + date_of("snapshot_date") + " AS snapshot_date FROM attribute_raw",
    ),
    (
        "attributes",
        "SELECT Customer_ID, COALESCE(Age, (SELECT quantile_disc(Age, 0.5) FROM aged)) AS Age, "
        "Occupation, snapshot_date FROM aged",
    ),
)


def finances(raw: str, max_rate: int | None = None) -> tuple[tuple[str, str], ...]:
    rate = double("Interest_Rate") if max_rate is None else integer("Interest_Rate")
    balance = stripped("Monthly_Balance")
    cleaned = [
        "Customer_ID",
        "TRY_CAST(CASE WHEN Annual_Income IN ('NA', 'nan', '') THEN '0' ELSE "
        + stripped("Annual_Income")
        + " END AS FLOAT) AS Annual_Income",
        real("Monthly_Inhand_Salary") + " AS Monthly_Inhand_Salary",
        f"(CASE WHEN {double('Num_Bank_Accounts')} >= 0 AND {double('Num_Bank_Accounts')} <= 10 "
        f"THEN {integer('Num_Bank_Accounts')} END) "
        "AS Num_Bank_Accounts",
        f"COALESCE({integer(digits('Num_Credit_Card'))}, 0) AS Num_Credit_Card",
        rate + " AS Interest_Rate",
        between(integer(digits(stripped("Num_of_Loan"))), 0, 50) + " AS Num_of_Loan",
        "CASE WHEN Type_of_Loan IS NULL OR Type_of_Loan = '' THEN 'Unknown' ELSE Type_of_Loan END "
        "AS Type_of_Loan",
        f"(CASE WHEN {double('Delay_from_due_date')} >= 0 THEN {integer('Delay_from_due_date')} "
        "END) AS Delay_from_due_date",
        between(integer(digits(stripped("Num_of_Delayed_Payment"))), 0, 100)
        + " AS Num_of_Delayed_Payment",
        "CASE WHEN regexp_full_match(Changed_Credit_Limit, '-?[0-9]+([.][0-9]+)?') "
        "THEN CAST(Changed_Credit_Limit AS FLOAT) END AS Changed_Credit_Limit",
        f"CASE WHEN asked > 0 AND {double('Num_Credit_Inquiries')} > 50 THEN NULL ELSE asked END "
        "AS Num_Credit_Inquiries",
        "CASE WHEN Credit_Mix = '_' THEN 'Unknown' ELSE Credit_Mix END AS Credit_Mix",
        real(stripped("Outstanding_Debt")) + " AS Outstanding_Debt",
        double("Credit_Utilization_Ratio") + " AS Credit_Utilization_Ratio",
        "CASE WHEN Payment_of_Min_Amount = 'NM' THEN 'Unknown' ELSE Payment_of_Min_Amount END "
        "AS Payment_of_Min_Amount",
        f"CASE WHEN {double('Total_EMI_per_month')} >= 0 THEN {double('Total_EMI_per_month')} END "
        "AS Total_EMI_per_month",
        "CASE WHEN Amount_invested_monthly = '__10000__' THEN 0 ELSE "
        + double("Amount_invested_monthly")
        + " END AS Amount_invested_monthly",
        "CASE WHEN Payment_Behaviour = '!@9#%8' THEN 'Unknown' ELSE Payment_Behaviour END "
        "AS Payment_Behaviour",
        f"CASE WHEN Monthly_Balance IS NULL OR {real(balance)} < 0 THEN 0 ELSE {double(balance)} "
        "END AS Monthly_Balance",
        date_of("snapshot_date") + " AS snapshot_date",
        "TRY_CAST(regexp_extract(Credit_History_Age, '([0-9]+)\\s*Years', 1) AS INTEGER) * 12 + "
        "TRY_CAST(regexp_extract(Credit_History_Age, '([0-9]+)\\s*Months', 1) AS INTEGER) "
        "AS Credit_History_Age_In_Months",
    ]
    asked = integer("Num_Credit_Inquiries")
    rules = (
        "Num_Bank_Accounts <= 10 AND Num_Credit_Card <= 20 AND Num_of_Loan IS NOT NULL "
        "AND Delay_from_due_date IS NOT NULL AND Num_of_Delayed_Payment IS NOT NULL "
        "AND Changed_Credit_Limit IS NOT NULL"
    )
    if max_rate is not None:
        rules += f" AND Interest_Rate <= {max_rate}"
    return (
        ("finance_raw", raw),
        (
            "finance_asked",
            f"SELECT *, CASE WHEN {double('Num_Credit_Inquiries')} >= 0 THEN COALESCE({asked}, 0) ELSE 0 END "
            "AS asked FROM finance_raw",
        ),
        ("finance_clean", f"SELECT {', '.join(cleaned)} FROM finance_asked"),
        (
            "finances",
            'SELECT *, CASE WHEN Monthly_Inhand_Salary IS NULL OR Monthly_Inhand_Salary = 0 THEN 0 '
            "ELSE CAST(CAST(Amount_invested_monthly / CAST(Monthly_Inhand_Salary AS DOUBLE) "
            'AS FLOAT) AS DOUBLE) END AS "Investment Ratio" '
            f"FROM finance_clean WHERE {rules}",
        ),
    )


def finance_losses(max_rate: int) -> str:
    """Per rule the rows of finance_clean that break it, and those that no earlier rule drops."""
    kept = [
        ("Num_Bank_Accounts", "Num_Bank_Accounts IS NOT NULL"),
        ("Num_Credit_Card", "Num_Credit_Card <= 20"),
        ("Num_of_Loan", "Num_of_Loan IS NOT NULL"),
        ("Delay_from_due_date", "Delay_from_due_date IS NOT NULL"),
        ("Num_of_Delayed_Payment", "Num_of_Delayed_Payment IS NOT NULL"),
        ("Changed_Credit_Limit", "Changed_Credit_Limit IS NOT NULL"),
        ("Interest_Rate", f"COALESCE(Interest_Rate <= {max_rate}, FALSE)"),
    ]
    parts = []
    for i, (name, rule) in enumerate(kept):
        before = " AND ".join(["TRUE", *[r for _, r in kept[:i]]])
        parts.append(
            f"SELECT {i}::INTEGER AS position, '{name}' AS rule, count(*) FILTER (NOT ({rule})) AS failed, "
            f"count(*) FILTER ({before} AND NOT ({rule})) AS dropped, count(*) AS rows FROM finance_clean"
        )
    return " UNION ALL ".join(parts)


FINANCE_REALS = [
    "Annual_Income",
    "Monthly_Inhand_Salary",
    "Changed_Credit_Limit",
    "Outstanding_Debt",
    "Credit_Utilization_Ratio",
    "Total_EMI_per_month",
    "Amount_invested_monthly",
    "Monthly_Balance",
]
FINANCE_OUT = ", ".join(
    [
        "Customer_ID",
        *[r6(c) for c in FINANCE_REALS],
        "Num_Bank_Accounts",
        "Num_Credit_Card",
        "Num_of_Loan",
        "Type_of_Loan",
        "Delay_from_due_date",
        "Num_of_Delayed_Payment",
        "Num_Credit_Inquiries",
        "Credit_Mix",
        "Payment_of_Min_Amount",
        "Payment_Behaviour",
        day(),
        "Credit_History_Age_In_Months",
        r6('"Investment Ratio"'),
    ]
)

# Categories by frequency, then name.
VOCABULARY = {
    "Credit_Mix": 4,
    "Payment_of_Min_Amount": 3,
    "Payment_Behaviour": 5,
}


def ranked(source: str, column: str) -> tuple[str, str]:
    return (
        f"rank_{column}",
        f"SELECT {column} AS category, CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) "
        f"- 1 AS INTEGER) AS idx FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}",
    )


def flags(column: str, width: int) -> list[str]:
    return [
        f"CASE WHEN {column} = (SELECT category FROM rank_{column} WHERE idx = {i}) "
        f"THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {column}_ohe_{i}"
        for i in range(width)
    ]


_FIN_NUMERIC = [f'"{c}"' for c in FINANCIAL_FEATURE_TYPES if c not in ("Interest_Rate",)]
GOLD_FINANCES = (
    *[ranked("finances", c) for c in VOCABULARY],
    (
        "gold_finances",
        f"SELECT {', '.join(_FIN_NUMERIC)}, CAST(trunc(Interest_Rate) AS INTEGER) AS Interest_Rate, "
        + ", ".join(f for c, n in VOCABULARY.items() for f in flags(c, n))
        + " FROM finances",
    ),
)
GOLD_ATTRIBUTES = (
    ranked("attributes", "Occupation"),
    (
        "gold_attributes",
        f"SELECT Customer_ID, Age, {', '.join(flags('Occupation', 6))} FROM attributes",
    ),
)
FINANCE_FLAGS = [f"{c}_ohe_{i}" for c, n in VOCABULARY.items() for i in range(n)]
OCCUPATION_FLAGS = [f"Occupation_ohe_{i}" for i in range(6)]
FINANCE_INTS = [c for c, t in FINANCIAL_FEATURE_TYPES.items() if t == "int"]
GOLD_FINANCE_OUT = [
    *FINANCE_INTS,
    *[r6(c) for c in FINANCE_REALS],
    r6('"Investment Ratio"'),
    *FINANCE_FLAGS,
]

STORE = (
    *LOANS,
    LOAN_FEATURES,
    *CLICKS,
    *ATTRIBUTES,
    *GOLD_ATTRIBUTES,
    *finances(s.CUSTOMER_FINANCES_SQL),
    *GOLD_FINANCES,
    (
        "store",
        "SELECT * FROM loan_features LEFT JOIN gold_finances USING (Customer_ID) "
        "LEFT JOIN gold_attributes USING (Customer_ID) "
        "LEFT JOIN clicks USING (Customer_ID, snapshot_date)",
    ),
)
# Read back from CSV files an empty text is a NULL.
STORE_FROM_FILES = tuple(
    (name, sql.replace("FROM finance_raw", "FROM finance_filed")) if name == "finance_asked" else (name, sql)
    for name, sql in STORE
)
_AT = [name for name, _ in STORE].index("finance_asked")
STORE_FROM_FILES = (
    *STORE_FROM_FILES[:_AT],
    (
        "finance_filed",
        "SELECT * REPLACE (NULLIF(Annual_Income, '') AS Annual_Income, "
        "NULLIF(Type_of_Loan, '') AS Type_of_Loan) FROM finance_raw",
    ),
    *STORE_FROM_FILES[_AT:],
)
STORE_OUT = ", ".join(
    [
        "loan_id",
        "Customer_ID",
        day(),
        r6("payment_ratio"),
        r6("overdue_ratio"),
        "balance",
        "installments_missed",
        "dpd",
        *GOLD_FINANCE_OUT,
        "Age",
        *OCCUPATION_FLAGS,
        *CLICK_FEATURES,
    ]
)
TRAIN_FEATURES = [
    *FINANCIAL_FEATURE_TYPES,
    *FINANCE_FLAGS,
    "Age",
    *OCCUPATION_FLAGS,
    *CLICK_FEATURES,
]

# --- labels with scores ----------------------------------------------------

SCORED = (
    *LOANS,
    LABELS,
    ("preds", s.PREDICTIONS_SQL),
    (
        "scored",
        "SELECT Customer_ID, snapshot_date, model_predictions, "
        "CASE WHEN model_predictions > 0.5 THEN 1 ELSE 0 END AS binary_prediction, label "
        "FROM preds JOIN labels_at USING (Customer_ID, snapshot_date)",
    ),
)
DOCUMENTS = ("scored", s.SCORED_DOCUMENTS_SQL)


def auc(by: str = "snapshot_date", source: str = "scored") -> tuple[tuple[str, str], ...]:
    return (
        (
            "placed",
            f"SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY model_predictions) + "
            f"(count(*) OVER (PARTITION BY {by}, model_predictions) - 1) / 2.0::DOUBLE AS place "
            f"FROM {source}",
        ),
        (
            "auc",
            f"SELECT {by}, CAST(sum(label) AS BIGINT) AS positives, "
            "CAST(sum(1 - label) AS BIGINT) AS negatives, "
            "(sum(CASE WHEN label = 1 THEN place END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)"
            " / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) AS auc "
            f"FROM placed GROUP BY {by} HAVING min(label) <> max(label)",
        ),
    )


F1 = (
    "f1",
    "SELECT snapshot_date, COALESCE(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1 FROM ("
    "SELECT snapshot_date, count(*) FILTER (model_predictions > 0.5 AND label = 1) AS tp, "
    "count(*) FILTER (model_predictions > 0.5 AND label = 0) AS fp, "
    "count(*) FILTER (model_predictions <= 0.5 AND label = 1) AS fn FROM scored "
    "GROUP BY snapshot_date HAVING min(label) <> max(label)) AS counts",
)

# --- drift -----------------------------------------------------------------

DRIFT_FEATURES = [
    "loan_amt",
    "due_amt",
    "paid_amt",
    "overdue_amt",
    "balance",
    "installments_missed",
    "dpd",
]
BASELINE = "1997-06-01"
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in DRIFT_FEATURES)
_PROBABILITIES = ", ".join(f"{i * 0.1!r}::DOUBLE" for i in range(1, 10))
DRIFT = (
    *LOANS,
    (
        "long",
        " UNION ALL ".join(
            f"SELECT snapshot_date, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM loans "
            f"WHERE {_COMPLETE}"
            for c in DRIFT_FEATURES
        ),
    ),
    (
        "edges",
        f"SELECT feature, quantile_cont(x, [{_PROBABILITIES}]) AS e FROM long "
        f"WHERE snapshot_date = DATE '{BASELINE}' GROUP BY feature",
    ),
    (
        "binned",
        "SELECT snapshot_date, feature, len(list_filter(e, lambda q: q <= x)) AS bin, "
        f"snapshot_date = DATE '{BASELINE}' AS base FROM long JOIN edges USING (feature) "
        f"WHERE snapshot_date >= DATE '{BASELINE}'",
    ),
    (
        "counted",
        "SELECT snapshot_date, feature, bin, base, count(*) AS n, "
        "sum(count(*)) OVER (PARTITION BY snapshot_date, feature) AS total FROM binned "
        "GROUP BY snapshot_date, feature, bin, base",
    ),
    (
        "grid",
        "SELECT snapshot_date, feature, bin FROM "
        "(SELECT DISTINCT snapshot_date, feature FROM counted WHERE NOT base) AS pairs "
        "CROSS JOIN (SELECT unnest(range(0, 10)) AS bin) AS bins",
    ),
    (
        "shares",
        "SELECT grid.snapshot_date, grid.feature, COALESCE(a.n / a.total::DOUBLE, 0) AS a, "
        "COALESCE(b.n / b.total::DOUBLE, 0) AS e FROM grid "
        "LEFT JOIN counted AS a ON a.snapshot_date = grid.snapshot_date "
        "AND a.feature = grid.feature AND a.bin = grid.bin "
        "LEFT JOIN counted AS b ON b.base AND b.feature = grid.feature AND b.bin = grid.bin",
    ),
    (
        "psi",
        "SELECT snapshot_date, feature, sum((a - e) * ln((a + 1e-6) / (e + 1e-6))) AS psi "
        "FROM shares GROUP BY snapshot_date, feature",
    ),
)
ROLLUP = (
    "rollup_",
    "SELECT snapshot_date, count(DISTINCT feature) AS n_features, "
    "count(*) FILTER (psi > 0.2) AS n_critical, "
    "count(*) FILTER (psi > 0.1 AND psi <= 0.2) AS n_warning, "
    "count(*) FILTER (psi IS NULL) AS n_unknown FROM psi GROUP BY snapshot_date",
)
ALERT = (
    "alerts",
    "SELECT *, (n_critical + n_warning) / n_features::DOUBLE AS share_drifted, "
    "n_critical >= 5 OR (n_critical + n_warning) / n_features::DOUBLE >= 0.3 AS alert FROM rollup_",
)
