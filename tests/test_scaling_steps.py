"""Steps that must stay cheap a row: parsing by pattern only where needed, no shuffle that nothing needs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from riskmart.catalog.queries import shown
from riskmart.functions import dates, numeric
from riskmart.operators.silver import parse_snapshot
from riskmart.plans.mart import in_months
from riskmart.streaming import ingest


def test_fast_parsers_agree_with_the_patterns(spark):
    rng = random.Random(1)
    texts = [None, "", "1995-06-1 ", "1995-06-1T", "12345-1-01", "1995-02-30", "10/7/2023", "1995-06-01\n"]
    for _ in range(2000):
        text = list("1995-06-01")
        for _ in range(rng.randrange(1, 4)):
            text[rng.randrange(len(text))] = rng.choice(["1", "9", "-", " ", "T", "+", "\n", "٣", "/"])
        texts.append("".join(text))
        texts.append("".join(rng.choice(["0", "7", "+", "-", ".", " ", "\t", "e", "٣", "2147483647"]) for _ in range(rng.randrange(1, 6))))
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    for fast, pattern in ((dates.parse_date, dates._date_by_pattern), (numeric.text_to_int, numeric._whole_part)):
        assert rows.where(~fast(c).eqNullSafe(pattern(c))).isEmpty()


def test_whole_numbers_are_shown_as_rounding_gives_them(spark):
    values = [None, 0.0, -0.0, 1.0, -3.0, 1e300, float("nan"), float("inf"), float("-inf"), 0.1234565, -0.0000001, 2.5]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    text = F.col("x").cast("string").alias("x")
    assert shown(rows).select(text).collect() == rows.select(F.round("x", 6).alias("x")).select(text).collect()


def test_month_filter_mentions_the_parsed_date_once(spark):
    raw = spark.createDataFrame([("1995-01-01",), ("2/1/1995",), ("1/3/1995",), ("1/4/1995",), (None,)], "snapshot_date string")
    kept = in_months(parse_snapshot(raw), dt.date(1995, 1, 20), dt.date(1995, 3, 15))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert sum(line.count("regexp_extract") for line in filters) <= 1
    assert sorted(r[0] for r in kept.collect()) == [dt.date(1995, 1, 1), dt.date(1995, 3, 1)]


def test_a_stream_batch_is_shuffled_once(spark, tmp_path, monkeypatch):
    asked = []
    write = ingest.overwrite_snapshots
    monkeypatch.setattr(ingest, "overwrite_snapshots", lambda df, path, by, compact=True: asked.append(compact) or write(df, path, by, compact))
    names = ingest.LOAN_RAW_SCHEMA.names
    batch = spark.createDataFrame([tuple("2024-01-01" if n.endswith("date") else "1" for n in names)], ", ".join(f"{n} string" for n in names))
    assert ingest.take_batch(batch.withColumn(ingest.FILE, F.lit("f")), "b-1", f"{tmp_path}/bronze", f"{tmp_path}/silver", ingest.silver_loan)
    assert asked == [True, False] and spark.read.parquet(f"{tmp_path}/silver").count() == 1
