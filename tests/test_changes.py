import datetime as dt
import os

from pyspark.sql import functions as F

from riskmart.plans import mart as jobs
from riskmart.plans.changes import backfill_changed, runs_of
from riskmart.plans.layout import Mart
from riskmart.sources import read_table
from tests.helpers import as_set
from tests.test_jobs import raw_frames

START, END = dt.date(2023, 1, 1), dt.date(2023, 12, 1)


def files_below(root):
    found = {}
    for folder, _, names in os.walk(root):
        found.update({os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names})
    return found


def written_months(before, after, table):
    changed = {f for f in set(before) | set(after) if before.get(f) != after.get(f) and f"/{table}/" in f and "snapshot_date=" in f}
    return {f.split("snapshot_date=")[1][:10] for f in changed}


def test_runs_of_months():
    days = [dt.date(2023, 12, 1), dt.date(2024, 1, 1), dt.date(2024, 3, 1), dt.date(2023, 1, 1)]
    assert runs_of(days) == [(days[3], days[3]), (days[0], days[1]), (days[2], days[2])]
    assert runs_of([]) == []


def test_only_changed_months_are_built(spark, tmp_path):
    raw = {}
    for name, df in raw_frames(spark).items():
        raw[name] = f"{tmp_path}/raw/{name}"
        if name == "lms_loan_daily":
            # One file a month, as the loans come.
            for row in df.select("snapshot_date").distinct().collect():
                month = df.where(F.col("snapshot_date") == row[0]).coalesce(1)
                month.write.mode("append").option("header", True).csv(raw[name])
        else:
            df.coalesce(1).write.option("header", True).csv(raw[name])
    mart = Mart(f"{tmp_path}/mart")
    assert len(backfill_changed(spark, mart, raw, START, END)) == 12
    whole = Mart(f"{tmp_path}/whole")
    jobs.backfill(spark, whole, raw, START, END)
    assert as_set(read_table(spark, mart.feature_store)) == as_set(read_table(spark, whole.feature_store))
    assert as_set(read_table(spark, mart.label_store)) == as_set(read_table(spark, whole.label_store))

    before = files_below(mart.root)
    assert backfill_changed(spark, mart, raw, START, END) == [] and files_below(mart.root) == before

    # One loan of one month is paid late.
    folder = raw["lms_loan_daily"]
    target = next(f for f in sorted(os.listdir(folder)) if f.endswith(".csv") and ",1/5/2023" in open(f"{folder}/{f}").read())
    text = open(f"{folder}/{target}").read()
    os.remove(f"{folder}/.{target}.crc")
    with open(f"{folder}/{target}", "w") as out:
        out.write(text.replace(",250,", ",9250,"))
    may = dt.date(2023, 5, 1)
    assert backfill_changed(spark, mart, raw, START, END) == [may]
    for table in ("bronze/lms_loan_daily", "silver/lms_loan_daily", "label_store", "feature_store"):
        assert written_months(before, files_below(mart.root), table) == {"2023-05-01"}
    assert written_months(before, files_below(mart.root), "bronze/feature_clickstream") == set()
    jobs.backfill(spark, whole, raw, START, END)
    assert as_set(read_table(spark, mart.feature_store)) == as_set(read_table(spark, whole.feature_store))

    # The file goes, and so does the month; a wider range adds the months it did not have.
    os.remove(f"{folder}/{target}")
    assert backfill_changed(spark, mart, raw, START, END) == [may]
    assert read_table(spark, mart.label_store).where(F.col("snapshot_date") == may).count() == 0
    assert backfill_changed(spark, mart, raw, START, dt.date(2024, 2, 1)) == [dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    # Customers are joined without a date: all months.
    with open(f"{raw['features_attributes']}/more.csv", "w") as out:
        out.write("Customer_ID,Name,SSN,Age,Occupation,snapshot_date\nC1,N,1,50,Chef,1/7/2023\n")
    assert len(backfill_changed(spark, mart, raw, START, dt.date(2024, 2, 1))) == 14
    # What goes while a run does not cover it is made good by the next one that does.
    first = next(f for f in os.listdir(folder) if f.endswith(".csv") and ",1/1/2023\n" in open(f"{folder}/{f}").read())
    os.remove(f"{folder}/{first}")
    later = dt.date(2023, 6, 1)
    assert backfill_changed(spark, mart, raw, later, END) == []
    assert START in backfill_changed(spark, mart, raw, START, END)
    assert read_table(spark, mart.label_store).where(F.col("snapshot_date") == START).count() == 0
