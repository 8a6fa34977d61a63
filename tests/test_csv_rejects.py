"""Malformed lines of the delivered file are set apart with their reason; the others load."""
from ledgerlens.schema import CSV_FILE
from ledgerlens.sources.card_csv import read_card_csv, read_card_csv_with_rejects


def line(**values) -> str:
    return ",".join(str(values.get(c, "0")) for c in CSV_FILE.names)


def test_good_and_rejected_lines_add_up(spark, tmp_path):
    short = ",".join(["0"] * 30)
    bad = {line(Amount="12.x"): "Amount is not ", line(V7="--"): "V7 is not ", short: "30 fields", line() + ",9": "32 fields"}
    good = [line(Time="1", Amount="2.50"), line(Time="2", V3=""), line(Time="3", Class='"1"')]
    (tmp_path / "card.csv").write_text("\n".join([",".join(CSV_FILE.names), *good, *bad, next(iter(bad))]) + "\n")
    staging, rejected = read_card_csv_with_rejects(spark, str(tmp_path / "card.csv"))
    assert staging.count() == 3 and rejected.count() == len(bad) + 1
    assert staging.select("time_seconds").count() == 3
    rows = rejected.collect()
    assert {r.line for r in rows} == set(bad)
    assert all(r.reason.startswith(bad[r.line]) and r.file.endswith("card.csv") for r in rows)
    loaded = {int(r.time_seconds): r for r in staging.collect()}
    assert float(loaded[1].amount) == 2.5 and loaded[2].v3 is None


def test_without_malformed_lines_equals_the_strict_read(spark, tmp_path):
    (tmp_path / "card.csv").write_text("\n".join([",".join(CSV_FILE.names), line(Time="5"), line(Time="6", V1="-1.5")]) + "\n")
    staging, rejected = read_card_csv_with_rejects(spark, str(tmp_path))
    assert rejected.count() == 0
    strict = read_card_csv(spark, str(tmp_path))
    assert staging.schema == strict.schema and sorted(staging.collect()) == sorted(strict.collect())
