import os

import pytest

from martwright import sinks
from martwright.__main__ import main, reports
from martwright.operators.clean import customers_clean
from martwright.plans import views
from martwright.sources import tables, testdata


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_readers_round_trip(make_events, make_customers, make_products, rows, spark, tmp_path, format):
    frames = {
        tables.read_events: make_events(dict(), dict(region=None)),
        tables.read_customers: make_customers(dict()),
        tables.read_products: make_products(dict(), dict(product_name="X Add–on")),
    }
    for n, (read, df) in enumerate(frames.items()):
        path = str(tmp_path / f"{n}")
        writer = df.write.option("header", True) if format == "csv" else df.write
        writer.format(format).save(path)
        back = read(spark, path, format=format)
        assert back.schema.simpleString() == df.schema.simpleString()
        assert rows(back) == rows(df)


@pytest.mark.parametrize("format", ["parquet", "csv"])
@pytest.mark.parametrize("kind", ["date", "timestamp", "string"])
def test_customers_as_imported(make_customers, rows, spark, tmp_path, format, kind):
    final = make_customers(dict(), dict(customer_id="C2"))
    imported = final.withColumnsRenamed({"region_customers": "region", "country_customers": "country"})
    imported = imported.select(*reversed(imported.columns)).withColumn("signup_date", imported.signup_date.cast(kind))
    path = str(tmp_path / "customers")
    (imported.write.option("header", True) if format == "csv" else imported.write).format(format).save(path)
    back = tables.read_customers(spark, path, format=format)
    assert back.schema.simpleString() == final.schema.simpleString()
    assert rows(back) == rows(final)


def test_csv_header_must_fit(spark, make_events, tmp_path):
    path = str(tmp_path / "swapped")
    make_events(dict()).select("customer_id", "event_id").write.option("header", True).csv(path)
    with pytest.raises(Exception):
        tables.read_events(spark, path, format="csv").collect()


def test_missing_columns_fail(spark, make_events, tmp_path):
    path = str(tmp_path / "narrow")
    make_events(dict()).drop("region").write.parquet(path)
    with pytest.raises(ValueError, match="region"):
        tables.read_events(spark, path)


def test_job_builds_everything(make_events, make_customers, make_products, rows, spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    products = make_products(dict(), dict(product_name="X Add?on"))
    events = make_events(dict(), dict(product_id="P2"), dict(event_date="2025-01-01", net_revenue_usd=2.5), dict(customer_id="C7"))
    for name, df in {"events": events, "customers": make_customers(dict()), "products": products}.items():
        df.write.parquet(str(raw / name))
    arguments = [f"--{t}={raw}/{t}" for t in ("events", "customers", "products")]
    main([*arguments, f"--out={out}"])

    def csv(name):
        return rows(spark.read.option("header", True).csv(f"{out}/{name}"))

    assert spark.read.parquet(f"{out}/mart").count() == 4
    # The four reports on revenue read the cells, not the mart.
    cells = spark.read.parquet(f"{out}/revenue_cells")
    listed = reports(spark.read.parquet(f"{out}/mart"), customers_clean(make_customers(dict())), products, cells)
    for name in ("revenue_monthly", "revenue_vs_year_ago", "revenue_by_country", "repeater_revenue_share"):
        assert f"{out}/mart" not in {f.split("/year=")[0].removeprefix("file:").removeprefix("//") for f in listed[name]().inputFiles()}
        assert listed[name]().count() == len(csv(f"reports/{name}"))
    assert csv("product_pairs") == [("P1", "Plan", "P2", "X Add-on", "1")]
    share = csv("reports/repeater_revenue_share")
    assert share == [("2024-01-01", "30.0", "20.0", "66.67"), ("2025-01-01", "2.5", "2.5", "100.0")]
    assert csv("reports/revenue_per_customer_by_billing") == [("Annual", "2.5", "1", "2.5")]
    assert csv("reports/order_invoice_counts")[1] == ("orders_not_proceed", "0")
    many = {"orders_proceed": 0, "orders_not_proceed": 0, "invoices_not_orders": 4, "events_baskets": 4, "events_baskets_min2": 2}
    assert {name: spark.read.parquet(f"{out}/{name}").count() for name in many} == many
    assert {
        "blank_profile", "dimension_keys", "duplicate_event_ids", "foreign_font_values",
        "invoice_counts_repeat", "invoices_before_signup", "second_purchase_gap",
    } <= set(os.listdir(f"{out}/reports"))
    assert csv("reports/duplicate_event_ids") == []
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        main([*arguments, f"--out={out}"])
    main([*arguments, f"--out={out}", "--mode=overwrite"])


@pytest.mark.parametrize("grain,names", [("year", {"2024", "2025"}), ("quarter", {"2024-Q1", "2024-Q4", "2025-Q1"}), ("month", {"2024-01", "2024-12", "2025-01"})])
def test_chunks_split_by_period_and_prune(make_events, rows, spark, tmp_path, grain, names):
    events = make_events(dict(), dict(event_date="2024-12-31"), dict(event_date="2025-01-01"))
    path = str(tmp_path / "chunks")
    sinks.export_chunks(events, path, grain=grain, format="parquet")
    assert {d.split("=")[1] for d in os.listdir(path) if "=" in d} == names
    back = spark.read.parquet(path)
    assert rows(back, *events.columns) == rows(events)
    if grain == "year":
        first = spark.read.parquet(f"{path}/chunk_year=2024").toPandas()["event_date"]
        assert list(first) == sorted(first)
        pruned = back.where("chunk_year = 2025")
        assert "PartitionFilters: [isnotnull(chunk_year" in pruned._jdf.queryExecution().toString()
        assert pruned.count() == 1


def test_pairs_are_written_most_frequent_first(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a", 2, "b", 3), (1, "a", 3, "c", 9)], "product_a_id int, product_a_name string, product_b_id int, product_b_name string, pair_count int")
    sinks.export_product_pairs(pairs, str(tmp_path / "pairs"))
    lines = []
    for part in sorted(p for p in os.listdir(tmp_path / "pairs") if p.startswith("part-")):
        lines += [line for line in (tmp_path / "pairs" / part).read_text().splitlines() if not line.startswith("product_")]
    assert lines == ["1,a,3,c,9", "1,a,2,b,3"]


def test_views_answer_sql_and_the_written_mart_too(spark, sf_dir, rows, tmp_path):
    raw = (testdata.events_raw(spark, sf_dir), testdata.customers_raw(spark, sf_dir), testdata.products_raw(spark, sf_dir))
    built = views.register_views(*raw)
    report = """SELECT date_trunc('month', event_date)::date AS m, count(DISTINCT CASE WHEN is_repeater THEN customer_id END) AS n
                FROM combined GROUP BY date_trunc('month', event_date)::date"""
    lazy = rows(spark.sql(report))
    path = str(tmp_path / "mart")
    views.write_mart(built["combined"], path)
    views.register_views(*raw, mart_path=path)
    assert "combined" in {t.name for t in spark.catalog.listTables()}
    assert "Join" not in spark.table("combined")._jdf.queryExecution().optimizedPlan().toString()
    assert rows(spark.sql(report)) == lazy
    assert spark.table("combined").columns == built["combined"].columns
    assert spark.sql("SELECT * FROM product_pairs").columns[-1] == "pair_count"


# --- rejects ---------------------------------------------------------------------------------


def _lines(path, spark):
    return sorted(r.value for r in spark.read.text(path).collect())


def test_bad_lines_are_set_aside(spark, make_events, rows, tmp_path):
    """Every line is read or rejected, once, with the first reason that applies."""
    path = tmp_path / "events"
    good = make_events(dict(), dict(region=None, net_revenue_usd=None), dict(country='a "quoted", one'))
    good.coalesce(1).write.option("header", True).csv(str(path))
    plain = make_events(dict()).columns
    fit = dict(zip(plain, ["E9", "C1", "P1", "2024-01-01", "invoice", "1", "1.5", "2.5", "true", "N/A", "Web", "EU", "Germany"], strict=True))

    def line(**changed):
        return ",".join({**fit, **changed}.values())

    wrong = {
        line(event_date="2024-13-01"): "event_date",
        line(quantity="many"): "quantity",
        line(quantity="1.5"): "quantity",
        line(unit_price_local="1,5"): "columns",
        line(is_refunded="perhaps"): "is_refunded",
        line(event_date="x", quantity="y"): "event_date",
        "E1,C1": "columns",
    }
    (path / "part-more.csv").write_text("\n".join([",".join(plain), line(), *wrong]) + "\n")
    read, rejects = tables.read_with_rejects(spark, str(path))
    assert read.schema.simpleString() == good.schema.simpleString()
    assert len(rows(read)) == 4 and set(rows(good)) <= set(rows(read))
    assert {r.line: r.reason for r in rejects.collect()} == wrong
    assert all(r.path.endswith("part-more.csv") for r in rejects.collect())
    assert [(r.reason, r.lines) for r in tables.rejects_by_reason(rejects).collect()] == [
        ("columns", 2), ("event_date", 2), ("quantity", 2), ("is_refunded", 1),
    ]
    assert read.count() == 4 and rejects.count() == len(wrong)  # also where no column is asked for


def test_a_table_without_bad_lines(spark, make_products, rows, tmp_path):
    path = str(tmp_path / "products")
    df = make_products(dict(), dict(product_name="X Add–on"))
    df.write.option("header", True).csv(path)
    read, rejects = tables.read_with_rejects(spark, path, tables.PRODUCTS)
    assert rows(read) == rows(df) and rejects.collect() == []


def test_another_table_is_still_an_error(spark, make_events, tmp_path):
    path = str(tmp_path / "swapped")
    make_events(dict()).select("customer_id", "event_id").write.option("header", True).csv(path)
    with pytest.raises(Exception):
        tables.read_with_rejects(spark, path)[0].collect()


def test_job_goes_on_without_bad_lines(make_events, make_customers, make_products, spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    imported = make_customers(dict(), dict(customer_id="C2")).withColumnsRenamed({"region_customers": "region", "country_customers": "country"})
    for name, df in {"events": make_events(dict(), dict()), "customers": imported, "products": make_products(dict())}.items():
        df.coalesce(1).write.option("header", True).csv(str(raw / name))
    for name, extra in {"events": "short,line", "customers": ",".join(["C3", "no date"] + [""] * (len(imported.columns) - 2))}.items():
        part = next((raw / name).glob("*.csv"))
        (raw / name / "part-bad.csv").write_text(part.read_text().splitlines()[0] + "\n" + extra + "\n")
    arguments = [f"--{t}={raw}/{t}" for t in ("events", "customers", "products")]
    main([*arguments, f"--out={out}", "--format=csv", "--keep-rejects"])
    found = {t: [r.reason for r in spark.read.parquet(f"{out}/rejects/{t}").collect()] for t in ("events", "customers", "products")}
    assert found == {"events": ["columns"], "customers": ["signup_date"], "products": []}
    assert spark.read.parquet(f"{out}/mart").count() == 2 and spark.read.parquet(f"{out}/customers_final").count() == 2
    with pytest.raises(SystemExit):
        main([*arguments, f"--out={out}2", "--keep-rejects"])


# --- refreshed chunks ------------------------------------------------------------------------


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.csv")}


@pytest.mark.parametrize("grain, changed", [("year", 2024), ("month", "2024-05")])
def test_one_period_is_written_alone(make_events, spark, rows, tmp_path, grain, changed):
    path = tmp_path / "chunks"
    before = make_events(*[dict(event_date=f"{y}-{m}-01", net_revenue_usd=0.1) for y in (2023, 2024, 2025) for m in ("01", "05")])
    sinks.export_chunks(before, str(path), grain=grain)
    old = _files(path)
    after = before.unionByName(make_events(dict(event_id="new", event_date="2024-05-09", net_revenue_usd=0.2)))
    manifest = sinks.refresh_chunks(after, str(path), [changed], sums=["net_revenue_usd"], grain=grain)
    new = _files(path)
    touched = f"chunk_{grain}={changed}"
    assert {f: t for f, t in new.items() if touched not in f} == {f: t for f, t in old.items() if touched not in f}
    assert not {f for f in old if touched in f} & {f for f in new if touched in f}
    written = spark.read.schema(after.schema).option("header", True).csv(str(path))
    assert rows(written, *after.columns) == rows(after)
    n = 3 if grain == "year" else 2
    assert rows(manifest) == [(str(changed), n, 100_000 * n + 100_000)]
    assert sinks.check_chunks(written, manifest, ["net_revenue_usd"], grain=grain).collect() == []
    broken = written.where("event_id <> 'new'")
    found = sinks.check_chunks(broken, manifest, ["net_revenue_usd"], grain=grain).collect()
    assert [(r.expected_row_count, r.found_row_count) for r in found] == [(n, n - 1)]
    gone = sinks.check_chunks(written.where("year(event_date) <> 2024"), manifest, ["net_revenue_usd"], grain=grain)
    assert [r.found_row_count for r in gone.collect()] == [None]


def test_manifest_of_rows_without_a_date(make_events, rows):
    events = make_events(dict(), dict(event_date=None), dict(event_date=None))
    assert rows(sinks.chunk_manifest(events)) == [("2024", 1), (None, 2)]
    assert rows(sinks.chunk_manifest(events.limit(0))) == []
