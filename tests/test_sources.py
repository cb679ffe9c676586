import csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from merchantry.operators import cleaning
from merchantry.operators.exports import write_csv
from merchantry.plans import store_queries
from merchantry.session import store
from merchantry.sources import files, snapshots
from merchantry.streaming import orders as streams


def test_positions_in_files_read_in_many_blocks(spark, tmp_path):
    for name, n in (("a.csv", 5000), ("b.csv", 300)):
        lines = ["id,text"] + [f"{name}-{i},value {i} of the file" for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scanned = files.read_exports(spark, str(tmp_path))
        assert scanned.rdd.getNumPartitions() > 4
        rows = files.numbered_exports(spark, str(tmp_path)).cache()
        wrong = rows.where(F.split("id", "-")[1].cast("bigint") != F.col("row_pos")).count()
        assert rows.count() == 5300 and wrong == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_encodings_and_byte_order_mark(spark, tmp_path):
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin" / "x.csv").write_bytes("Order ID,Café\n1,£5\n".encode("latin-1"))
    got = files.read_exports(spark, str(tmp_path / "latin"), encoding=None)
    assert got.columns[:2] == ["Order ID", "Café"] and got.first()["Café"] == "£5"
    (tmp_path / "bom").mkdir()
    (tmp_path / "bom" / "x.csv").write_bytes("Order ID,Total\n1,£5\n".encode("utf-8-sig"))
    assert files.read_exports(spark, str(tmp_path / "bom")).columns[0] == "Order ID"


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,text\n1,"two\nlines"\n2,"say ""hi"""\n')
    got = files.read_exports(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.text for r in got] == ["two\nlines", 'say "hi"']


def test_enrichment_needs_an_order_file(spark):
    with pytest.raises(ValueError, match="order_id"):
        files.enrich_files([spark.createDataFrame([(1,)], "x int")])


def test_snapshot_replaces_only_the_saved_export(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = spark.createDataFrame([("t", "2001", 1), ("t", "2002", 2), ("u", "2001", 3)], "tenant_id string, upload_id string, x int")
    snapshots.save_snapshot(rows, path)
    snapshots.save_snapshot(spark.createDataFrame([("t", "2002", 9)], rows.schema), path)
    loaded = snapshots.load_snapshot(spark, path)
    assert sorted((r.tenant_id, r.upload_id, r.x) for r in loaded.collect()) == [("t", "2001", 1), ("t", "2002", 9), ("u", "2001", 3)]
    one = snapshots.load_snapshot(spark, path, tenant="t", upload="2001")
    assert [r.x for r in one.collect()] == [1]
    assert "PartitionFilters: [isnotnull(tenant_id" in one._jdf.queryExecution().executedPlan().toString()


def test_active_export_wins_else_newest(spark):
    uploads = spark.createDataFrame(
        [("t", "1", "2024-01-01"), ("t", "2", "2024-02-01"), ("u", "1", "2024-01-01"), ("u", "2", "2024-03-01")],
        "tenant_id string, upload_id string, generated_at string",
    )
    active = spark.createDataFrame([("t", "1"), ("u", "missing")], "tenant_id string, upload_id string")
    got = {r.tenant_id: (r.upload_id, r.is_active) for r in snapshots.current_uploads(uploads, active).collect()}
    assert got == {"t": ("1", True), "u": ("2", False)}
    assert {r.upload_id for r in snapshots.current_uploads(uploads).collect()} == {"2"}


def test_files_with_other_headers(spark, tmp_path):
    """Each file is read by its own header: other order, other columns, repeated names, odd file names."""
    (tmp_path / "a b.csv").write_text("Order ID,Email,Total\n1,a@x.com,10\n2,b@x.com,20\n")
    (tmp_path / "b+%.csv").write_text('\ufeffTotal,Order ID,Email\n30,3,"c@x.com"\n')
    (tmp_path / "c.csv").write_text('order id,"Note, long",Total,TOTAL\n4,"x ""y"", z",40,41\n')
    (tmp_path / "d.csv").write_text("Order ID,Email,Total\n")
    rows = files.read_exports(spark, str(tmp_path))
    got = sorted((r["Order ID"], r["Email"], r["Total"], r["Note, long"], r["TOTAL_1"]) for r in rows.collect())
    assert got == [
        ("1", "a@x.com", "10", None, None), ("2", "b@x.com", "20", None, None), ("3", "c@x.com", "30", None, None),
        ("4", None, "40", 'x "y", z', "41"),
    ]
    found = files.file_headers(spark, str(tmp_path)).groupBy("source_file").count().collect()
    assert sorted(r["count"] for r in found) == [3, 3, 3, 4]
    (tmp_path / "none").mkdir()
    assert files.read_exports(spark, str(tmp_path / "none")).count() == 0


def test_mapping_is_applied_per_file(spark):
    rows = spark.createDataFrame(
        [("f1", 0, ["1", "x", None]), ("f1", 1, ["2", None, None]), ("f2", 0, ["9", None, "77"]), ("f3", 0, ["1", "y", "z"])],
        "source_file string, row_pos long, fields array<string>",
    )
    names = spark.createDataFrame(
        [("t", "u", "f1", 0, "order_id"), ("t", "u", "f1", 1, "customer_email"), ("t", "v", "f2", 0, "total"),
         ("t", "v", "f2", 2, "order_id")], "tenant_id string, upload_id string, source_file string, position int, unique_name string")
    got = sorted(tuple(r) for r in files.apply_mapping(rows, names).select(
        "tenant_id", "upload_id", "source_file", "row_pos", "order_id", F.coalesce("customer_email", F.lit("-")), F.coalesce("total", F.lit("-"))).collect())
    assert got == [("t", "u", "f1", 0, "1", "x", "-"), ("t", "u", "f1", 1, "2", "-", "-"), ("t", "v", "f2", 0, "77", "-", "9")]
    assert files.apply_mapping(rows, names, ["total"]).columns == ["tenant_id", "upload_id", "source_file", "row_pos", "total"]


def test_places_of_few_files_are_sent_to_the_rows(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 0, ["1", "x"]), ("b", 0, ["y", "2"]), ("b", 1, [None, "3"]), ("c", 0, ["4", "z"])], "source_file string, row_pos long, fields array<string>")
    names = spark.createDataFrame([
        ("t", "u", "a", 0, "total"), ("t", "u", "a", 1, "note"), ("t", "u", "b", 1, "total"), ("v", "w", "b", 0, "total"), ("t", "u", None, 0, "total"),
    ], "tenant_id string, upload_id string, source_file string, position int, unique_name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # whatever the optimizer guesses
    try:
        for sent in (files.SENT_PLACES, 0):
            monkeypatch.setattr(files, "SENT_PLACES", sent)
            mapped = files.apply_mapping(rows, names, ["total"])
            assert ("Exchange hashpartitioning(source_file" in mapped._jdf.queryExecution().executedPlan().toString()) == (sent == 0)
            got = sorted((r.tenant_id, r.source_file, r.row_pos, r.total or "") for r in mapped.collect())
            assert got == [("t", "a", 0, "1"), ("t", "b", 0, "2"), ("t", "b", 1, "3"), ("v", "b", 0, "y"), ("v", "b", 1, "")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("sent", [50_000, 0])
def test_line_breaks_in_quotes_over_many_splits(spark, tmp_path, small_splits, monkeypatch, sent):
    """Equal to Python's row-wise parser, with exact places, for fields that are shorter and longer than a split."""
    rnd = random.Random(8)
    monkeypatch.setattr(files, "SENT_BLOCKS", sent)
    wanted = set()
    for name in ("a.csv", "b.csv", "plain.csv"):
        rows = []
        for i in range(400):
            text = "".join(rnd.choice(["word ", '"', "\n", "\n\n", ",", "\r\n", "é"]) for _ in range(rnd.randrange(8)))
            if i == 200:
                text = "long\n" * 2000  # spans several splits
            rows.append([f"{name}-{i}", text.replace("\n", " ").replace('"', "") if name == "plain.csv" else text, str(i)])
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\r\n" if name == "b.csv" else "\n")
            writer.writerow(["id", "te\nxt" if name == "a.csv" else "te xt", "n"])
            for i, row in enumerate(rows):
                writer.writerow(row)
                if i % 50 == 0:
                    out.write("\n")  # a blank line counts nowhere
        with open(tmp_path / name, newline="", encoding="utf-8") as back:
            parsed = [row for row in csv.reader(back) if row][1:]
        wanted |= {(name, i, tuple(value or None for value in row)) for i, row in enumerate(parsed)}
    scan = files.Exports(spark, str(tmp_path))
    assert scan.blocks.count() > 12 and scan.blocks.where("inside = 1").count() > 3
    found = {(r.source_file.split("/")[-1], r.row_pos, tuple(r.fields)) for r in scan.fields().collect()}
    assert found == wanted
    assert sorted(r.header for r in scan.headers().where("position = 1").collect()) == ["te\nxt", "te xt", "te xt"]


def test_many_layouts_are_one_scan(spark, tmp_path):
    """Thousands of header lines: one scan node, no column or union branch for each."""
    names = [f"h{i}" for i in range(8)]
    rnd = random.Random(2)
    for i in range(400):
        order = rnd.sample(names, 8) + [f"own{i}"]
        (tmp_path / f"{i}.csv").write_text(",".join(order) + "\n" + ",".join(f"{n}-{i}" for n in order) + "\n")
    scan = files.Exports(spark, str(tmp_path))
    mapped = scan.headers().selectExpr("'t' AS tenant_id", "'u' AS upload_id", "source_file", "position", "header AS unique_name")
    rows = files.apply_mapping(scan.fields(), mapped, ["h3", "h5", "own7"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Union" not in plan
    got = rows.collect()
    assert len(got) == 400
    for row in got:
        i = row.source_file.split("/")[-1][:-4]
        assert (row.h3, row.h5, row.own7) == (f"h3-{i}", f"h5-{i}", "own7-7" if i == "7" else None)


def test_encoding_of_each_file(spark, tmp_path, small_splits):
    """One byte that is no UTF-8, far behind in a file, makes the file Latin-1 from its start."""
    body = "".join(f"{i},Größe {i}\n" for i in range(800))
    (tmp_path / "utf.csv").write_bytes(("id,Café\n" + body).encode())
    (tmp_path / "mark.csv").write_bytes(("id,Café\n" + body).encode("utf-8-sig"))
    (tmp_path / "latin.csv").write_bytes(("id,Café\n" + body).encode("latin-1"))
    (tmp_path / "late.csv").write_bytes(("id,Caf\n" + "".join(f"{i},x\n" for i in range(2000))).encode() + b"9,\xe9\n")
    scan = files.Exports(spark, str(tmp_path))
    kinds = {r.source_file.split("/")[-1]: r.encoding for r in scan.encodings().collect()}
    assert kinds == {"utf.csv": "UTF-8", "mark.csv": "UTF-8", "latin.csv": "ISO-8859-1", "late.csv": "ISO-8859-1"}
    rows = scan.rows()
    assert rows.columns[:3] == ["id", "Caf", "Café"]
    texts = rows.where(~F.col("source_file").endswith("late.csv"))
    assert texts.where(F.col("Café") == F.concat(F.lit("Größe "), "id")).count() == 2400 == texts.count()
    assert rows.where(F.col("Caf") == "é").count() == 1


def test_upload_history(spark):
    events = spark.createDataFrame(
        [("t", "1", "2024-01-01", 1, "processing", None), ("t", "1", "2024-01-01", 2, "complete", 48)],
        "tenant_id string, upload_id string, event_time string, step int, status string, row_count int",
    )
    got = snapshots.upload_history(events).first()
    assert (got.status, got.row_count, got.status_changes) == ("complete", 48, 2)


def test_csv_folders(spark, tmp_path):
    rows = spark.createDataFrame([("VIPs", 'a "b", c', ""), ("One-Time Buyers", "d", "x")], "segment string, text string, last string")
    write_csv(rows, str(tmp_path / "out"), ["segment"])
    back = spark.read.schema(rows.schema).options(header=True, escape='"', emptyValue="", nullValue="\\N").csv(str(tmp_path / "out"))
    assert sorted((r.segment, r.text, r.last) for r in back.collect()) == [("One-Time Buyers", "d", "x"), ("VIPs", 'a "b", c', None)]


def test_packed_csv_folders_are_read_back_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_queries, "new_table_path", lambda s, name: f"{tmp_path}/{name}")
    rows = spark.range(3_000).selectExpr(
        "id AS n", "concat('list ', id % 3) AS action_key", "concat('He said \"', id % 50, '\", and went.', repeat(' This customer is overdue.', 5)) AS reason",
    )
    back = store_queries._csv_round_trip(spark, rows, "lists", "action_key")
    key = lambda r: r.n
    assert sorted(back.collect(), key=key) == sorted(rows.collect(), key=key)
    text = sum(len(r.reason) for r in rows.collect())
    files_of = list(tmp_path.glob("lists/action_key=*/part-*"))
    assert len(files_of) == 3 and sum(f.stat().st_size for f in files_of) < text / 4


def test_order_stream_over_arrivals(spark, tmp_path):
    """Old orders are kept, the first row of an id stays, ids already loaded and batches delivered again add nothing."""
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    schema = "tenant_id string, upload_id string, row_pos int, order_id string, customer_email string, order_date string, total string"

    def load(state):
        stream = streams.order_feed(spark, feed, spark.createDataFrame([], schema).schema)
        streams.load_orders(stream, out, str(tmp_path / state), [F.col("row_pos")]).awaitTermination()
        rows = snapshots.load_snapshot(spark, out).collect()
        return sorted((r.tenant_id, r.upload_id, r.order_id, float(r.total), str(r.order_date)[:10]) for r in rows)

    def arrive(rows):
        spark.createDataFrame([(t, u, i, *rest) for i, (t, u, *rest) in enumerate(rows)], schema).write.mode("append").parquet(feed)
        return load("state")

    first = [("t1", "1", "7", 5.0, "2024-06-20"), ("t1", "1", "8", 9.0, "2024-06-01")]
    assert arrive([
        ("t1", "1", "7", "a@x", "20/06/2024", "$5"), ("t1", "1", "7", "a@x", "21/06/2024", "6"), ("t1", "1", "9", "nobody", "20/06/2024", "7"),
        ("t1", "1", "8", "a@x", "01/06/2024", "9"), ("t1", "1", "", "a@x", "01/06/2024", "9"),
    ]) == first
    # Much older orders of other exports and merchants; an id seen in one export is free in another.
    second = [*first, ("t1", "2", "7", 1.0, "2019-01-02"), ("t2", "1", "7", 2.0, "2018-02-03")]
    assert arrive([
        ("t2", "1", "7", "b@x", "2018-02-03", "2"), ("t1", "1", "8", "a@x", "2024-06-02", "99"), ("t1", "2", "7", "a@x", "2019-01-02", "1"),
    ]) == second
    assert arrive([("t1", "1", "7", "a@x", "2024-06-02", "99")]) == second
    assert load("another-state") == second  # the whole feed again
    # A plain save replaces one export of the same snapshot, and the stream goes on from it.
    rows = snapshots.load_snapshot(spark, out, "t1", "1").where("order_id = '8'")
    snapshots.save_snapshot(store(rows, "kept"), out)
    assert load("state") == second[1:]
    assert arrive([("t1", "1", "7", "a@x", "2024-06-02", "3")]) == sorted([*second[1:], ("t1", "1", "7", 3.0, "2024-06-02")])


def test_any_cut_of_an_export_gives_the_dates_of_one_file(spark, tmp_path):
    """Texts that read both ways come first and are read again when a later batch shows the order of day and month."""
    schema = "tenant_id string, upload_id string, row_pos int, order_id string, customer_email string, order_date string, paid_at string, total string"
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        up = str(i % 3)
        day, month = (rnd.randint(13, 28), rnd.randint(1, 12)) if i > 40 and up != "2" else (rnd.randint(1, 12), rnd.randint(1, 12))
        first, second = (day, month) if up == "0" else (month, day)
        rows.append(("t", up, i, str(i), "a@x", f"{first:02}/{second:02}/2024", f"{second:02}/{first:02}/2024", "1"))
    whole = spark.createDataFrame(rows, schema)
    wanted = {r.order_id: (r.order_date, r.paid_at) for r in cleaning.clean_orders(whole, [F.col("row_pos")], snapshots.UPLOAD).collect()}
    for k, cut in enumerate(([60], [20, 45, 60], [42, 43, 44, 60], [50, 60])):
        feed, out = str(tmp_path / f"feed{k}"), str(tmp_path / f"out{k}")
        start = 0
        for end in cut:
            spark.createDataFrame(rows[start:end], schema).write.mode("append").parquet(feed)
            streams.load_orders(streams.order_feed(spark, feed, whole.schema), out, str(tmp_path / f"state{k}"), [F.col("row_pos")]).awaitTermination()
            start = end
        assert {r.order_id: (r.order_date, r.paid_at) for r in snapshots.load_snapshot(spark, out).collect()} == wanted, cut


def test_a_batch_reads_its_own_exports(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    columns = "tenant_id string, upload_id string, order_id string, x int"
    snapshots.append_snapshot(spark.createDataFrame([(f"t{i % 5}", f"{i % 7}", str(i), i) for i in range(200)], columns), path)
    clean = spark.createDataFrame([("t1", "1", "1", 0), ("t1", "1", "new", 0), ("t2", "3", "7", 0), ("t9", "1", "1", 0)], columns)
    fresh = streams.new_orders(clean, path)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line][0]
    assert "tenant_id" in filters and " = t1)" in filters and " = t2)" in filters and "ReadSchema: struct<order_id:string>" in filters
    wanted = sorted([("t1", "1", "new"), ("t2", "3", "7"), ("t9", "1", "1")])
    assert sorted((r.tenant_id, r.upload_id, r.order_id) for r in fresh.collect()) == wanted
    monkeypatch.setattr(snapshots, "NAMED_EXPORTS", 1)
    assert sorted((r.tenant_id, r.upload_id, r.order_id) for r in streams.new_orders(clean, path).collect()) == wanted


def test_revenue_of_late_days(spark, tmp_path):
    """Days that arrive weeks late, in parts, again after a failure: the trend equals the batch, with exact customers."""
    schema = "ts timestamp, user_id bigint, event_type string, value double"
    day = dt.datetime(2024, 1, 1)
    rnd = random.Random(6)
    rows = [(day + dt.timedelta(hours=rnd.randrange(24 * 40)), rnd.choice([1, 2, 3, 4, None]), "purchase" if i % 4 else "click", i / 7) for i in range(300)]
    folder, out, state = (str(tmp_path / n) for n in ("events", "out", "state"))

    def found(days):
        return {r.period: (r.revenue, r.orders, r.customers) for r in days.collect()}

    for start in range(0, 300, 75):
        part = spark.createDataFrame(rows[start:start + 75], schema)
        part.write.mode("append").parquet(folder)
        stream = streams.order_feed(spark, folder, part.schema)
        streams.load_revenue(stream, out, state).awaitTermination()
        assert found(streams.load_trend(spark, out)) == found(streams.daily_revenue(spark.createDataFrame(rows[:start + 75], schema)))
    # A run that stopped before its commit is run again under the same number.
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))
    (tmp_path / "state" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    commits[-1].unlink()
    streams.load_revenue(stream, out, state).awaitTermination()
    assert found(streams.load_trend(spark, out)) == found(streams.daily_revenue(spark.createDataFrame(rows, schema)))
    # A day that no batch touches is not written again.
    stamp = {p.parent.name: p.name for p in (tmp_path / "out" / "days").glob("*/*.parquet")}
    one = spark.createDataFrame([(day, 9, "purchase", 1.0)], schema)
    one.write.mode("append").parquet(folder)
    streams.load_revenue(stream, out, state).awaitTermination()
    changed = {k for k, v in {p.parent.name: p.name for p in (tmp_path / "out" / "days").glob("*/*.parquet")}.items() if stamp.get(k) != v}
    assert changed == {"period=2024-01-01"}
