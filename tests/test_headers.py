import difflib

from pyspark.sql import functions as F

from merchantry.operators import headers as h
from merchantry.sources import raw_exports

FILES = {
    "plain.csv": ["Order ID", "Email", "Created at", "Total", "Lineitem name"],
    "odd.csv": ["Ordr Number", "E-mail Addres", "Dat", "Totl Price", "Product Titel", "zzz", "Order Numbr"],
    "repeat.csv": ["Email", "Customer Email", "email", " Total "],
    "custom.csv": ["Ref", "order_qty", "Gross", "Order ID", "item_price", "Price", "order_price"],
}


def catalogue(spark):
    rows = [("t", "u", f, i, x) for f, names in FILES.items() for i, x in enumerate(names)]
    return spark.createDataFrame(rows, "tenant_id string, upload_id string, source_file string, position int, header string")


def expected_analysis(names):
    """The rule by brute force over all headers and all names of each field."""
    out = {}
    lower = {n.lower().strip(): n for n in names}
    for field, listed in h.CRITICAL.items():
        exact = next((lower[v] for v in listed if v in lower), None)
        if exact is not None:
            out[field] = (exact, "high", [])
            continue
        scored = [(n, max(difflib.SequenceMatcher(None, v, n.lower()).ratio() for v in listed)) for n in names]
        kept = sorted([s for s in scored if s[1] >= 0.60], key=lambda s: -s[1])[:3]
        level = "missing" if not kept else "medium" if kept[0][1] >= 0.75 else "low"
        out[field] = (None, level, [k[0] for k in kept])
    return out


def test_critical_fields_match_brute_force(spark):
    got = {}
    analysis = h.critical_fields(catalogue(spark))
    for r in analysis.collect():
        got.setdefault(r.source_file, {})[r.field] = (r.matched_header, r.confidence, list(r.suggestions))
    for name, names in FILES.items():
        assert got[name] == expected_analysis(names), name
    needs = {r.source_file: r.needs_mapping for r in h.needs_mapping(analysis).collect()}
    assert needs["plain.csv"] is False and needs["odd.csv"] is True


def test_exact_match_and_unique_names(spark):
    got = {(r.source_file, r.position): r for r in h.match_exact(catalogue(spark)).collect()}
    assert got[("repeat.csv", 0)].canonical == "customer_email"
    assert got[("repeat.csv", 1)].canonical is None and got[("repeat.csv", 1)].column_name == "customer email"
    names = {(r.source_file, r.position): r.unique_name for r in h.standard_names(catalogue(spark)).collect()}
    assert [names[("repeat.csv", i)] for i in range(4)] == ["customer_email", "customer_email_1", "customer_email_2", "total"]


def test_user_mapping_comes_first(spark):
    user = spark.createDataFrame(
        [("t", "u", "custom.csv", "Ref", "order_id"), ("t", "u", "custom.csv", "Gross", "total")],
        "tenant_id string, upload_id string, source_file string, header string, canonical string",
    )
    resolved = h.resolve_mapping(catalogue(spark), user).where("source_file = 'custom.csv'").orderBy("position").collect()
    assert [(r.unique_name, r.mapped_by) for r in resolved] == [
        ("order_id", "user"), ("quantity", "rename"), ("total", "user"), ("order_id_1", "synonym"),
        ("unit_price", "rename"), ("unit_price_1", "synonym"), ("order_price", "none"),
    ]


def test_required_columns_over_a_set_of_files(spark):
    per_file = h.required_columns(catalogue(spark))
    missing = {r.source_file: r.missing_columns for r in per_file.collect()}
    assert missing["plain.csv"] == ["quantity", "unit_price"]
    valid = h.upload_valid(per_file).collect()[0]
    assert (valid.is_valid, valid.missing_columns) == (False, ["quantity"])


def test_features(spark):
    uploads = spark.createDataFrame([("t", ["order_id", "customer_email", "order_date", "total"])], "tenant_id string, columns array<string>")
    features = h.feature_availability(uploads, ["tenant_id"])
    assert {r.feature for r in features.where("available").collect()} == {
        "repeat-behavior", "clv-analysis", "churn-prediction", "advanced-forecasting", "ai-insights",
    }
    summary = h.feature_summary(features, ["tenant_id"]).collect()[0]
    assert (summary.total_available, summary.starter_available, summary.pro_available) == (5, 1, 4)


def test_synonym_dictionary_is_unambiguous_where_it_matters():
    assert len(h.REQUIRED) == 6 and len(h.OPTIONAL) == 17


def test_few_names_are_compared_in_full(monkeypatch):
    """The same best ratios as comparing with every name, by fewer comparisons."""
    import difflib

    from merchantry.operators import headers as h

    texts = ["order id", "orderid", "Totl Price".lower(), "zzz", "", "created", "customer e-mail", "lineitem nam", "x" * 40]
    calls = []
    whole = difflib.SequenceMatcher.ratio
    for names in h.CRITICAL.values():
        for text in texts:
            wanted = max(difflib.SequenceMatcher(None, name, text).ratio() for name in names)
            with monkeypatch.context() as patch:
                patch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or whole(self))
                assert h.best_ratio(text, names) == (wanted if wanted >= h.SUGGEST_FROM else 0.0)
    assert len(calls) < len(texts) * sum(map(len, h.CRITICAL.values())) / 4


def test_files_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """A customer table in one small file is read by one task; its files' headers must not all be held there."""
    rows = [(i, f"s{i % 3}") for i in range(2000)] * 2 + [(None, None)]
    spark.createDataFrame(rows, "c_custkey bigint, c_mktsegment string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(raw_exports, "FILES_PER_TASK", 100)
    headers = raw_exports.file_headers(spark, str(tmp_path))
    per_task = headers.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per_task) > 30 and max(r["count"] for r in per_task) < 4000
    assert headers.count() == len(rows) * len(raw_exports.HEADER_CHOICES)


def test_files_do_not_meet_on_a_header_text(spark):
    """Similarities are joined where the headers are: nothing is shuffled by header text, which most files share."""
    plan = h.critical_fields(catalogue(spark))._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_text" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
