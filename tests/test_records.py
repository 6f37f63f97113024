"""Grounding, profiles, insights, coverage and snapshots."""

import tempfile

from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.functions import records, urls
from gleanery.operators import coverage, gate, grounding, insights, profiles
from gleanery.sources import extraction, snapshots
from tests.fixtures import at, item, items

POLICY = urls.TrustPolicy()
def clock():
    return F.lit("2026-09-12 00:00:00").cast("timestamp")


EXTRACTED = (
    "batch_id string, record_no int, title string, summary string, implication string, category string, topic string, "
    "importance string, company string, event_key string, confidence double, citations array<struct<document:int,quote:string>>"
)


def documents(spark, *rows):
    full = [("b", n, r["url"], r.get("title", "t"), r["text"], at(r.get("published")), "s", r.get("profile"), r.get("focus"), "html", n) for n, r in enumerate(rows)]
    return spark.createDataFrame(full, schemas.DOCUMENT)


def claim(n, title, summary, quotes, company="测试公司", confidence=0.8):
    return ("b", n, title, summary, "研究判断", "解决方案", "工业智能", "high", company, f"key-{n}", confidence, quotes)


def test_invented_quotes_are_dropped_and_dates_come_from_the_page(spark):
    extracted = spark.createDataFrame([
        claim(0, "工业智能体发布新产品", "发布可核验的工业智能体平台产品。", [(0, "正式发布工业智能体平台产品与技术能力")]),
        claim(1, "伪造证据不得发布", "发布可核验的工业智能体平台产品。", [(0, "模型自己编造的不存在于原文的句子")]),
    ], EXTRACTED)
    pages = documents(spark, {"url": "https://example.com/real", "text": "公司正式 发布工业智能体平台产品与技术能力。", "published": "2026-09-01T00:00:00"})
    rows = grounding.ground_items(extracted, pages, POLICY, F.lit("test"), clock()).collect()
    assert len(rows) == 1
    assert rows[0]["evidence"][0]["url"] == "https://example.com/real"
    assert rows[0]["published_at"].isoformat().startswith("2026-09-01")
    assert rows[0]["event_key"].startswith("evt-") and len(rows[0]["event_key"]) == 28


def test_numbers_are_supported_from_the_whole_cited_page(spark):
    quote = "西门子正式发布面向制造现场的工业智能平台。"
    extracted = spark.createDataFrame([
        claim(0, "西门子发布工业智能平台并落地25项能力", "西门子正式发布工业智能平台，首批包含25项面向制造现场的能力。", [(0, quote)], "西门子", 0.9)], EXTRACTED)
    pages = documents(spark, {"url": "https://www.siemens.com/news/platform", "text": quote + " 官方披露首批产品包含 25 项面向工业设备与生产线的可验证能力。", "published": "2026-09-10T00:00:00"})
    grounded = grounding.ground_items(extracted, pages, POLICY, F.lit("t"), clock()).withColumn("arrival", F.lit(0).cast("bigint"))
    row = grounded.first()
    assert any("25 项" in e["quote"] for e in row["evidence"])
    assert gate.assess(grounded, POLICY, ["西门子"]).first()["reasons"] == []


def test_profile_pages_support_profiles_never_events(spark):
    quote = "能科科技提供工业软件及数字孪生产品技术服务"
    pages = documents(spark, {"url": "https://www.nancal.com/", "text": quote + "，注册资本已披露", "profile": "能科科技"})
    events = spark.createDataFrame([claim(0, "能科科技提供工业软件", "能科科技提供工业软件及产品。", [(0, quote)])], EXTRACTED)
    assert grounding.ground_items(events, pages, POLICY, F.lit("t"), clock()).count() == 0
    schema = ("batch_id string, record_no int, name string, narrative string, positioning string, solutions array<string>, "
              "capabilities array<string>, funding string, implication string, citations array<struct<document:int,quote:string>>")
    base = ["企业叙事", "市场定位", ["工业软件"], ["数字孪生"], "注册资本 已披露", "判断", [(0, quote)]]
    offered = spark.createDataFrame([
        ("b", 0, "能科科技", *base), ("b", 1, "其他公司", *base), ("b", 2, "能科科技", *base[:2], [" "], *base[3:]),
        ("b", 3, "Nancal", *base[:4], "编造的融资", *base[5:]),
    ], schema)
    rows = {r["record_no"]: r for r in grounding.ground_profiles(offered, pages, POLICY, clock()).collect()}
    assert set(rows) == {0, 3}
    assert rows[0]["funding"] == "注册资本 已披露" and rows[3]["funding"] == "未披露" and rows[0]["basis"] == "official"


def profile(name="测试公司", **changes):
    row = {"id": "p", "name": name, "narrative": "企业叙事", "positioning": "市场定位", "solutions": [], "capabilities": [], "funding": "未披露",
           "implication": "研究判断", "evidence": [], "updated_at": at("2026-09-08T10:00:00"), "basis": None, "arrival": 0, **changes}
    return tuple(row.values())


def table(spark, *rows):
    return spark.createDataFrame(rows, schemas.PROFILE)


CITED = [{"url": "https://www.nancal.com/", "title": "官网", "quote": "企业官网披露的产品与技术能力说明"}]


def test_profile_updates_refine_and_never_erase(spark):
    old = table(spark, profile(funding="已披露融资", capabilities=["能力A"]))
    row = profiles.merge_profiles(old, table(spark, profile(capabilities=["能力B", "能力A"], narrative="")), POLICY).first()
    assert (row["funding"], row["capabilities"], row["narrative"]) == ("已披露融资", ["能力A", "能力B"], "企业叙事")
    official = table(spark, profile("能科科技", basis="official", evidence=CITED, solutions=["x"]))
    worse = table(spark, profile("Nancal", narrative="占位"))
    assert profiles.merge_profiles(official, worse, POLICY).first()["narrative"] == "企业叙事"
    better = table(spark, profile("能科科技", basis="official", evidence=CITED, solutions=["y"]))
    promoted = profiles.merge_profiles(table(spark, profile("能科科技", solutions=["x"])), better, POLICY).first()
    assert promoted["solutions"] == ["y"] and promoted["basis"] == "official"


def test_dashboard_lists_configured_companies_first_with_placeholders(spark):
    held = table(spark, profile("Nancal", evidence=CITED, arrival=5), profile("其他", evidence=CITED, arrival=1), profile("空", arrival=2))
    companies = spark.createDataFrame([("西门子", 0), ("能科科技", 1)], "name string, ordinal int")
    rows = profiles.dashboard_profiles(companies, held, POLICY, clock()).collect()
    assert [(r["name"], r["placeholder"]) for r in rows] == [("西门子", True), ("Nancal", False), ("其他", False)]


def test_refresh_targets(spark):
    good = dict(basis="official", solutions=["a"], capabilities=["b"], evidence=CITED)
    companies = spark.createDataFrame([("能科科技", 0), ("西门子", 1)], "name string, ordinal int")
    targets = lambda p: {r["name"] for r in profiles.refresh_targets(companies, table(spark, p), clock(), False).collect()}
    assert targets(profile("能科科技", **good)) == {"西门子"}
    assert targets(profile("能科科技", **{**good, "updated_at": at("2026-09-05T00:00:00")})) == {"能科科技", "西门子"}
    assert targets(profile("能科科技", **{**good, "basis": None})) == {"能科科技", "西门子"}


def report(ids, overview="当前研究样本提示需要同时评估工业软件能力和客户场景中的实际交付路径。"):
    text = "两家企业的案例提示，产品竞争需要同时关注软件能力与现场交付能力。"
    return ("run", at("2026-09-10T00:00:00"), None, overview, [("交付能力成为竞争部分", text, text, text, text, ids)])


def test_insights_need_two_events_two_pages_and_expire(spark):
    quote = "已核验的企业原始披露内容"
    events = items(spark, *[item(event_key=f"e{i}", evidence=[(f"https://example.com/{i}", "原文", quote)]) for i in range(2)])
    rules = lambda *ids: {r["rule"] for r in insights.violations(spark.createDataFrame([report(list(ids))], schemas.INSIGHT), events).collect()}
    assert rules("e0", "e1") == set()
    assert rules("e0", "none") == {"events", "pages"}
    assert rules("e0", "e0") == {"events", "pages"}
    single = items(spark, *[item(event_key=f"e{i}", evidence=[("https://example.com/0", "原文", quote)]) for i in range(2)])
    same = insights.violations(spark.createDataFrame([report(["e0", "e1"])], schemas.INSIGHT), single)
    assert {r["rule"] for r in same.collect()} == {"pages"}
    valid = insights.valid_reports(spark.createDataFrame([report(["e0", "e1"])], schemas.INSIGHT), events)
    assert insights.current_reports(valid, events.orderBy(F.desc("id"))).count() == 1
    assert insights.current_reports(valid, events.where("id = 'e0'")).count() == 0
    changed = events.withColumn("summary", F.when(F.col("id") == "e0", F.lit("修正后的事实")).otherwise(F.col("summary")))
    assert insights.current_reports(valid, changed).count() == 0


def test_mentions_of_many_terms_equal_containment(spark):
    docs = [(i, f"文档{i}说明平台{i % 7}号产品与能力{i % 5}级") for i in range(60)] + [(90, ""), (91, None), (92, "term 77 and term 7")]
    terms = [(i, f"平台{i}号产品与能力") for i in range(9)] + [(20, "能力3"), (21, "文档5"), (22, "能力3"), (23, ""), (24, None)] + [(100 + i, f"term {i}") for i in range(100_000)]
    df, listed = spark.createDataFrame(docs, "url int, text_key string"), spark.createDataFrame(terms, "term_id int, term_key string")
    seen = [t for t in terms if t[0] < 100 or t[1] in ("term 7", "term 77")]
    expected = sorted((u, n) for u, text in docs if text is not None for n, term in seen if term is not None and term in text)
    for block in (coverage.BLOCK, 200_000):
        got = coverage.mentions(df, listed, block=block)
        assert got.columns == ["url", "term_id"] and sorted(map(tuple, got.collect())) == expected
    assert coverage.mentions(df, listed.limit(0)).count() == 0


def test_company_coverage_keeps_zero_counts(spark):
    docs = documents(
        spark, {"url": "u1", "text": "Siemens 发布平台"}, {"url": "u2", "text": "无关", "focus": "西门子"},
        {"url": "u3", "text": "西门子官网", "profile": "西门子"})
    companies = spark.createDataFrame([("西门子", 0), ("达索系统", 1)], "name string, ordinal int")
    counts = coverage.company_documents(companies, docs)
    assert {r["name"]: r["documents"] for r in counts.collect()} == {"西门子": 2, "达索系统": 0}
    assert [r["name"] for r in coverage.company_gaps(counts).collect()] == ["达索系统"]


def test_snapshots_switch_at_once_and_reads_change_nothing(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    assert snapshots.read_snapshot(spark, root, "items").count() == 0
    first, second = items(spark, item(event_key="a", published_at="2020-01-01T00:00:00")), items(spark, item(event_key="b"), item(event_key="c"))
    snapshots.publish({"items": first}, root, "run-1", clock())
    assert snapshots.read_snapshot(spark, root, "items").count() == 1
    assert snapshots.read_snapshot(spark, root, "items").count() == 1
    snapshots.publish({"items": second}, root, "run-2", clock())
    snapshots.publish({"items": second}, root, "run-2", clock())
    assert {r["id"] for r in snapshots.read_snapshot(spark, root, "items").collect()} == {"b", "c"}
    assert [r["run_id"] for r in snapshots.archives(spark, root).collect()] == ["run-1"]
    snapshots.append_log(spark, root, spark.createDataFrame([("run-2", at("2026-09-12T00:00:00"), "n", "m", "ok")], schemas.RUN_EVENT))
    assert snapshots.read_log(spark, root).count() == 1


def test_window_edges(spark):
    now = F.lit("2026-09-08 11:00:00").cast("timestamp")
    dates = ["2026-08-09 11:00:00", "2026-08-09 10:59:59", "2026-09-09 11:00:00", None]
    df = spark.createDataFrame([(d,) for d in dates], "d string").withColumn("d", F.col("d").cast("timestamp"))
    assert [r[0] for r in df.select(records.in_window("d", now)).collect()] == [True, False, False, None]


def test_alias_payload_maps_to_the_strict_record(spark):
    body = """{"intelligence": [{"headline": "测试公司推出工业智能平台", "core_fact": "测试公司正式发布工业智能平台，并披露面向制造现场的应用能力。",
      "type": "产品", "direction": "工业AI", "priority": "重大", "enterprise": "测试公司", "event_key": "test-launch", "certainty": "90%",
      "citations": [{"document_index": 0, "excerpt": "正式发布工业智能平台，并披露面向制造现场的应用能力"}]},
      {"headline": "没有引用的条目", "core_fact": "这条内容不会被发布，因为没有可核验证据。"}],
      "company_profiles": [{"company": "测试公司", "story": "以工业智能平台连接制造现场。", "position": "提供商", "product_solutions": "工业智能平台、现场应用",
      "abilities": ["制造数据分析"], "citations": [{"document_index": 0, "excerpt": "正式发布工业智能平台，并披露面向制造现场的应用能力"}]}]}"""
    normal = extraction.normalise_extraction(spark.createDataFrame([("b", body)], "batch_id string, body string"))
    row = extraction.extracted_items(normal).first()
    assert (row["category"], row["topic"], row["importance"], row["confidence"]) == ("产品发布", "工业智能", "critical", 0.9)
    assert normal.first()["offered_items"] == 2 and extraction.extracted_items(normal).count() == 1
    p = extraction.extracted_profiles(normal).first()
    assert p["solutions"] == ["工业智能平台", "现场应用"] and p["funding"] == "未披露"
