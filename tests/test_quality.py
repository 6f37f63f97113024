"""Gate, ranking, portfolio and trust."""

import random

import pandas as pd
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.functions.text import identity_key
from gleanery.operators import gate, portfolio, trust
from tests.fixtures import item, items

POLICY = urls.TrustPolicy()
COMPANIES = ["西门子", "达索系统", "NVIDIA", "PTC", "中控技术", "树根互联", "能科科技", "索辰科技", "雪浪数制", "蜂巢互联", "创新奇智"]
RUMOUR = [("https://kurznotiz.test/eintrag/7", "Notiz", "Ein Hersteller soll etwas angekündigt haben, Belege fehlen bisher")]
RULE = "主管部门印发车间网络安全标准，要求新建生产线在两年内完成改造。"
ORDER = "一家注塑设备厂披露收到三十台机器人工作站的订单，装备将交付给汽车工厂。"


def reasons(spark, *rows):
    assessed = gate.assess(items(spark, *rows), POLICY, COMPANIES)
    return [set(r["reasons"]) for r in assessed.orderBy("arrival").collect()]


def test_gate_rejects_off_scope_vague_and_overstated_claims(spark):
    found = reasons(
        spark,
        item(title="康岭药房上线患者用药提醒平台", summary="平台面向门诊患者推送药物提醒。", company="康岭药房", evidence=RUMOUR),
        item(title="北辰铸件公布焊接机器人产品", summary="北辰铸件公布一款用于工厂焊缝检查的机器人产品。", company="北辰铸件", evidence=RUMOUR),
        item(title="视觉系统加速在工厂落地", summary="多家工厂认为自动化系统未来可期。", company="行业", evidence=RUMOUR),
        item(title="河谷泵业与岩滩仪表签署备忘录", summary="双方签署合作备忘录，将在自动化领域互相支持。", company="河谷泵业", evidence=RUMOUR),
        item(title="蓝港实验室的抓取装备已部署到码头", summary="蓝港实验室披露抓取装备已部署并可搬运铸件。", company="蓝港实验室", evidence=[
            ("https://www.nist.gov/programs/gripper", "Gripper notes", "The gripper interface is a research preview; field trials of the equipment have not begun.")]),
    )
    assert all(found)
    assert "out_of_scope" in found[0] and "no_trusted_evidence" in found[1]
    assert "generic_trend" in found[2] and "vague_partnership" in found[3]
    assert "overstated" in found[4]


def test_gate_accepts_supported_claims(spark):
    def cited(url, quote):
        return [(url, "Beleg", quote)]

    found = reasons(
        spark,
        item(title="雪浪数制上线炼钢工艺控制系统", summary="雪浪数制上线用于转炉的工艺控制系统。", company="雪浪数制", evidence=cited("https://www.xuelangyun.com/steel", "雪浪数制上线用于转炉的工艺控制系统")),
        item(title="蜂巢互联签约7亿元风机装备订单", summary="蜂巢互联签约7亿元风机装备订单，客户为海上风场。", company="蜂巢互联", evidence=cited("https://www.honeycombtech.com/wind", "蜂巢互联签约7亿元风机装备订单，交付期为三年")),
        item(title="注塑设备厂收到机器人工作站订单", summary=ORDER, company="一家注塑设备厂", confidence=0.84, evidence=cited("https://www.reuters.com/markets/order-30", ORDER)),
        item(title="车间网络安全标准印发", summary=RULE, company="行业", importance="normal", confidence=0.74, evidence=cited("https://www.miit.gov.cn/rules/2026-17", RULE)),
        item(title="注塑设备厂收到机器人工作站订单", summary=ORDER, company="一家注塑设备厂", confidence=0.84, evidence=cited("https://kurznotiz.test/eintrag/8", ORDER)),
        item(title="西门子推出焊缝检测系统并支持40项工艺", summary="西门子推出焊缝检测系统。", company="西门子", evidence=cited("https://www.siemens.com/weld", "西门子推出用于车身工厂的焊缝检测系统。")),
    )
    assert found[:4] == [set(), set(), set(), set()]
    assert "no_trusted_evidence" in found[4] and found[5] == {"unsupported_number"}


def test_mixed_evidence_keeps_trusted_citations_only(spark):
    told = "西门子推出用于车身工厂的焊缝检测系统，首套设备已交付。"
    places = ["https://kurznotiz.test/eintrag/9", "https://zweitnotiz.test/9", "https://new.siemens.com/weld"]
    row = item(title=told, summary=told, company="西门子", confidence=0.9, evidence=[(url, told, told) for url in places])
    passed = gate.publishable(gate.assess(items(spark, row), POLICY, COMPANIES)).collect()
    assert [e["url"] for e in passed[0]["evidence"]] == places[2:]


def test_major_signals_need_confidence_and_independent_evidence(spark):
    one = [("https://hafen.example/kai", "Hafen", "Der Kran hob am Montag die erste Last")]
    rows = items(
        spark,
        item(event_key="critical", importance="critical", confidence=0.9, evidence=one),
        item(event_key="weak", confidence=0.7, evidence=one),
        item(event_key="copy", confidence=0.95, evidence=one + [("https://hafen.example/kai?utm_medium=mail", "Hafen", "Am Dienstag folgte ein Probelauf")]),
        *[item(event_key=f"official-{i}", confidence=0.9, evidence=[(f"https://www.siemens.com/weld/{i}", "Werk", "西门子官网说明焊缝检测系统的交付情况")]) for i in range(4)],
    )
    scored = portfolio.with_score(rows, POLICY, F.lit("2026-09-09 00:00:00").cast("timestamp"))
    major = {r["id"] for r in scored.where("major").collect()}
    assert major == {"critical", *[f"official-{i}" for i in range(4)]}
    top = portfolio.top_signals(scored).collect()
    assert [r["id"] for r in top] == ["critical", "official-0", "official-1"]
    score = {r["id"]: r["score"] for r in scored.collect()}
    assert abs(score["critical"] - (42 + 6 + 18 + 14 - 14 / 24 / 2)) < 1e-9


def test_portfolio_caps_a_prolific_company(spark):
    rows = [("河谷泵业", i) for i in range(11)] + [("北辰铸件", 15), ("岩滩仪表", 16)]
    data = [(i, 40.0 - n, c, ("产品发布", "解决方案", "企业战略")[n % 3]) for i, (c, n) in enumerate(rows)]
    scored = spark.createDataFrame(data, "arrival long, score double, company string, category string")
    picked = portfolio.balanced_portfolio(portfolio.with_company_key(scored), ["岩滩仪表", "河谷泵业", "北辰铸件"])
    names = [r["company"] for r in picked.collect()]
    assert names.count("河谷泵业") == 3 and {"北辰铸件", "岩滩仪表"} <= set(names)


def test_extract_holds_the_first_rows_of_a_category(spark):
    """As many as before the extract was made to follow the picks, and more where the picks reach further."""
    frame = pd.DataFrame([(i, 1000.0 - i, f"c{i // 3}", "one") for i in range(400)], columns=["arrival", "score", "company_key", "category"])
    rows = spark.createDataFrame(frame)
    for most, held in ((54, 128), (200, portfolio.reach(200))):
        got = sorted(r.arrival for r in portfolio.extract(rows, [], most=most).collect())
        assert got == list(range(held))


def test_reduced_portfolio_equals_the_greedy_pick_over_everything(spark):
    rng = random.Random(7)
    for trial, most in enumerate((54, 54, 9, 54, 150, 300)):
        focus = [f"重点{i}" for i in range(rng.randint(0, 20))]
        names = focus + [f"其他{i}" for i in range(rng.randint(1, 40))] + ["行业"]
        weights = [rng.random() ** 3 for _ in names]
        count = rng.choice([30, 60, 900, 3000])
        frame = pd.DataFrame({
            "arrival": range(count), "score": [rng.randint(0, 60) / 2 for _ in range(count)],
            "company_key": rng.choices([identity_key(n) for n in names], weights, k=count),
            "category": rng.choices(list("abcdef"), [9, 5, 3, 1, 1, 0.2], k=count),
        })
        ranked = frame.sort_values(["score", "arrival"], ascending=[False, True]).reset_index(drop=True)
        keys = list(dict.fromkeys(identity_key(f) for f in focus))
        expected = [int(ranked["arrival"][i]) for i in portfolio.pick(ranked, keys, count, most)]
        got = portfolio.balanced_portfolio(spark.createDataFrame(frame), focus, most).orderBy("pick_no").collect()
        assert [r["arrival"] for r in got] == expected, trial


def test_a_table_of_many_domains_gives_the_tiers_of_the_lists(spark):
    listed = [f"site{i}.example" for i in range(100_000)]
    policy = urls.TrustPolicy(professional=tuple(listed), authoritative=("site5.example", "a.site7.example"), limit=200_000)
    hosts = ["x.site3.example", "site5.example", "a.site7.example", "b.a.site7.example", "site7.example", "notsite7.example", "www.siemens.com", "site99999.example"]
    rows = [f"https://{h}/p?{k}" for k, h in enumerate(hosts)] + ["https://u:p@site3.example/", "ftp://site3.example/", "no url", None, "https://SITE3.example:443/"]
    df = spark.createDataFrame([(u, 1) for u in rows], "url string, tier int")
    small = urls.TrustPolicy(professional=("site3.example", "site7.example", "site99999.example"), authoritative=policy.authoritative)
    expected = sorted(map(tuple, df.select("url", small.tier("url").alias("t"), small.publisher("url").alias("p")).collect()), key=str)
    table = trust.domain_table(spark, policy)
    assert table.count() > 100_000
    got = trust.with_tiers(df, table)
    assert got.columns == ["url", "tier", "publisher"] and sorted(map(tuple, got.collect()), key=str) == expected


def test_tiers_reject_look_alike_hosts(spark):
    cases = {
        "https://new.siemens.com/weld": "primary", "https://jxt.miit.gov.cn/r/3": "primary",
        "https://siemens.com.kurznotiz.test/weld": "untrusted", "https://notmiit.gov.cn.kurznotiz.test/": "untrusted",
        "https://myreuters.com/x": "untrusted", "https://www.reuters.com/markets/x": "authoritative",
        "https://bbs.e-works.net.cn/x": "professional", "https://me:word@www.siemens.com/": "untrusted",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r["u"]: r["t"] for r in df.select("u", POLICY.tier("u").alias("t")).collect()} == cases
    own = urls.TrustPolicy(websites=("https://flusswerk.test",))
    assert df.sparkSession.range(1).select(own.tier(F.lit("https://pumpen.flusswerk.test/a"))).first()[0] == "primary"
