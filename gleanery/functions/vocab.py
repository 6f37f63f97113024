"""Enumerations, alias tables, word lists, domain lists and numeric limits.

Everything in this module is data that results depend on.  No logic lives here.
"""

# ---- fixed values: enumerations -------------------------------------------------------------
INDUSTRY = "行业"
UNDISCLOSED = "未披露"
TOPICS = ["工业互联网", "工业智能", "3D 模型 + AI", "制造业 + AI", "数字孪生", "智能运维"]
CATEGORIES = ["技术前沿", "产品发布", "解决方案", "企业战略", "产业市场", "资本动态"]
DEFAULT_CATEGORY = "产业市场"
DEFAULT_TOPIC = "工业智能"
IMPORTANCE = ["critical", "high", "normal"]
IMPORTANCE_POINTS = {"critical": 42, "high": 24, "normal": 0}
SOURCE_KINDS = ["website", "rss"]
TIERS = ["primary", "authoritative", "professional", "untrusted"]

LANE_SCAN = "常规行业扫描"
LANE_COMPANY = "重点企业追踪"
LANE_KEYWORD = "配置关键词扩展"
LANE_SITE = "指定网站发现"
LANE_GAP = "自主规划补充"
LANE_WEIGHTS = [(LANE_SCAN, 4), (LANE_COMPANY, 3), (LANE_KEYWORD, 1), (LANE_SITE, 1), (LANE_GAP, 1)]

PUBLISH_NODE = "融合发布"

# ---- fixed values: alias tables -------------------------------------------------------------
# Applied in this order after NFKC and lower-casing.
IDENTITY_ALIASES = [
    (r"sony\s*semiconductor(?:\s*solutions)?|索尼半导体(?:解决方案)?(?:公司)?|sony|索尼", "索尼"),
    (r"saudi\s*aramco|aramco|沙特阿美|阿美", "沙特阿美"),
    (r"siemens|西门子", "西门子"),
    (r"nvidia|英伟达", "英伟达"),
    (r"dassault\s*syst[eè]mes|达索系统", "达索系统"),
    (r"nancal|能科科技", "能科科技"),
    (r"irootech|rootcloud|树根科技|树根互联", "树根互联"),
    (r"supcon|中控技术", "中控技术"),
    (r"xuelang(?:yun)?|雪浪云|雪浪数制", "雪浪数制"),
    (r"honeycomb\s*(?:tech)?|蜂巢互联", "蜂巢互联"),
    (r"gstar(?:cad)?|浩辰软件", "浩辰软件"),
    (r"ainnovation|创新奇智", "创新奇智"),
    (r"anthropic", "anthropic"),
    (r"memorandum\s*of\s*understanding|mou|非约束性(?:协议|谅解备忘录)|合作备忘录|谅解备忘录", "备忘录"),
    (r"industrial\s*(?:ai|artificial intelligence)|工业人工智能|工业ai", "工业智能"),
]

LEGACY_CATEGORIES = {
    "前沿研究": "技术前沿",
    "重大成果": "技术前沿",
    "产品方案": "解决方案",
    "行业新闻": "产业市场",
    "企业动态": "企业战略",
    "投融资": "资本动态",
}

CATEGORY_ALIASES = {
    "行业资讯": "产业市场", "行业动态": "产业市场", "行业新闻": "产业市场", "新闻": "产业市场",
    "公司动态": "企业战略", "企业新闻": "企业战略", "企业动态": "企业战略", "竞品动态": "企业战略",
    "融资": "资本动态", "投融资": "资本动态", "投融资动态": "资本动态", "并购": "资本动态",
    "论文": "技术前沿", "研究": "技术前沿", "技术研究": "技术前沿", "前沿研究": "技术前沿",
    "成果": "技术前沿", "技术成果": "技术前沿", "重大成果": "技术前沿",
    "产品": "产品发布", "新品": "产品发布",
    "产品方案": "解决方案", "应用案例": "解决方案",
}

TOPIC_ALIASES = {
    "工业ai": "工业智能", "工业人工智能": "工业智能", "工业智能体": "工业智能",
    "3dai": "3D 模型 + AI", "3d+ai": "3D 模型 + AI", "三维+ai": "3D 模型 + AI", "生成式3d": "3D 模型 + AI",
    "制造业ai": "制造业 + AI", "智能制造": "制造业 + AI",
}

IMPORTANCE_ALIASES = {
    "重大": "critical", "关键": "critical", "高": "high", "重要": "high", "一般": "normal", "普通": "normal",
}

# Alternative field names accepted for each extracted field, first present name wins.
ITEM_FIELDS = {
    "title": ["title", "headline", "name"],
    "summary": ["summary", "coreFact", "core_fact", "fact", "description"],
    "implication": ["implication", "insight", "analysis", "takeaway"],
    "category": ["category", "type", "classification"],
    "topic": ["topic", "direction", "domain"],
    "importance": ["importance", "priority", "level"],
    "company": ["company", "enterprise", "organization", "org"],
    "event_key": ["eventKey", "event_key", "key", "id"],
    "confidence": ["confidence", "certainty", "score"],
    "evidence": ["evidence", "citations", "sources"],
}
PROFILE_FIELDS = {
    "name": ["name", "company", "enterprise"],
    "narrative": ["narrative", "story", "enterpriseNarrative"],
    "positioning": ["positioning", "position", "marketPosition"],
    "solutions": ["solutions", "productSolutions", "product_solutions", "products"],
    "capabilities": ["capabilities", "abilities", "technologyCapabilities"],
    "funding": ["funding", "investment", "financing"],
    "implication": ["implication", "analysis", "takeaway"],
    "evidence": ["evidence", "citations", "sources"],
}
ITEM_LISTS = ["items", "intelligence", "events", "insights"]
PROFILE_LISTS = ["profiles", "companyProfiles", "company_profiles"]
CITATION_DOCUMENT = ["document", "documentIndex", "document_index", "doc", "sourceIndex", "source_document"]
CITATION_QUOTE = ["quote", "citation", "excerpt", "text", "content"]

# ---- fixed values: keyword rules ------------------------------------------------------------
# Category by keyword; the first matching row wins over the supplied category.
CATEGORY_RULES = [
    ("资本动态", "融资|投资|并购|收购|ipo|估值|capital|funding|acquisition"),
    ("技术前沿", "论文|研究团队|算法|模型架构|技术突破|benchmark|arxiv|paper|research"),
    ("解决方案", "解决方案|客户案例|落地|部署|应用场景|行业方案|case study"),
    ("产品发布", "发布|推出|上线|版本|新品|产品更新|release|launch"),
    ("企业战略", "战略|定位|合作|联盟|组织|路线图|伙伴|strategy|partnership"),
]

GATE_PATTERNS = {
    "industrial": (
        "工业|制造(?:业|现场|设备|工厂)|工厂|生产线|工艺(?:优化|控制|仿真)|工业软件|工业互联网|物理\\s*ai|"
        "physical\\s*ai|3d\\s*(?:ai|模型)|cae|cad|plm|mes|scada|数字主线|预测性维护|装备|机器(?:人|视觉)|自动化"
    ),
    "business": "融资|投资|并购|收购|战略|营收|上市|组织|产品|技术|客户|交付",
    "excluded": "基因|生命健康|医疗|诊疗|医院|患者|药物|健康管理|智健|消费金融|电商营销",
    "concrete": (
        "发布|披露|公布|推出|上线|开源|投产|量产|部署|中标|签约|签署|订单|收购|并购|融资|投资|完成\\s*[a-z轮]|"
        "获批|立项|成立|升级|版本|平台|产品|系统|印发|出台|审议通过|征求意见|施行|启动.*试点|标准|规范|论文|"
        "研究预览|research preview|提出.*(?:模型|方法|架构|数据集|基准)|验证.*(?:能力|性能)|专利|客户案例|"
        "技术突破|营收|收入|利润"
    ),
    "analysis": "报告|白皮书|指数|调查|调研|统计|数据|政策|规划|标准|论文|研究|benchmark|survey",
    "partnership": "合作|伙伴|生态|联盟|备忘录|谅解备忘录|(?<![A-Za-z0-9_])mou(?![A-Za-z0-9_])|partnership",
    "deliverable": (
        "融资|投资|收购|并购|订单|合同|中标|金额|联合发布|共同开发|开源|产品|平台|系统|部署|投产|量产|客户|"
        "实验室|标准|规范|研究预览|research preview"
    ),
    "generic": "加速.*落地|推动.*发展|赋能.*转型|助力.*升级|向.*纵深|未来可期|开启新篇章|共创.*未来",
    "preview": "research preview|研究预览|proposed specification|共享规范|草案",
    "production": (
        "正式发布.*工具|推出.*工具|自主操作.*(?:设备|机器)|自主控制.*(?:设备|机器)|已部署|投入生产"
    ),
}

# Gate rule code and the label shown to readers, in evaluation order.
GATE_LABELS = {
    "no_trusted_evidence": "缺少可核验原文",
    "low_confidence": "研究置信度不足",
    "out_of_scope": "超出工业智能研究边界",
    "not_concrete": "缺少可验证的具体变化",
    "generic_trend": "仅为泛化趋势表述",
    "vague_partnership": "合作披露缺少实质成果",
    "weak_sources": "来源层级或独立交叉印证不足",
    "low_value": "未达到情报展示价值门槛",
    "unsupported_number": "标题或摘要中的关键数字无原文支持",
    "overstated": "结论强度超过原文披露",
}

NUMBER_UNITS = ["亿", "万", "%", "％", "家", "项", "套", "台", "份", "轮", "倍"]

RESTRICTED_PATTERN = (
    "环境异常|访问过于频繁|完成验证|verify (?:you are|that you are) human|captcha|access denied|just a moment"
)
SCRIPT_NOTICE_PATTERN = (
    "enable javascript|javascript (?:is )?(?:required|disabled)|without javascript|启用\\s*javascript"
)
LINK_PATTERN = (
    "about|company|capabilit|technolog|news|blog|press|article|release|research|product|solution|/s\\?"
)
OFFICIAL_LINK_PATTERN = "about|company|product|solution|technolog|capabilit"
TRACKING_PATTERN = "^(utm_|fbclid$|gclid$)"
DROPPED_ELEMENTS = ["script", "style", "noscript", "nav", "footer", "header", "form", "svg"]
SHELL_IDS = ["app", "__next", "root"]

# ---- fixed values: domains ------------------------------------------------------------------
COMPANY_WEBSITES = {
    "西门子": "https://www.siemens.com/",
    "达索系统": "https://www.3ds.com/",
    "英伟达": "https://www.nvidia.com/",
    "ptc": "https://www.ptc.com/",
    "中控技术": "https://www.supcon.com/",
    "树根互联": "https://www.irootech.com/",
    "能科科技": "https://www.nancal.com/",
    "索辰科技": "https://www.demxs.com/",
    "雪浪数制": "https://www.xuelangyun.com/",
    "蜂巢互联": "https://www.honeycombtech.com/",
    "浩辰软件": "https://www.gstarcad.com/",
    "创新奇智": "https://www.ainnovation.com/",
    "anthropic": "https://www.anthropic.com/",
}
REQUIRED_COMPANIES = ["雪浪数制", "蜂巢互联", "创新奇智"]

COMPANY_SEARCH_TERMS = {
    "雪浪数制": ["雪浪数制", "雪浪云", "Xuelang"],
    "蜂巢互联": ["蜂巢互联", "Honeycomb Tech"],
    "浩辰软件": ["浩辰软件", "GstarCAD", "Gstarsoft"],
    "创新奇智": ["创新奇智", "AInnovation"],
    "英伟达": ["NVIDIA", "英伟达"],
    "达索系统": ["达索系统", "Dassault Systèmes"],
    "西门子": ["西门子", "Siemens"],
    "树根互联": ["树根互联", "树根科技", "RootCloud", "iRootech"],
    "中控技术": ["中控技术", "SUPCON"],
}

# The operator of a deployment adds its own site through the company website setting.
PRIMARY_DOMAINS = [
    "gov.cn", "gov.uk", "gov.au", "canada.ca", "gouv.fr", "bund.de",
    "go.jp", "gov.sg", "gov.in", "gov.kr", "whitehouse.gov", "congress.gov",
    "sec.gov", "nist.gov", "energy.gov", "europa.eu",
    "cas.cn", "edu.cn", "mit.edu", "stanford.edu", "arxiv.org",
    "ieee.org", "acm.org", "iso.org", "iec.ch", "openreview.net",
    "roboticsproceedings.org", "proceedings.mlr.press",
    "sse.com.cn", "szse.cn", "cninfo.com.cn", "hkexnews.hk",
    "sony.com", "sony-semicon.com", "aramco.com",
    "abb.com", "se.com", "rockwellautomation.com", "honeywell.com",
    "autodesk.com", "ansys.com", "aveva.com", "hexagon.com",
    "microsoft.com", "ibm.com", "aws.amazon.com", "research.google",
    "bosch.com", "ge.com", "gevernova.com", "sap.com", "oracle.com",
    "palantir.com", "fanuc.co.jp", "yaskawa-global.com", "kuka.com",
    "mitsubishielectric.com", "omron.com", "hitachi.com",
    "huawei.com", "baidu.com", "alibabacloud.com", "aliyun.com",
    "tencent.com", "haier.com", "cosmoplat.com", "sanyglobal.com",
    "xcmg.com", "midea.com",
]
AUTHORITATIVE_DOMAINS = [
    "reuters.com", "apnews.com", "bloomberg.com", "ft.com",
    "xinhuanet.com", "people.com.cn", "cctv.com", "cnr.cn",
    "chinadaily.com.cn", "ce.cn", "cnstock.com", "stcn.com",
    "cs.com.cn", "yicai.com", "nature.com", "science.org",
]
PROFESSIONAL_DOMAINS = ["e-works.net.cn", "gongkong.com"]

AUTHORITY_TOP_PATTERN = r"\.(gov|edu)(\.cn)?$|^arxiv\.org$"
AUTHORITY_NEWS_PATTERN = r"reuters|bloomberg|sec\.gov|miit\.gov\.cn|gov\.cn|xinhuanet|people\.com\.cn"
AUTHORITY_NEWS_DOMAINS = [
    "reuters.com", "bloomberg.com", "sec.gov", "gov.cn", "xinhuanet.com", "people.com.cn",
]

# IPv4 blocks that are not public unicast.
NON_PUBLIC_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]

# ---- fixed values: limits -------------------------------------------------------------------
WINDOW_DAYS = 30
MERGE_DAYS = 7
# The lengths that a small deployment may cut texts and titles to; nothing is cut unless they are passed on.
TEXT_CAP = 10_000
TITLE_CAP = 300
MIN_BODY = 120
MIN_SEARCH_BODY = 160
EXCERPT_LIMIT, EXCERPT_HEAD, EXCERPT_TAIL = 4_800, 3_800, 800
EXCERPT_MARK = "\n[正文中段为节约上下文已省略]\n"
FIRST_PASS_LIMIT, TOTAL_LIMIT = 78, 100
BATCH_SIZE = 5
PLAN_LIMIT = 120
PORTFOLIO_MAX, PORTFOLIO_TARGET = 54, 45
GAP_THEMES = [
    "物理AI技术前沿", "工业智能衍生技术", "产业市场", "全球产业政策", "全球工业龙头合作",
    "科技平台制造合作", "中国科技制造龙头", "工业软件生态合作", "资本市场",
]

# ---- fixed values: standing search questions ------------------------------------------------
# key, query, topic, depth, source scope, maximum results
STANDING_QUERIES = [
    ("行业动态", '("industrial AI" OR "工业人工智能" OR "工业软件" OR "工业互联网") (发布 OR 技术突破 OR 客户落地 OR 融资 OR 并购)', "news", "basic", "trusted", 12),
    ("物理AI技术前沿", '("physical AI" OR embodied AI OR world model OR "neural simulator" OR "sim-to-real" OR synthetic data) (manufacturing OR industrial OR robotics) (research OR benchmark OR dataset OR framework OR release)', "general", "advanced", "primary", 12),
    ("工业智能衍生技术", '(industrial agent OR "manufacturing foundation model" OR "3D generative AI" OR neural operator OR differentiable simulation) (paper OR research OR benchmark OR open source)', "general", "advanced", "primary", 12),
    ("产品与方案", "(工业智能 OR industrial intelligence OR industrial agent) (产品 OR 平台 OR 解决方案 OR customer case)", "news", "basic", "trusted", 12),
    ("企业战略", "(工业软件 OR industrial AI OR manufacturing AI) (战略 OR 定位 OR 合作 OR 生态 OR partnership)", "news", "basic", "trusted", 10),
    ("全球工业龙头合作", "(Siemens OR ABB OR Schneider Electric OR Rockwell Automation OR Honeywell OR Bosch OR GE Vernova OR Mitsubishi Electric OR FANUC) (industrial AI OR manufacturing AI) (joint solution OR joint development OR deployment OR platform OR laboratory OR standard)", "news", "basic", "primary", 16),
    ("科技平台制造合作", "(NVIDIA OR Microsoft OR AWS OR IBM OR Google OR SAP OR Oracle OR Palantir) (manufacturing OR industrial) (AI platform OR digital twin OR simulation OR agent OR partnership OR deployment)", "news", "basic", "primary", 16),
    ("中国科技制造龙头", "(华为 OR 百度 OR 阿里云 OR 腾讯 OR 海尔卡奥斯 OR 三一重工 OR 徐工 OR 美的) (工业AI OR 工业智能 OR 制造业AI OR 物理AI OR 工业软件) (发布 OR 联合方案 OR 客户部署 OR 技术突破 OR 标准 OR 实验室)", "news", "basic", "primary", 16),
    ("工业软件生态合作", "(Dassault Systèmes OR Siemens OR PTC OR Autodesk OR Ansys OR AVEVA OR Hexagon) (AI OR digital twin OR simulation OR PLM OR CAD OR CAE) (release OR integration OR joint solution OR customer deployment)", "news", "basic", "primary", 16),
    ("产业市场", "(工业智能 OR 人工智能赋能新型工业化 OR 工业软件 OR 智能制造) (国家政策 OR 部委 OR 国务院 OR 工信部 OR 发改委 OR 标准 OR 试点 OR 专项行动)", "news", "advanced", "primary", 14),
    ("全球产业政策", "(manufacturing AI OR industrial AI OR advanced manufacturing) (government policy OR national strategy OR regulation OR public funding OR standard)", "news", "advanced", "primary", 12),
    ("资本市场", "(工业软件 OR manufacturing AI OR 3D AI) (融资 OR 投资 OR 并购 OR acquisition OR funding)", "news", "advanced", "trusted", 12),
]

# Fixed texts of a configured company without a profile; results show them.
PLACEHOLDER_NARRATIVE = "尚未获得可核验官网资料，请核对来源配置中的企业官网后开展研究。"
PLACEHOLDER_POSITIONING = "企业官网研究待完成"
PLACEHOLDER_IMPLICATION = "持续跟踪技术、产品、战略与资本变化。"

# Fixed query tails of the search plan.
TAIL_TOPIC_FULL = " (研究 OR 技术突破 OR 产品 OR 解决方案 OR 应用 OR 融资)"
TAIL_TOPIC = " (发布 OR 研究 OR 产品 OR 政策)"
TAIL_KEYWORD = " (研究 OR 技术 OR 产品 OR 应用 OR 市场 OR 融资)"
TAIL_COMPANY = " (产品 OR 技术 OR 客户 OR 融资 OR 投资 OR 并购 OR 战略 OR 发布)"
TAIL_COMPANY_NEWS = " (产品发布 OR 新版本 OR 解决方案 OR 客户落地 OR 中标 OR 技术突破 OR 专利 OR 标准)"
TAIL_COMPANY_CAPITAL = " (融资 OR 投资 OR 并购 OR 收购 OR 上市 OR 营收 OR 战略 OR 组织调整)"
TAIL_COMPANY_SITE = " (news OR 新闻 OR 发布 OR 产品 OR 技术 OR 客户 OR 融资 OR 投资 OR 并购)"
TAIL_SITE = " (news OR research OR product OR solution OR 新闻 OR 研究 OR 产品)"
