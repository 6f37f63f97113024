"""Explicit schemas: no inference job, and one timestamp type everywhere."""

EVIDENCE = "array<struct<url: string, title: string, quote: string>>"

ITEM = (
    "id string, event_key string, title string, summary string, implication string, category string, topic string, "
    "importance string, company string, published_at timestamp, effective_at timestamp, observed_at timestamp, "
    f"date_basis string, confidence double, evidence {EVIDENCE}, run_id string, first_seen_run_id string, arrival bigint"
)
PROFILE = (
    "id string, name string, narrative string, positioning string, solutions array<string>, capabilities array<string>, "
    f"funding string, implication string, evidence {EVIDENCE}, updated_at timestamp, basis string, arrival bigint"
)
DOCUMENT = (
    "batch_id string, doc_no int, url string, title string, text string, published_at timestamp, source string, "
    "profile_company string, focus_company string, retrieval_method string, arrival bigint"
)
RUN = "id string, run_date date, mode string, status string, started_at timestamp, finished_at timestamp, item_count int"
RUN_EVENT = "run_id string, at timestamp, node string, message string, status string"
INSIGHT = (
    "run_id string, generated_at timestamp, basis string, overview string, conclusions array<struct<concept: string, "
    "judgment: string, reasoning: string, implication: string, watchpoint: string, evidence_ids: array<string>>>"
)

# The given test tables.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp"
    ),
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
