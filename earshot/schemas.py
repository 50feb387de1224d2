"""Schemas of the stored tables; the order of the fields is part of the contract."""

MENTION = (
    "mention_id string, brand string, source string, run_id string, native_id string, url string, "
    "author_hash string, text string, lang string, published_at timestamp, "
    "engagement map<string,bigint>, rating int, cluster_key string, matched_terms array<string>, "
    "match_kind string, raw_ref string"
)
_ANSWER = "struct<label:string,confidence:double,status:string>"
LABEL = (
    "mention_id string, label string, about_brand boolean, confidence double, rationale string, "
    "topic_id string, signals struct<classifier:" + _ANSWER + ",tiebreak:" + _ANSWER + ","
    "deterministic:struct<kind:string,label:string>,overflow:boolean>, corroboration string, "
    "decided_by string, prompt_rev string, status string, "
    "usage struct<tokens:bigint,cost_usd:double>"
)
RUN = (
    "local_seq bigint, run_id string, provider string, endpoint string, brand string, "
    "source string, input_digest string, submitted_at timestamp, completed_at timestamp, "
    "status string, provider_http_status int, n_results bigint, estimate_usd double, "
    "cost_usd double, billed_units bigint, cost_source string, attempts int, error string"
)
PAYLOAD = "local_seq bigint, run_id string, brand string, source string, body string"


def columns(schema: str) -> list[str]:
    """Top-level field names of a schema string."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fieldNames()
