"""Schemas, vocabularies and thresholds shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Thresholds and search limits
# ---------------------------------------------------------------------------
PREFILTER_FLOOR = 0.75      # similarity floor of the first retrieval
AUTO_CONFIRM_AT = 0.92      # confidence that needs no person
RETRY_FROM = 0.70           # below this no retry is tried
MAX_RETRIES = 2
FLOOR_STEP = 0.10
LOWEST_FLOOR = 0.55
BASE_TOP_K = 5
TOP_K_STEP = 3
MIN_VECTOR_LIMIT = 5        # a vector search reads max(2k, 5) neighbours
STRING_CUT = 0.70           # weakest string similarity that counts
ROW_CAP = 100_000
HEADER_SCAN_ROWS = 3
HEADER_MIN_HITS = 3
EVAL_STRING_TOP_K = 3
BATCH_SYNONYMS = 15
BATCH_DESCRIPTIONS = 20
BATCH_EMBEDDINGS = 50

# ---------------------------------------------------------------------------
# Specification sheet headers (field -> keywords)
# ---------------------------------------------------------------------------
HEADER_KEYWORDS = {
    "eng_name": ["영문", "english", "eng_name", "column_name"],
    "local_name": ["한글", "korean", "kor_name", "국문"],
    "description": ["설명", "description", "항목설명", "desc"],
    "req_type": ["type", "타입", "자료형", "데이터타입"],
    "req_period": ["기간", "시점", "period", "요구기간"],
}
SPEC_FIELDS = ["eng_name", "local_name", "description", "req_type", "req_period"]
REQUIRED_FIELDS = ["eng_name", "local_name", "description", "req_type"]

# ---------------------------------------------------------------------------
# Tags, paths and their texts
# ---------------------------------------------------------------------------
VALIDATED_STATUSES = ["matched", "auto_confirmed", "inferred_confirmed"]
FINAL_TAGS = [
    "unresolved", "not_found", "type_mismatch", "period_mismatch", "full_period", "confirm_period",
]
TAG_LABELS = {
    "not_found": "실 DB에 없음",
    "type_mismatch": "타입 불일치",
    "period_mismatch": "제공가능 기간 없음",
    "full_period": "요청기간 전체 제공가능",
    "confirm_period": "일부기간만 제공가능(조정됨)",
    "unresolved": "명세 매칭 실패",
}
FULL_PERIOD_NO_REQUEST_LABEL = "제공가능시점(기간) 전체 제공 가능"
PATH_LABELS = {
    "validated": "정상 검증",
    "auto_confirmed": "AI 자동 확정",
    "rejected_by_human": "담당자 거절",
    "no_match": "매칭 후보 없음",
}
REPORT_HEADINGS = {
    "eng_name": "영문명",
    "local_name": "한글명",
    "req_type": "요청 type",
    "avail_type": "제공가능 type",
    "req_period": "요청시점(기간)",
    "avail_period": "제공가능시점(기간)",
    "description": "항목설명",
    "source_table": "소속테이블",
    "final_tag": "최종태그",
    "tag_label": "태그설명",
    "path_label": "처리경로",
    "evidence": "근거",
}

# ---------------------------------------------------------------------------
# Evidence texts (printf formats)
# ---------------------------------------------------------------------------
EV_EXACT = "영문명 정확 매칭"
EV_NO_CANDIDATE = "검색된 후보 없음"
EV_REJECTED = "담당자 확인 결과 거절"
EV_BAD_RESPONSE = "LLM 응답 파싱 실패"
EV_OUTSIDE_SUFFIX = " (검증 실패: 후보 목록 밖 응답)"
EV_NOT_FOUND = "메타에는 있었으나 실 DB에서 컬럼 확인 불가"
EV_TYPE_MISMATCH = "명세 type과 실제 type 불일치 - 담당자 확인(거절)으로 명세 type 유지, 최종 확정"
EV_TYPE_CONFIRMED = "[type 갱신 승인: %s로 확정] "
EV_NO_RETENTION = "보유기간 정보 없음"
EV_NO_REQUEST = "요청기간 미기재 - 현재 보유 중인 전체 기간(%d~%d)을 참고로 제공"
EV_DISJOINT = "요청기간(%d~%d)과 보유기간(%d~%d) 겹치는 구간 없음"
EV_CONTAINED = "요청기간 전체가 보유기간(%d~%d)에 포함됨"
EV_PARTIAL = "요청기간 일부만 보유 -> 제공가능 기간(%d~%d)으로 조정"
EV_AUTO_PREFIX = "[AI 자동 확정] "
ASK_MATCH = "%s -> LLM 추천(확신도 %s) 승인?"
ASK_TYPE = "%s: spec=%s vs actual=%s, DB 기준 갱신?"
RULE_DESCRIPTION = "%s 관련 값 (원본 컬럼명: %s)"
TABLE_DESCRIPTION = "%s 원본 데이터"
DESCRIPTION_SEPARATOR = " | "
REVIEWED_SOURCES = ["llm_generated_reviewed", "manual"]

# ---------------------------------------------------------------------------
# Event labels and summaries (node -> label, printf format, arg)
# ---------------------------------------------------------------------------
NODE_LABELS = {
    "parsing": "명세서 파싱",
    "meta_init": "Meta Search 준비",
    "meta_exact_check": "정확 매칭 확인",
    "meta_retrieve": "다중소스 후보 검색",
    "meta_no_match": "매칭 후보 없음 처리",
    "meta_judge": "AI 매칭 판단",
    "meta_auto_confirm": "자동 확정",
    "meta_retry": "재검색 준비",
    "meta_human_confirm": "담당자 확인 대기",
    "db_validation": "실 DB 검증",
    "classification": "최종 태깅",
    "report": "명세서 생성",
}
NODE_SUMMARIES = {
    "parsing": "%s건 파싱 완료",
    "meta_retrieve": "후보 %s건 검색됨",
    "meta_judge": "확신도 %s / 권고 %s",
    "meta_auto_confirm": "확신도 임계값 이상 → 자동 확정",
    "meta_retry": "재검색 %s회차 준비",
    "meta_no_match": "검색 후보 없음 → 매칭 실패 처리",
    "db_validation": "%s건 실 DB 검증 완료",
    "classification": "%s건 최종 태깅 완료",
    "report": "명세서 생성 완료: %s",
}
EXACT_CHECK_SUMMARIES = {
    "true": "정확 매칭 성공",
    "empty": "처리할 컬럼 없음",
    "false": "정확 매칭 실패 → 후보 검색 필요",
}
DEFAULT_SUMMARY = "처리 완료"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
SPEC_CELLS = "spec_id string, row_idx long, cells array<string>"
COLUMN_SPEC = (
    "column_id string, table_id string, column_name string, data_type string, "
    "description string, tag string, confidence double, updated_at timestamp"
)
TABLE_CATALOG = (
    "table_id string, table_name string, source_system string, registered_at timestamp, "
    "row_count long, description string"
)
TABLE_RELATIONSHIPS = (
    "relationship_id string, from_table_id string, to_table_id string, join_key string, "
    "relation_type string, source string, confidence double"
)
GLOSSARY_TERMS = (
    "term_id string, canonical_term string, synonyms array<string>, domain string, "
    "description string, linked_column_id string, source string, updated_at timestamp"
)
SNAPSHOT = "table_id string, column_name string, data_type string, ordinal int"
JUDGMENT_REPLY = (
    "selected_column_id string, confidence string, evidence string, "
    "recommend_action string, corrupt string"
)

_TYPE_NAMES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def type_name(dtype: T.DataType) -> str:
    """The one type vocabulary used on the declared and on the actual side."""
    if isinstance(dtype, T.ArrayType):
        return type_name(dtype.elementType) + "[]"
    simple = dtype.simpleString()
    return _TYPE_NAMES.get(simple, simple.upper())


def search_params(attempt: int) -> dict:
    """Search width of one attempt: k, floor, neighbours read, string cut."""
    top_k = BASE_TOP_K + TOP_K_STEP * attempt
    floor = round(max(LOWEST_FLOOR, PREFILTER_FLOOR - FLOOR_STEP * attempt), 4)
    return {
        "attempt": attempt,
        "top_k": top_k,
        "floor": floor,
        "vector_limit": max(2 * top_k, MIN_VECTOR_LIMIT),
        "string_cut": max(STRING_CUT, floor),
    }
