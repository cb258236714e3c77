"""Closed vocabularies and rule constants.

All of these are fixed values that must equal the data model's.
"""

VISIBILITY = ("INVESTIGATION_EVIDENCE", "OFFICIAL_ANALYSIS", "FINAL_FINDING")
DOCUMENT_TYPES = (
    "FACTUAL_REPORT", "WITNESS_STATEMENT", "CREW_STATEMENT", "MAINTENANCE_RECORD", "WEATHER_RECORD", "NOTAM", "TELEMETRY", "FLIGHT_DATA", "IMAGE",
    "DIAGRAM", "EXAMINATION_REPORT", "TECHNICAL_REPORT", "MEDICAL_REPORT", "AUDIO", "TEXT", "HTML", "FINAL_REPORT", "OTHER",
)
EVIDENCE_TYPES = ("TEXT", "TABLE", "TIME_SERIES", "IMAGE", "METADATA")
EXTRACTION_METHODS = ("DETERMINISTIC", "AI", "HUMAN")
REVIEW_STATUSES = ("NOT_REQUIRED", "PENDING", "ACCEPTED", "REJECTED")
DISPOSITIONS = ("AI_ALLOWED", "LOCAL_ONLY", "LINK_ONLY", "EXCLUDED")
UNCLEAR_RIGHTS = ("THIRD_PARTY_UNCLEAR", "UNKNOWN")
CLAIM_STATUSES = ("OBSERVED", "INFERRED", "DISPUTED", "UNKNOWN")
TIME_PRECISIONS = ("EXACT", "APPROXIMATE", "RELATIVE", "UNKNOWN")
STAGES = (
    "PROMOTE_TIMELINE", "RESOLVE_ENTITIES", "PROMOTE_CLAIMS", "GENERATE_HYPOTHESES", "SEARCH_SUPPORT", "SEARCH_CONTRADICTIONS",
    "DESIGN_FALSIFICATION_TESTS", "EXECUTE_FALSIFICATION_TESTS", "REVISE_CONFIDENCE", "VERIFY_REPLAY", "COMPLETE",
)
HYPOTHESIS_STATUSES = ("ACTIVE", "WEAKENED", "REJECTED", "LEADING")
TEST_TYPES = ("EVIDENCE_PRESENCE", "TEMPORAL_CONSISTENCY", "CLAIM_CONTRADICTION", "SEMANTIC_COMPARISON")
STRENGTHS = ("LOW", "MEDIUM", "HIGH")
OUTCOMES = ("CONTRADICTED", "EXPECTED_EVIDENCE_MISSING", "SURVIVED", "INCONCLUSIVE")
#: Confidence deltas by outcome, for LOW, MEDIUM and HIGH tests.
TEST_WEIGHTS = {
    "CONTRADICTED": ("-0.0800", "-0.1800", "-0.3500"),
    "EXPECTED_EVIDENCE_MISSING": ("-0.0300", "-0.0800", "-0.1500"),
    "SURVIVED": ("0.0200", "0.0400", "0.0600"),
    "INCONCLUSIVE": ("0.0000", "0.0000", "0.0000"),
}
CONFIDENCE_FLOOR, CONFIDENCE_CEILING = "0.0500", "0.9500"
REVISION_RULE = "weighted-delta-v1"
ACTOR_STAGES = {"ACQUISITION": "ACQUISITION", "PROCESSOR": "PROCESSING", "BLIND": "BLIND", "EVALUATION": "EVALUATION"}
CAPABILITIES = (
    "NTSB_ACQUISITION", "CONTEXT_DEV", "WEB_SEARCH", "RAW_STORAGE", "SUPABASE_DATABASE", "MODEL_INFERENCE", "EVIDENCE_READ", "INVESTIGATION_TOOL",
    "RETRIEVAL", "LOCK",
)
FORBIDDEN_BLIND_CAPABILITIES = ("NTSB_ACQUISITION", "CONTEXT_DEV", "WEB_SEARCH", "RAW_STORAGE")
OPERATIONS = ("READ", "WRITE", "NETWORK", "LOCK", "DENY")
CASE_TRANSITIONS = (("ACQUIRING", "BLIND"), ("BLIND", "LOCKED"), ("LOCKED", "REVEALED"))
EVENT_TARGETS = {
    "INVESTIGATION_STARTED": "investigation", "STAGE_TRANSITION": "investigation", "ENTITY_CREATED": "entity", "TIMELINE_CREATED": "timeline_event",
    "CLAIM_CREATED": "claim", "HYPOTHESIS_CREATED": "hypothesis", "CRITIQUE_CREATED": "critique", "TEST_CREATED": "test", "TEST_RESOLVED": "test",
    "CONFIDENCE_REVISED": "confidence_revision", "HYPOTHESIS_STATUS_CHANGED": "hypothesis", "RETRIEVAL_COMPLETED": "retrieval_query",
    "INVESTIGATION_COMPLETED": "investigation",
}
DOCKET_CLASSIFICATION = ("title", "source_url", "document_type", "published_at", "rights_status", "processing_disposition", "expected_checksum")
PROBE_CATEGORIES = ("COMPONENT_ENTITY_ALIASES", "TEMPORAL_SEQUENCE", "TECHNICAL_SYMPTOM", "CONTRADICTION_ORIENTED")

FINAL_TITLE = r"(?i)\b(final report|probable cause|adopted)\b"
OFFICIAL_TITLE = r"(?i)\b(analysis|findings?|recommendations?)\b"
WITHHELD_TITLE = r"(?i)\b(final report|probable cause|adopted|analysis|findings?|recommendations?)\b"
HOST_NAME = r"^(?=.{1,253}$)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*$"
