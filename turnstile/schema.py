"""Domain constants and declared schemas.

Everything the rest of the package names (principles, violation types,
objectives, stances, label aliases) lives here so that the Spark operators
and the DuckDB oracle are generated from one source of truth.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the reference's vocabulary for results to
# match (column names, category labels, canonical orders, label aliases).
# ---------------------------------------------------------------------------

PRINCIPLES = (
    "reciprocity",
    "commitment_consistency",
    "social_proof",
    "authority",
    "liking",
    "scarcity",
    "unity",
)

VIOLATION_TYPES = (
    "improper_authentication",
    "improper_disclosure",
    "improper_action",
)

OBJECTIVES = ("policy_violation", "social_engineering")
STANCES = ("high_precision", "balanced", "high_recall")

REPRESENTATIVE_LABELS = ("by_book", "tired", "helpful", "distracted")
BENIGN_CONTEXT_LABELS = ("minimal", "moderate", "heavy")

PRINCIPLE_ALIASES = {
    "commitment_consistency": (
        "commitment_consistency",
        "commitment consistency",
        "commitment and consistency",
        "commitment/consistency",
        "commitment-consistency",
    ),
    "social_proof": ("social_proof", "social proof"),
    "reciprocity": ("reciprocity",),
    "authority": ("authority",),
    "liking": ("liking",),
    "scarcity": ("scarcity",),
    "unity": ("unity",),
}

REPRESENTATIVE_ALIASES = {
    "by_book": (
        "by_book", "by the book", "by-the-book", "by-book", "follows policy",
        "follows procedure", "strict", "rule-following", "rule following",
        "policy-bound", "procedural",
    ),
    "tired": (
        "tired", "fatigued", "exhausted", "end of shift", "sleepy", "weary",
        "burnt out", "burned out",
    ),
    "helpful": ("helpful", "eager to help", "friendly", "accommodating", "obliging"),
    "distracted": (
        "distracted", "multitasking", "rushed", "busy", "overwhelmed", "scattered",
    ),
}

BENIGN_CONTEXT_ALIASES = {
    "minimal": (
        "minimal", "little benign", "brief", "few benign", "sparse", "low context",
        "no benign", "mostly stays on topic", "just a little extraneous",
        "businesslike",
    ),
    "moderate": (
        "moderate", "some benign", "balanced", "medium", "intermediate",
        "very substantial amount of benign", "two or three extraneous sentences",
        "obscure the attack shape",
    ),
    "heavy": (
        "heavy", "extensive benign", "lots of benign", "extensive", "verbose",
        "high context", "abundant benign", "absolutely unhinged", "rambling",
        "several extraneous sentences", "unreasonable manner",
    ),
}

STATUS_SUCCESS, STATUS_PARTIAL, STATUS_ERROR = "success", "partial", "error"
THREAT, BENIGN = "threat", "benign"
SCENARIOS = ("se_detection", "se_prevention", "pv_detection", "pv_on_time")
RECALL_RULES = ("any", "two_or_more", "majority")
DEFAULT_PERCENTILES = (0.25, 0.50, 0.75, 0.90, 0.99, 0.999)
CONVERSATION_TYPES = (THREAT, BENIGN, "combined")

# Generation columns the detection stage prefixes with ``generation_``.
AMBIGUOUS_GENERATION_COLUMNS = (
    "model", "temperature", "top_p", "status", "attempts", "last_error",
    "generated_at_utc", "input_tokens", "output_tokens", "total_tokens",
)

# Columns of the request metadata before and after the flag metrics, in order.
REQUEST_COLUMNS_HEAD = (
    "request_id", "replicate_index", "prompt_template_key", "scenario", "representative", "caller",
    "benign_context", "cialdini_emphasis", "turn_count_value", "flavor", "model", "temperature", "top_p",
    "status", "attempts", "last_error", "generated_at_utc", "input_tokens", "output_tokens", "total_tokens",
)
REQUEST_COLUMNS_TAIL = ("system_prompt", "user_prompt")
# Run columns of the detection metadata, after the per-turn lists, in order.
RUN_COLUMNS = (
    "detection_model", "detection_status", "detection_error_count", "detection_no_valid_count",
    "detection_last_error", "detection_started_at_utc", "detection_finished_at_utc",
    "detection_total_latency_ms", "detection_total_input_tokens", "detection_total_output_tokens",
)

# ---------------------------------------------------------------------------
# Derived names (built from the fixed values above).
# ---------------------------------------------------------------------------

CALLER_FLAGS = tuple(f"cialdini_{p}" for p in PRINCIPLES)
VIOLATION_FLAGS = VIOLATION_TYPES
ALL_FLAGS = CALLER_FLAGS + VIOLATION_FLAGS
DETECTION_KEYS = tuple(f"{o}__{s}" for o in OBJECTIVES for s in STANCES)
PER_TURN_FIELDS = (
    "prediction", "p_detected", "p_not_detected", "latency_ms", "input_tokens",
    "output_tokens",
)
LIST_FIELDS = ("prediction", "p_detected", "p_not_detected", "latency_ms", "input_tokens", "output_tokens", "top10")
LIST_COLUMNS = tuple(f"{k}__{f}" for k in DETECTION_KEYS for f in LIST_FIELDS)
REQUEST_COLUMNS = (REQUEST_COLUMNS_HEAD + tuple(f"{f}_{m}" for f in ALL_FLAGS for m in ("sum", "by_turn"))
                   + REQUEST_COLUMNS_TAIL)
OBJECTIVE_OF_SPEAKER = {"caller": "social_engineering", "representative": "policy_violation"}


def canonical_labels(dimension: str) -> tuple[str, ...]:
    return {
        "cialdini_emphasis": PRINCIPLES,
        "benign_context": BENIGN_CONTEXT_LABELS,
        "representative": REPRESENTATIVE_LABELS,
    }.get(dimension, ())


def aliases_for(dimension: str) -> dict[str, tuple[str, ...]]:
    return {
        "cialdini_emphasis": PRINCIPLE_ALIASES,
        "benign_context": BENIGN_CONTEXT_ALIASES,
        "representative": REPRESENTATIVE_ALIASES,
    }[dimension]


def flat_aliases(aliases: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(alias, label) pairs, longest alias first, ties in declaration order."""
    pairs = [(alias, label) for label, al in aliases.items() for alias in al]
    return sorted(pairs, key=lambda p: -len(p[0]))


# ---------------------------------------------------------------------------
# Declared Spark schemas (nothing is inferred).
# ---------------------------------------------------------------------------

TURN_STRUCT = T.StructType(
    [T.StructField("passage", T.StringType())]
    + [T.StructField(f, T.BooleanType()) for f in ALL_FLAGS]
)

USAGE_STRUCT = T.StructType([
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
])

RECORD_STRUCT = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("replicate_index", T.LongType()),
    T.StructField("flavor", T.StringType()),
    T.StructField("generated_at_utc", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
    T.StructField("system_prompt", T.StringType()),
    T.StructField("user_prompt", T.StringType()),
    T.StructField("selection", T.MapType(T.StringType(), T.StringType())),
    T.StructField("usage", USAGE_STRUCT),
    T.StructField("conversation", T.MapType(T.StringType(), TURN_STRUCT)),
])

STORE_SCHEMA = T.StructType([
    T.StructField("conversations", T.MapType(T.StringType(), RECORD_STRUCT)),
])

TOKEN_PROB = T.ArrayType(T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("logprob", T.DoubleType()),
]))

DETECTIONS_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("turn_index", T.LongType()),
    T.StructField("objective", T.StringType()),
    T.StructField("stance", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("pred", T.LongType()),
    T.StructField("p_detected", T.DoubleType()),
    T.StructField("p_not_detected", T.DoubleType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
])
