"""Column-expression helpers (all JVM-side built-ins, codegen friendly)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def speaker(turn: Column | str) -> Column:
    """Speaker by parity: odd → caller, even (incl. greeting 0) → representative."""
    t = F.col(turn) if isinstance(turn, str) else turn
    return F.when(t % 2 == 1, F.lit("caller")).otherwise(F.lit("representative"))


def objective_of_turn(turn: Column | str) -> Column:
    """Detector objective bound to a turn's speaker; null for the greeting."""
    t = F.col(turn) if isinstance(turn, str) else turn
    return (F.when(t % 2 == 1, F.lit("social_engineering"))
             .when((t >= 2) & (t % 2 == 0), F.lit("policy_violation")))


def eligible(objective: str | Column, turn: Column | str) -> Column:
    """Turn eligibility for a detector objective (turn 0 never)."""
    t = F.col(turn) if isinstance(turn, str) else turn
    o = F.lit(objective) if isinstance(objective, str) else objective
    if isinstance(objective, str) and objective not in S.OBJECTIVES:
        raise ValueError(f"unknown detection objective: {objective!r}")
    # unknown objectives are not eligible anywhere; validation reports them
    return (((o == "social_engineering") & (t >= 1) & (t % 2 == 1))
            | ((o == "policy_violation") & (t >= 2) & (t % 2 == 0)))


def n_eligible_from(objective: Column, first_turn: Column, n_turns: Column) -> Column:
    """Eligible turns of ``objective`` in [first_turn, n_turns-1]; first_turn is eligible."""
    return F.when(first_turn.isNull(), None).otherwise(
        F.floor((n_turns - 1 - first_turn) / 2).cast("long") + 1)


def normalize_prediction(raw: Column) -> Column:
    """Prediction cell → 1/0/null by its type: of texts only 'Y' and 'N' (after
    trim, case-sensitive) count, numbers only as 1 and 0, booleans as such."""
    text = F.trim(raw.cast("string"))
    kind = F.typeof(raw)
    number = F.when(kind == "boolean", (text == "true").cast("double")).otherwise(text.try_cast("double"))
    value = F.when(kind == "string", F.when(text == "Y", 1.0).when(text == "N", 0.0)).otherwise(number)
    return F.when(value == 1, F.lit(1)).when(value == 0, F.lit(0)).cast("long")


def alias_label(raw: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Longest-alias substring match on the lower-cased text; null if no hit."""
    text = F.lower(raw)
    expr = None
    for alias, label in S.flat_aliases(aliases):
        cond = text.contains(alias)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def short_label(dimension: str, meta_key: Column | None, selection_key: Column | None,
                raw: Column,
                normalizer: Callable[[Column], Column] | None = None) -> Column:
    """Short-label resolution chain: non-blank metadata key → non-blank
    selection key → alias match (or a user ``normalizer``) → trimmed raw →
    'unknown' when raw is null."""
    def nonblank(c: Column | None) -> Column:
        if c is None:
            return F.lit(None).cast("string")
        return F.when(F.length(F.trim(c)) > 0, F.trim(c))

    matched = normalizer(raw) if normalizer else alias_label(raw, S.aliases_for(dimension))
    return F.coalesce(nonblank(meta_key), nonblank(selection_key),
                      F.when(raw.isNull(), F.lit("unknown"))
                       .otherwise(F.coalesce(matched, F.trim(raw))))


def mix_expr(conv: str, turn: str, k: int) -> str:
    """Deterministic 0..999 integer hash of (conversation, turn, k) — the
    fixture rule of FIXTURES.md §3, written as SQL both engines evaluate."""
    return (f"(((({conv}*7919 + {turn}*104729 + {k}*1299709) % 10007)"
            f" * (({conv}*3571 + {turn}*15485863 + {k}*611953) % 10009)) % 1000)")
