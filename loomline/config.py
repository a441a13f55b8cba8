"""Settings: coercions from text, aliases, and the retrieval settings with their defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Spellings of text that mean no.
NO = frozenset({"0", "false", "f", "no", "off"})
#: Spellings of generation backends.
BACKENDS = {
    "mlx_lm": ("mlx", "mlx_lm", "lm", "text"), "mlx_vlm": ("mlx_vlm", "vlm", "vision", "multimodal"), "turboquant_mlx": ("turboquant", "turboquant_mlx", "tq", "tq_mlx"),
}


def whole(value: object) -> int | None:
    try:
        return int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return None


def positive_or_none(value: object) -> int | None:
    """A positive whole number, else None."""
    n = None if value in (None, "", False) else whole(value)
    return n if n and n > 0 else None


def not_negative(value: object, default: int = 0) -> int:
    n = whole(value)
    return default if n is None else max(0, n)


def yes(value: object, default: bool = False) -> bool:
    """A switch from text, number or boolean; null and empty give the default."""
    if value is None or value == "":
        return default
    return value.strip().lower() not in NO if isinstance(value, str) else bool(value)


def backend(name: str | None) -> str:
    """The canonical name of a generation backend; anything unknown is an error."""
    key = (name or "mlx_lm").strip().lower().replace("-", "_")
    for canonical, spellings in BACKENDS.items():
        if key in spellings:
            return canonical
    raise ValueError(f"backend must be one of: {', '.join(sorted(BACKENDS))}")


def generation_options(settings: Mapping[str, object]) -> dict[str, object]:
    """Cache options by their long names; the short names stand in where those are missing."""
    pick = lambda key, default=None: settings.get(f"turboquant_{key}", settings.get(key, default))
    return {
        "fast": yes(settings.get("turboquant_fast")), "kv_bits": positive_or_none(pick("kv_bits")), "kv_group_size": not_negative(pick("kv_group_size", 64), 64) or 64,
        "min_tokens": not_negative(pick("min_tokens", 0)), "prefill_step_size": not_negative(pick("prefill_step_size", 2048), 2048) or 2048,
    }


def media_list(value: object) -> list[str] | None:
    """One path or several, trimmed; None if nothing is left."""
    items = [value] if isinstance(value, str) else list(value or [])  # type: ignore[call-overload]
    return [str(x).strip() for x in items if str(x).strip()] or None


@dataclass(frozen=True)
class RetrievalSettings:
    top_k: int = 6
    fetch_k: int = 18
    score_threshold: float = 0.0
    rerank_alpha: float = 0.65
    max_per_source: int = 0
    qa_pair_score_boost: float = 0.0
    hybrid_dense_weight: float = 1.0
    hybrid_sparse_weight: float = 1.0
    hybrid_rrf_k: int = 60

    @classmethod
    def of(cls, settings: Mapping[str, object]) -> RetrievalSettings:
        """Known keys of ``settings``, by the types of the defaults; fetch_k is at least top_k."""
        known = {f.name: type(f.default)(settings[f.name]) for f in fields(cls) if settings.get(f.name) not in (None, "")}
        made = cls(**known)
        return made if made.fetch_k >= made.top_k else cls(**{**known, "fetch_k": max(3 * made.top_k, made.top_k)})
