"""Profiles: what differs between use cases, as one immutable value."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, replace

# Patterns, markers and connectives that decide where texts are cut.
CLEAN_PATTERNS = (
    r"(?im)^Hello,\s+users\s+of\s+(?:CMV|r/changemyview)[^\n]*\n?",
    r"(?im)^Confirmed:\s+\d+\s+deltas?\s+awarded\s+to\s+/u/\S+[^\n]*\n?",
    r"(?im)(?:^/u/DeltaBot\b[^\n]*|^\*I am a bot\b[^\n]*)(?:\n.+)*",
)
DELETED_MARKERS = (r"\[removed\]", r"\[deleted\]")
CONNECTIVES = (
    "and", "but", "or", "so", "yet", "because", "although", "however", "therefore", "since", "while", "whereas",
    "unless", "if", "when", "after", "before", "moreover", "furthermore", "in addition", "as a result",
    "for example", "in contrast", "on the other hand", "that", "which", "who",
)
ITALIAN_MARKERS = (r"\[testo non disponibile\]", r"\[omissis\]", r"\[removed\]", r"\[deleted\]")
ITALIAN_CONNECTIVES = (
    "e", "ed", "ma", "o", "oppure", "quindi", "perché", "poiché", "sebbene", "tuttavia", "pertanto", "mentre",
    "laddove", "se", "quando", "dopo", "prima", "che", "il quale", "la quale", "chi", "inoltre", "per di più",
    "di conseguenza", "ad esempio", "al contrario", "d'altra parte", "and", "but", "or", "so", "because", "however",
    "therefore", "while", "if", "when",
)


@dataclass(frozen=True)
class Profile:
    name: str = "social_media_en"
    # Segmentation.
    ctx_window: int = 8192
    chars_per_token: int = 4
    prompt_overhead: int = 512
    response_share: float = 0.4
    min_words: int = 2
    deleted_markers: tuple[str, ...] = DELETED_MARKERS
    clean_patterns: tuple[str, ...] = CLEAN_PATTERNS
    connectives: tuple[str, ...] = CONNECTIVES
    # Candidates.
    k: int = 25
    threshold: float = 0.45
    implicit_window: int = 10
    # Relations.
    support_gate: float = 0.45
    attack_gate: float = 0.35
    context: int = 2
    batch: int = 10
    # Graphs.
    min_units: int = 3
    # Strengths.
    damping: float = 0.85
    op_bonus: float = 0.5
    depth_bonus: float = 0.5
    explicit_at: float = 0.4
    context_decay: float = 0.5
    local_mean: float = 0.5
    local_share: float = 0.5
    amplify: float = 0.5
    # Propagation.
    lam: float = 0.5
    tau: float = 0.3
    tau_agg: float = 1.0
    beta: float = 0.1
    eps: float = 1e-6
    max_iter: int = 1000
    synthetic_weight: float = 0.7
    attack_boost: float = 3.0
    extras: dict = field(default_factory=dict, compare=False)

    @property
    def batch_chars(self) -> int:
        """Characters of a prompt: what the context window leaves, 256 tokens at least."""
        tokens = max(self.ctx_window - self.prompt_overhead - int(self.ctx_window * self.response_share), 256)
        return tokens * self.chars_per_token

    @property
    def deleted_regex(self) -> str:
        return "(?i)" + "|".join(self.deleted_markers)

    @property
    def connective_regex(self) -> str:
        """Matches in lower case only, whatever the case of the list."""
        return "|".join(re.escape(c).replace("\\ ", " ") for c in self.connectives)


ENGLISH = Profile()
ITALIAN = Profile(name="interrogations_it", chars_per_token=3, prompt_overhead=600, deleted_markers=ITALIAN_MARKERS, clean_patterns=(), connectives=ITALIAN_CONNECTIVES, threshold=0.40)


def merge(base: dict, over: dict) -> dict:
    """over wins; objects are merged key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str, base: Profile = ENGLISH) -> Profile:
    """base with the values of a JSON object in a file; ValueError if it is missing or no object."""
    try:
        with open(path) as f:
            found = json.load(f)
    except (OSError, json.JSONDecodeError) as e:
        raise ValueError(f"profile {path}: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"profile {path}: not an object")
    flat: dict = {}
    for k, v in found.items():
        flat |= v if isinstance(v, dict) and k in {"edu", "pac", "bas", "strength", "semantics"} else {k: v}
    names = {f.name: f for f in fields(Profile)}
    also = {"min_edu_words": "min_words", "fallback_connectives": "connectives", "system_prompt_overhead": "prompt_overhead", "response_headroom_frac": "response_share", "min_argumentative_units": "min_units"}
    known = {also.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in flat.items() if also.get(k, k) in names}
    return replace(base, **known, extras=merge(base.extras, {k: v for k, v in flat.items() if also.get(k, k) not in names}))
