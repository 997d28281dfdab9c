"""Parameters of the log-anomaly pipeline, in one frozen object.

Every operator takes the parameters it needs as arguments with these defaults,
so a run is fully described by its inputs and a ``Params`` value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that results depend on (they must equal the behaviour being matched).
# Alert levels, most severe first: name, inclusive upper score bound.
LEVELS = (
    ("CRITICAL", -0.9),
    ("HIGH", -0.7),
    ("MEDIUM", -0.5),
    ("LOW", -0.3),
)

# Noise patterns, matched case-insensitively anywhere in the line.
NOISE_PATTERNS = (
    r"heartbeat",
    r"health.*check",
    r"cron.*scheduled",
    r"systemd.*started",
    r"kernel.*log",
    r"^\[.*\]$",
)

# Masking rules, applied in this order: (name, pattern, replacement).
MASK_RULES = (
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_MASKED]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_MASKED]"),
    ("token", r"[A-Za-z0-9]{32,}", "[TOKEN_MASKED]"),
    ("username", r"(?i)\b(user|usr|username|login):\s*\w+", r"\1: [USER_MASKED]"),
)

# Health score weights: anomaly score, error rate, log volume, trend.
HEALTH_WEIGHTS = (0.4, 0.3, 0.2, 0.1)


@dataclass(frozen=True)
class Params:
    window_lines: int = 100
    window_seconds: int = 60
    # isolation forest
    n_trees: int = 100
    contamination: float = 0.01
    seed: int = 42
    max_samples: int = 256
    # autoencoder
    encoding_dim: int = 32
    hidden_layers: tuple = (64, 32)
    epochs: int = 50
    batch_size: int = 32
    learning_rate: float = 0.001
    validation_split: float = 0.2
    ae_percentile: float = 0.95
    # ensemble
    weight_forest: float = 0.6
    weight_ae: float = 0.4
    # alerting
    throttle_seconds: int = 300
    suppress_seconds: int = 3600
    # dashboard / history
    history_points: int = 500
    alert_history: int = 100
    # drift
    drift_window: int = 1000
    drift_threshold: float = 0.15
    retrain_trigger: bool = True
    # risk
    risk_history: int = 20
    risk_window: int = 10
    # template mining
    similarity: float = 0.4
    levels: tuple = field(default=LEVELS)


DEFAULT = Params()
