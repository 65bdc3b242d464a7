"""Query plans: each registered query is a DataFrame plan over the driver tables."""

from . import q_eval, q_io, q_models, q_score, q_stream, q_table  # noqa: F401  (registers queries)
from .registry import ORACLES, QUERIES  # noqa: F401
