"""Imports every query module, so that registration happens once."""

from . import (  # noqa: F401
    q_answers,
    q_chunks,
    q_eval,
    q_quality,
    q_search,
    q_store,
    q_structure,
    q_text,
)
from .registry import ORACLES, QUERIES  # noqa: F401
