"""Operators on change logs; none of them reads or writes files."""

from .lww import as_of, compact, compact_stats, get_status, latest, live, multi_get, replay_tail, revived, scan
from .metadata import generation_candidates, generation_footers, read_amplification

__all__ = ["as_of", "compact", "compact_stats", "generation_candidates", "generation_footers", "get_status", "latest", "live", "multi_get", "read_amplification", "replay_tail", "revived", "scan"]
