"""cloudsift — Spark-native exploration of very large tables of labelled 3-D points.

Ingest delimited text, narrow types, shuffle rows into nested random-sample
shards, and answer exploration queries over them (column-pruned sample reads,
conjunctive filters with per-step counts, axis remapping, attribute domains and
ranges, deterministic colours, legends, extents, view fitting, time-rank frames,
ray picking and render-ready exports) as DataFrame and Structured Streaming jobs.
"""

from cloudsift.roles import BINDING_ROLES, REFERENCE_ROLES, Roles
from cloudsift.session import get_session, shared_dir

__all__ = ["Roles", "REFERENCE_ROLES", "BINDING_ROLES", "get_session", "shared_dir"]
