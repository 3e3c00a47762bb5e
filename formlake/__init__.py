"""formlake: questionnaire and review-lifecycle analytics on Spark.

Sub-packages:
  functions  – Column builders (scalar rules, the condition language)
  sources    – readers/writers for answer files, templates, snapshots
  operators  – DataFrame operators (templates, evaluation, store, audit, diff, requests)
  streaming  – Structured Streaming twins of the event-driven operators
  plans      – the named queries registered with the driver, with their SQL oracles
"""

from formlake.session import get_session, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_session", "ensure_checkpoint_dir"]
