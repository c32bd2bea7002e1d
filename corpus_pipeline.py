"""The training-corpus pipeline; its stages are in ``flowlab.llm.pipeline``."""

from flowlab.llm.pipeline import ORACLE_SQL, STAGES, drop_copies, drop_near_copies, drop_toxic, pack, redact_secrets, run

__all__ = ["ORACLE_SQL", "STAGES", "drop_copies", "drop_near_copies", "drop_toxic", "pack", "redact_secrets", "run"]
