"""The corpus pipeline of gridloom.llm, at the place where it is looked for."""

from gridloom.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, line_stage, near_duplicate_stage, packing_stage, pii_stage, quality_stage, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "line_stage", "near_duplicate_stage", "packing_stage", "pii_stage", "quality_stage", "run"]
