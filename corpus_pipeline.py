"""The corpus pipeline, as the driver looks for it: its stages, their run and its SQL are those of spoor.llm.pipeline."""

from spoor.llm.pipeline import ORACLE_SQL, STAGES, Stage, run

__all__ = ["ORACLE_SQL", "STAGES", "Stage", "run"]
