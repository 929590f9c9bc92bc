"""A corpus from raw documents to token ids; the five stages are in lorewell.llm.pipeline."""

from lorewell.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
