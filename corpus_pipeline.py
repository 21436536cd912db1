"""The corpus pipeline's stages, its run() and its SQL; they are part of the llm subpackage."""

from cartulary.llm.pipeline import ORACLE_SQL, STAGES, benchmark_stage, language_stage, line_stage, near_duplicate_stage, run, token_stage

__all__ = ["ORACLE_SQL", "STAGES", "run", "language_stage", "line_stage", "near_duplicate_stage", "benchmark_stage", "token_stage"]
