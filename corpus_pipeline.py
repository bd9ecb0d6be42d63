"""The corpus pipeline: quality rules, near duplicates, decontamination, secret scans, best-fit packing.

STAGES lists (name, function(spark, docs, sf_dir)); each result is written as Parquet and is the next one's docs. run(spark, sf_dir)
applies them to documents. The functions and what they do with odd rows stand in logsignals/llm/stages.py.
"""

from logsignals.llm.stages import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Tokenisation isn't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
