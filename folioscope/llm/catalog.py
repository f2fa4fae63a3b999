"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from functools import wraps

from folioscope.llm import (
    chat,
    decontamination,
    embedding_dedup,
    line_dedup,
    lm_scoring,
    mixing,
    near_dedup,
    quality,
    substring_dedup,
    suffix_dedup,
)
from folioscope.ship import ship


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        mixing.op1_mix,
        chat.op2_chat,
        embedding_dedup.op3_embedding,
        lm_scoring.op4_lm,
        substring_dedup.op5_substring,
        decontamination.op6_decontaminate,
        near_dedup.op7_near,
        suffix_dedup.op8_suffix,
        quality.op9_quality,
        line_dedup.op10_lines,
    )
}
ORACLES = mixing.ORACLE | chat.ORACLE | decontamination.ORACLE | embedding_dedup.ORACLE
