"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import ann, chat, decontaminate, language, ngram_join, packing, pii, quality, records, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_ann": ann.op2_ann,
    "op3_language": language.op3_language,
    "op4_quality": quality.op4_quality,
    "op5_chat": chat.op5_chat,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_packing": packing.op7_packing,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_records": records.op9_records,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {"op5_chat": chat.OP5_SQL, "op6_ngram_join": ngram_join.OP6_SQL, "op8_decontaminate": decontaminate.OP8_SQL}
