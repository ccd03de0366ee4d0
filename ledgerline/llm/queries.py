"""Queries of this subpackage and their SQL (where SQL can express them)."""

from ledgerline.llm import exactdup, fillmiddle, lexical
from ledgerline.llm.exactdup import op12_exact_dedup
from ledgerline.llm.fillmiddle import op11_fill_in_middle
from ledgerline.llm.lexical import op13_lexical
from ledgerline.llm.licences import op1_licences
from ledgerline.llm.lmscore import op3_lm
from ledgerline.llm.mixing import op5_mixing
from ledgerline.llm.packing import op9_packing
from ledgerline.llm.quality import op8_quality
from ledgerline.llm.secrets import op6_secrets
from ledgerline.llm.simhash import op2_simhash
from ledgerline.llm.tokenfiles import op4_token_files
from ledgerline.llm.toxicity import op10_toxicity
from ledgerline.llm.vectors import op7_vectors

QUERIES = {
    "op1_licences": op1_licences,
    "op2_simhash": op2_simhash,
    "op3_lm": op3_lm,
    "op4_token_files": op4_token_files,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_vectors": op7_vectors,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_lexical": op13_lexical,
}
ORACLES: dict[str, str] = {
    "op11_fill_in_middle": fillmiddle.SQL,
    "op12_exact_dedup": exactdup.SQL,
    "op13_lexical": lexical.SQL,
}
