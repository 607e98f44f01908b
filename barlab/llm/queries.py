"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

import corpus_pipeline
from barlab.llm.decontaminate import op1_decontaminate
from barlab.llm.gif import op4_gif
from barlab.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from barlab.llm.line_dedup import op8_line_dedup
from barlab.llm.mixture import OP2_SQL, op2_mixture
from barlab.llm.near_dedup import op3_near_dedup
from barlab.llm.oracles import OP1_SQL, OP3_SQL
from barlab.llm.secret_scan import op13_secrets
from barlab.llm.shards import op7_shards
from barlab.llm.suffix_tree import op6_suffix_tree
from barlab.llm.token_files import op10_token_files
from barlab.llm.toxicity import op9_toxicity
from barlab.llm.warc import OP5_SQL, op5_warc
from barlab.llm.whitening import op12_whitening

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mixture": op2_mixture,
    "op3_near_dedup": op3_near_dedup,
    "op4_gif": op4_gif,
    "op5_warc": op5_warc,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_shards": op7_shards,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_token_files": op10_token_files,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_secrets": op13_secrets,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op2_mixture": OP2_SQL,
    "op3_near_dedup": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op11_hard_negatives": OP11_SQL,
}
