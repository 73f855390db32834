"""The registered queries of this package and their SQL twins, where SQL can express them."""

from __future__ import annotations

from footfall.llm.best_fit import op11_best_fit
from footfall.llm.decontaminate import OP4_SQL, op4_decontaminate
from footfall.llm.langid import op8_language
from footfall.llm.lines import OP7_SQL, op7_line_dedup
from footfall.llm.merkle import OP13_SQL, op13_merkle
from footfall.llm.packing import op6_packing
from footfall.llm.periodic import op12_runs
from footfall.llm.shards import op10_shards
from footfall.llm.simhash import op9_simhash
from footfall.llm.token_files import op3_token_files
from footfall.llm.topk import OP1_SQL, op1_topk
from footfall.llm.toxicity import op5_toxicity
from footfall.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_topk": op1_topk,
    "op2_warc": op2_warc,
    "op3_token_files": op3_token_files,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_language": op8_language,
    "op9_simhash": op9_simhash,
    "op10_shards": op10_shards,
    "op11_best_fit": op11_best_fit,
    "op12_runs": op12_runs,
    "op13_merkle": op13_merkle,
}
ORACLES = {"op1_topk": OP1_SQL, "op2_warc": OP2_SQL, "op4_decontaminate": OP4_SQL, "op7_line_dedup": OP7_SQL, "op13_merkle": OP13_SQL}
