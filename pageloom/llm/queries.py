"""The named queries of the subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

import corpus_pipeline
from pageloom.llm.bpe import op6_bpe
from pageloom.llm.decontaminate import OP13_SQL, op13_decontaminate
from pageloom.llm.importance import op1_importance
from pageloom.llm.langid import op7_langid
from pageloom.llm.packing import op3_packing
from pageloom.llm.pivots import op5_pivots
from pageloom.llm.prefixes import OP11_SQL, op11_prefixes
from pageloom.llm.search import OP8_SQL, op8_search
from pageloom.llm.simhash import op4_simhash
from pageloom.llm.substrings import op10_substrings
from pageloom.llm.toxicity import op9_toxicity
from pageloom.llm.urls import OP2_SQL, op2_urls
from pageloom.llm.whitening import op12_whitening

QUERIES = {
    "op1_importance": op1_importance, "op2_urls": op2_urls, "op3_packing": op3_packing, "op4_simhash": op4_simhash,
    "op5_pivots": op5_pivots, "op6_bpe": op6_bpe, "op7_langid": op7_langid, "op8_search": op8_search,
    "op9_toxicity": op9_toxicity, "op10_substrings": op10_substrings,
    "op11_prefixes": op11_prefixes, "op12_whitening": op12_whitening, "op13_decontaminate": op13_decontaminate, "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op2_urls": OP2_SQL, "op8_search": OP8_SQL, "op11_prefixes": OP11_SQL, "op13_decontaminate": OP13_SQL}
