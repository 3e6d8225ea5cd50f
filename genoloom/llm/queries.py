"""Registry of the operators' queries and of the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from genoloom.llm.decontam import ORACLE_SQL as OP9_SQL
from genoloom.llm.decontam import op9_decontamination
from genoloom.llm.html import op5_html
from genoloom.llm.langid import op6_language_id
from genoloom.llm.lmscore import op8_lm_scoring
from genoloom.llm.media import op7_media
from genoloom.llm.mixing import op10_mixing
from genoloom.llm.negatives import ORACLE_SQL as OP11_SQL
from genoloom.llm.negatives import op11_hard_negatives
from genoloom.llm.packing import op12_packing
from genoloom.llm.quality import op3_quality
from genoloom.llm.sharding import op1_sharding
from genoloom.llm.simhash import op4_simhash
from genoloom.llm.suffix_dedup import op2_suffix_dedup
from genoloom.llm.trie import ORACLE_SQL as OP13_SQL
from genoloom.llm.trie import op13_prefix_trie

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_html": op5_html,
    "op6_language_id": op6_language_id,
    "op7_media": op7_media,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_packing": op12_packing,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {"op9_decontamination": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op13_prefix_trie": OP13_SQL}
