"""The registered queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from disfluo.llm.decontam import ORACLE_OP2, op2_decontamination
from disfluo.llm.factor import op11_quality_classifier
from disfluo.llm.langid import op4_language_id
from disfluo.llm.lm import op10_lm_score
from disfluo.llm.merkle import ORACLE_OP13, op13_merkle_manifest
from disfluo.llm.mixing import ORACLE_OP3, op3_mixing
from disfluo.llm.neardup import op5_near_duplicates
from disfluo.llm.pagetext import op6_page_text
from disfluo.llm.quality import op8_quality_divergence
from disfluo.llm.ranked import ORACLE_OP12, op12_ranked_search
from disfluo.llm.suffixdup import op7_suffix_dedup
from disfluo.llm.toxicity import op9_toxicity
from disfluo.llm.urls import ORACLE_OP1, op1_url_reputation

QUERIES = {
    "op1_url_reputation": op1_url_reputation,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_page_text": op6_page_text,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_divergence": op8_quality_divergence,
    "op9_toxicity": op9_toxicity,
    "op10_lm_score": op10_lm_score,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_ranked_search": op12_ranked_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {"op1_url_reputation": ORACLE_OP1, "op2_decontamination": ORACLE_OP2, "op3_mixing": ORACLE_OP3, "op12_ranked_search": ORACLE_OP12, "op13_merkle_manifest": ORACLE_OP13}
