"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from corpus_pipeline import run

from ledgerloom.llm.chat import OP2_SQL, op2_preferences
from ledgerloom.llm.fingerprints import op10_fingerprints
from ledgerloom.llm.languages import op11_languages
from ledgerloom.llm.licenses import OP4_SQL, op4_licenses
from ledgerloom.llm.lines import OP7_SQL, op7_line_dedup
from ledgerloom.llm.mixing import OP9_SQL, op9_mixing
from ledgerloom.llm.neardup import OP6_SQL, op6_near_duplicates
from ledgerloom.llm.neighbours import op1_nearest_neighbours
from ledgerloom.llm.periodic import OP12_SQL, op12_periodic_runs
from ledgerloom.llm.pieces import op8_sentencepiece
from ledgerloom.llm.quality import op3_quality
from ledgerloom.llm.secrets import OP5_SQL, op5_secrets
from ledgerloom.llm.whitening import op13_whitening

QUERIES: dict = {
    "pipeline": run,
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_preferences": op2_preferences,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_secrets": op5_secrets,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_line_dedup": op7_line_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
    "op11_languages": op11_languages,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}
ORACLES: dict = {
    "op2_preferences": OP2_SQL,
    "op4_licenses": OP4_SQL,
    "op5_secrets": OP5_SQL,
    "op6_near_duplicates": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_mixing": OP9_SQL,
    "op12_periodic_runs": OP12_SQL,
}
