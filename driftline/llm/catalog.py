"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from driftline.llm.hmm import op6_hmm
from driftline.llm.html_main import op7_html
from driftline.llm.languages import op12_language
from driftline.llm.matroska import op8_matroska
from driftline.llm.merkle import OP1_SQL, op1_merkle
from driftline.llm.mixing import op5_mixing
from driftline.llm.pieces import op9_pieces
from driftline.llm.pii import op4_pii
from driftline.llm.quality import op2_quality
from driftline.llm.runs import op11_runs
from driftline.llm.simhash import op3_simhash
from driftline.llm.spelling import op13_spelling
from driftline.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_merkle": op1_merkle,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_hmm": op6_hmm,
    "op7_html": op7_html,
    "op8_matroska": op8_matroska,
    "op9_pieces": op9_pieces,
    "op10_warc": op10_warc,
    "op11_runs": op11_runs,
    "op12_language": op12_language,
    "op13_spelling": op13_spelling,
}
SQL = {
    "op1_merkle": OP1_SQL,
    "op10_warc": OP10_SQL,
}
