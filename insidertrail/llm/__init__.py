"""Operators of a training-data pipeline, their queries and the SQL they are checked with."""

from insidertrail.llm.decontamination import OP13_SQL, op13_decontamination
from insidertrail.llm.exact_search import OP5_SQL, op5_exact_search
from insidertrail.llm.filter_audit import OP11_SQL, op11_filter_audit
from insidertrail.llm.hnsw import op10_hnsw
from insidertrail.llm.licences import OP9_SQL, op9_licences
from insidertrail.llm.mixing import OP8_SQL, op8_mixing
from insidertrail.llm.pii import op3_pii
from insidertrail.llm.pieces import op1_sentencepiece
from insidertrail.llm.quality import op7_quality
from insidertrail.llm.simhash import op2_simhash
from insidertrail.llm.spelling import OP12_SQL, op12_spelling
from insidertrail.llm.url_filter import OP6_SQL, op6_url_filter
from insidertrail.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece, "op2_simhash": op2_simhash, "op3_pii": op3_pii, "op4_warc": op4_warc,
    "op5_exact_search": op5_exact_search, "op6_url_filter": op6_url_filter, "op7_quality": op7_quality,
    "op8_mixing": op8_mixing, "op9_licences": op9_licences, "op10_hnsw": op10_hnsw,
    "op11_filter_audit": op11_filter_audit, "op12_spelling": op12_spelling, "op13_decontamination": op13_decontamination,
}
# The others have no SQL form and are held against brute-force versions in the tests.
ORACLES = {
    "op4_warc": OP4_SQL, "op5_exact_search": OP5_SQL, "op6_url_filter": OP6_SQL, "op8_mixing": OP8_SQL,
    "op9_licences": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_spelling": OP12_SQL, "op13_decontamination": OP13_SQL,
}
