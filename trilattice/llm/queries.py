"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from trilattice.llm import mixing, warc
from trilattice.llm.embed_lattice import op8_embedding_lattice
from trilattice.llm.html_extract import op2_html_text
from trilattice.llm.jpeg_media import op7_jpeg_media
from trilattice.llm.quality_rules import op10_quality_rules
from trilattice.llm.simhash import op1_simhash
from trilattice.llm.spm_encode import op4_sentencepiece
from trilattice.llm.token_count import op9_token_counts
from trilattice.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": mixing.op5_mixing,
    "op6_warc": warc.op6_warc,
    "op7_jpeg_media": op7_jpeg_media,
    "op8_embedding_lattice": op8_embedding_lattice,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES: dict[str, str] = {"op5_mixing": mixing.ORACLE, "op6_warc": warc.ORACLE}
