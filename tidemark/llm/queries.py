"""The corpus operators as named queries, with SQL twins where SQL can express them."""

from __future__ import annotations

from tidemark.llm import line_dedup, merkle, twins
from tidemark.llm.bpe import op9_byte_bpe
from tidemark.llm.embedding_dedup import op4_embedding_dedup
from tidemark.llm.katz import op12_katz
from tidemark.llm.language import op2_language
from tidemark.llm.line_dedup import op1_line_dedup
from tidemark.llm.merkle import op11_merkle
from tidemark.llm.mixing import op10_mix_sources
from tidemark.llm.set_join import op3_jaccard_join
from tidemark.llm.sharding import op7_shard
from tidemark.llm.simhash import op6_simhash
from tidemark.llm.toxicity import op8_toxicity
from tidemark.llm.warc import op5_warc
from tidemark.llm.whitening import op13_whitening

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language": op2_language,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_shard": op7_shard,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_mix_sources": op10_mix_sources,
    "op11_merkle": op11_merkle,
    "op12_katz": op12_katz,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_jaccard_join": twins.JACCARD,
    "op4_embedding_dedup": twins.COSINE,
    "op5_warc": twins.WARC,
    "op11_merkle": merkle.ORACLE,
}
