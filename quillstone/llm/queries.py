"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from quillstone.llm.chat import op10_chat
from quillstone.llm.decontaminate import op9_decontamination
from quillstone.llm.embeddings import OP2_SQL, op2_embedding_dedup
from quillstone.llm.langid import op7_langid
from quillstone.llm.licenses import op8_licenses
from quillstone.llm.mixing import op1_mixing
from quillstone.llm.phrases import OP13_SQL, op13_phrases
from quillstone.llm.repair import OP12_SQL, op12_repair
from quillstone.llm.secrets import op3_secrets
from quillstone.llm.simhash import op6_simhash
from quillstone.llm.tokens import op5_tokens
from quillstone.llm.toxicity import op4_toxicity
from quillstone.llm.warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_tokens": op5_tokens,
    "op6_simhash": op6_simhash,
    "op7_langid": op7_langid,
    "op8_licenses": op8_licenses,
    "op9_decontamination": op9_decontamination,
    "op10_chat": op10_chat,
    "op11_warc": op11_warc,
    "op12_repair": op12_repair,
    "op13_phrases": op13_phrases,
}

ORACLE_SQL: dict[str, str] = {"op2_embedding_dedup": OP2_SQL, "op11_warc": OP11_SQL, "op12_repair": OP12_SQL, "op13_phrases": OP13_SQL}
