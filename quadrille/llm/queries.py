"""Queries of the corpus operators and their DuckDB SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import chat, conv_trie, fim, line_dedup, minhash, quality_rules
from quadrille.llm.bpe import op4_bpe
from quadrille.llm.chat import op11_chat_format
from quadrille.llm.conv_trie import op12_conv_trie
from quadrille.llm.decontaminate import op7_decontamination
from quadrille.llm.fim import op13_fill_in_middle
from quadrille.llm.licenses import op5_license_scan
from quadrille.llm.line_dedup import op8_line_dedup
from quadrille.llm.minhash import op6_near_dedup
from quadrille.llm.quality_model import op3_quality_model
from quadrille.llm.quality_rules import op10_quality_rules
from quadrille.llm.secrets import op2_secret_scan
from quadrille.llm.sstable import op9_token_files
from quadrille.llm.substring_dedup import op1_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_model": op3_quality_model,
    "op4_bpe": op4_bpe,
    "op5_license_scan": op5_license_scan,
    "op6_near_dedup": op6_near_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_quality_rules": op10_quality_rules,
    "op11_chat_format": op11_chat_format,
    "op12_conv_trie": op12_conv_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op6_near_dedup": minhash.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op11_chat_format": chat.SQL,
    "op12_conv_trie": conv_trie.SQL,
    "op13_fill_in_middle": fim.SQL,
}
