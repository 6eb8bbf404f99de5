"""Queries of this subpackage, their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, licenses, mixing, quality, secrets, simhash, tokens, topk, urls, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_tokens": tokens.op2_tokens,
    "op3_simhash": simhash.op3_simhash,
    "op4_secrets": secrets.op4_secrets,
    "op5_warc": warc.op5_warc,
    "op6_quality": quality.op6_quality,
    "op7_urls": urls.op7_urls,
    "op8_licenses": licenses.op8_licenses,
    "op9_topk": topk.op9_topk,
    "op10_bpe": bpe.op10_bpe,
}
ORACLE_SQL = {"op1_mixing": mixing.OP1_SQL, "op5_warc": warc.OP5_SQL, "op7_urls": urls.OP7_SQL, "op9_topk": topk.OP9_SQL}
