"""Queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from reviewspark.llm.align import op12_alignment
from reviewspark.llm.ann import op7_ann
from reviewspark.llm.bpe import op10_bpe
from reviewspark.llm.decontam import OP11_SQL, op11_decontamination
from reviewspark.llm.langid import op2_language_id
from reviewspark.llm.maxent import op3_lm_score
from reviewspark.llm.merkle import OP13_SQL, op13_merkle
from reviewspark.llm.minhash import op5_fingerprints
from reviewspark.llm.packing import op1_packing
from reviewspark.llm.quality import op4_quality
from reviewspark.llm.simhash import op8_simhash
from reviewspark.llm.suffix import op9_suffix
from reviewspark.llm.warc import op6_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_lm_score": op3_lm_score,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_warc": op6_warc,
    "op7_ann": op7_ann,
    "op8_simhash": op8_simhash,
    "op9_suffix": op9_suffix,
    "op10_bpe": op10_bpe,
    "op11_decontamination": op11_decontamination,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}

#: Base32 of a SHA-1 in hexadecimal: eight groups of five digits, each group four letters.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {5 * i + 1}, 5))::INT >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

SQL = {
    "op11_decontamination": OP11_SQL,
    "op13_merkle": OP13_SQL,
    "op6_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
             f AS (SELECT html, min(page_id) AS head FROM p GROUP BY html)
        SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> head THEN head END AS refers_to
        FROM p JOIN f ON p.html = f.html
    """,
}
