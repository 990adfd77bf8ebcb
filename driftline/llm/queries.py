"""Driver-facing queries of the training-data operators."""

from __future__ import annotations

from driftline.llm import ann, bpe, html_text, langid, minhash, packing, quality, secrets, substring, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_bpe": bpe.op2_bpe,
    "op3_ann": ann.op3_ann,
    "op4_substring": substring.op4_substring,
    "op5_warc": warc.op5_warc,
    "op6_langid": langid.op6_langid,
    "op7_html": html_text.op7_html,
    "op8_neardup": minhash.op8_neardup,
    "op9_packing": packing.op9_packing,
    "op10_secrets": secrets.op10_secrets,
}
ORACLES = {"op1_quality": quality.OP1_SQL, "op5_warc": warc.OP5_SQL}
