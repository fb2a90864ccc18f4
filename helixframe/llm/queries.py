"""The operators' named queries over the test tables, with SQL where it can say the same."""

from helixframe.llm import exact_dedup, langid, mixing, packing, pii, secrets, simhash, tiff, url_filter, warc

QUERIES = {
    "op1_pii": pii.op1,
    "op2_warc": warc.op2,
    "op3_url_filter": url_filter.op3,
    "op4_tiff": tiff.op4,
    "op5_secrets": secrets.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_mixing": mixing.op7,
    "op8_packing": packing.op8,
    "op9_language_id": langid.op9,
    "op10_simhash": simhash.op10,
}
ORACLES = {
    "op2_warc": warc.OP2_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
}
