"""Registered queries of the corpus operators and their SQL oracles."""

from sparkfolio.llm import ann, bpe, html_extract, line_dedup, mixing, ranked, simhash, spelling, tokenfile, topk, toxicity, url_filter, warc


def queries():
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_near_duplicates": simhash.op2_near_duplicates,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_bpe": bpe.op4_bpe,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_warc": warc.op6_warc,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_exact_topk": topk.op8_exact_topk,
        "op9_nearest_neighbours": ann.op9_nearest_neighbours,
        "op10_main_text": html_extract.op10_main_text,
        "op11_ranked_search": ranked.op11_ranked_search,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_token_files": tokenfile.op13_token_files,
    }


def oracle_sql():
    return {
        "op1_mix_sources": mixing.ORACLE,
        "op3_line_dedup": line_dedup.ORACLE,
        "op5_url_filter": url_filter.ORACLE,
        "op6_warc": warc.ORACLE,
        "op8_exact_topk": topk.ORACLE,
        "op11_ranked_search": ranked.ORACLE,
        "op12_spelling_variants": spelling.ORACLE,
    }
