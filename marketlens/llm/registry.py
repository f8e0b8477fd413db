"""Queries of the text operators with their SQL oracles."""

from marketlens.llm import alignment, bpe, collocations, decontamination, jaccard_join, license_scan, packing, pii, quality, substring_dedup, topk_search, toxicity, url_filter


def queries():
    return {
        "op1_toxicity": toxicity.query,
        "op2_license_scan": license_scan.query,
        "op3_substring_dedup": substring_dedup.query,
        "op4_url_filter": url_filter.query,
        "op5_quality": quality.query,
        "op6_packing": packing.query,
        "op7_pii": pii.query,
        "op8_decontamination": decontamination.query,
        "op9_topk_search": topk_search.query,
        "op10_jaccard_join": jaccard_join.query,
        "op11_bpe": bpe.query,
        "op12_alignment": alignment.query,
        "op13_collocations": collocations.query,
    }


def oracle_sql():
    return {
        "op3_substring_dedup": substring_dedup.ORACLE,
        "op8_decontamination": decontamination.ORACLE,
        "op9_topk_search": topk_search.ORACLE,
        "op10_jaccard_join": jaccard_join.ORACLE,
        "op13_collocations": collocations.ORACLE,
    }
