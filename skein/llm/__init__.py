"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations


def queries() -> dict:
    from . import (
        decontaminate,
        fingerprints,
        golay_dedup,
        html_extract,
        langid,
        mixing,
        quality,
        secrets,
        suffix_dedup,
        url_filter,
    )

    return {
        "op1_html_extract": html_extract.op1_html_extract,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_golay_dedup": golay_dedup.op3_golay_dedup,
        "op4_secrets": secrets.op4_secrets,
        "op5_mixing": mixing.op5_mixing,
        "op6_fingerprints": fingerprints.op6_fingerprints,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_quality": quality.op8_quality,
        "op9_langid": langid.op9_langid,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {}
