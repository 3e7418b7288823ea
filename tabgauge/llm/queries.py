"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabgauge.llm import (
    alignment,
    decontaminate,
    line_templates,
    mixing,
    ppm,
    quality,
    quotes,
    search,
    secrets,
    simhash,
    substrings,
    token_counts,
    warc,
)
from tabgauge.llm.common import table


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.documents_quality(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substrings": substrings.op1_substrings,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_simhash": simhash.op3_simhash,
    "op4_line_templates": line_templates.op4_line_templates,
    "op5_quotes": quotes.op5_quotes,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": mixing.op8_mixing,
    "op9_ppm": ppm.op9_ppm,
    "op10_warc": warc.op10_warc,
    "op11_search": search.op11_search,
    "op12_alignment": alignment.op12_alignment,
    "op13_secrets": secrets.op13_secrets,
}

ORACLES = {
    "op1_substrings": substrings.SQL,
    "op4_line_templates": line_templates.SQL,
    "op5_quotes": quotes.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op7_quality_rules": quality.SQL,
    "op8_mixing": mixing.SQL,
    "op10_warc": warc.SQL,
    "op11_search": search.SQL,
    "op13_secrets": secrets.SQL,
}
