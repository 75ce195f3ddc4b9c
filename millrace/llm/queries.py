"""The queries of this package's problems, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import answers, bpe, cutoff, langid, mixing, neardup, overlap, packing, percentiles

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_percentiles": percentiles.p1_percentiles,
        "p1_by_day": percentiles.p1_by_day,
        "p2_found": overlap.p2_found,
        "p2_report": overlap.p2_report,
        "p3_found": answers.p3_found,
        "p3_report": answers.p3_report,
        "p4_found": neardup.p4_found,
        "p4_groups": neardup.p4_groups,
        "p5_packing": packing.p5_packing,
        "p5_utilisation": packing.p5_utilisation,
        "p6_found": cutoff.p6_found,
        "p6_rates": cutoff.p6_rates,
        "p7_ids": bpe.p7_ids,
        "p7_lengths": bpe.p7_lengths,
        "p8_mixture": mixing.p8_mixture,
        "p8_shares": mixing.p8_shares,
        "p9_found": langid.p9_found,
        "p9_languages": langid.p9_languages,
        "p9_passages": langid.p9_passages,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_percentiles": percentiles.P1_SQL,
        "p1_by_day": percentiles.P1_BY_DAY_SQL,
        "p2_found": overlap.P2_FOUND_SQL,
        "p2_report": overlap.P2_REPORT_SQL,
        "p4_found": neardup.P4_FOUND_SQL,
        "p4_groups": neardup.P4_GROUPS_SQL,
    }
