"""The queries of this subpackage, their SQL where SQL can express them, and the tables they read."""

from __future__ import annotations

from importlib import import_module

#: Query, and the module that has it.
PLACES = {
    "op1_imatch": "imatch", "op2_line_dedup": "lines", "op3_token_file": "tokens", "op4_url_filter": "urls", "op5_decontaminate": "decontaminate",
    "op6_warc": "warc", "op7_pack": "packing", "op8_jaccard_join": "jaccard", "op9_toxicity": "toxicity", "op10_suffix_dedup": "suffixes",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{place}"), name) for name, place in PLACES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{place}"), "SQL", None) for name, place in PLACES.items()}
    return {name: sql for name, sql in found.items() if sql}
