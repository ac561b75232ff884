"""Stable hashes: family hold-out and request identities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weekcast.constants import HOLDOUT_MODULUS


def is_heldout(family: Column) -> Column:
    """First 8 hex digits of SHA-256, modulo 5, equal to 0. New families never move old ones."""
    head = F.conv(F.substring(F.sha2(family, 256), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(HOLDOUT_MODULUS)) == 0


def request_hash(request_json: Column) -> Column:
    """SHA-256 of a request already in sorted-key compact JSON."""
    return F.sha2(request_json, 256)


def sorted_json(**fields: Column) -> Column:
    """Compact JSON object with keys in sorted order and NULL kept as ``null``."""
    parts = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def dedupe_key(provider: Column, tool: Column, request_json: Column, destination: Column) -> Column:
    """Identity of a job: SHA-256 over the compact JSON list of its four parts."""

    def quoted(text: Column) -> Column:
        escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), escaped, F.lit('"'))

    return F.sha2(
        F.concat(F.lit("["), F.concat_ws(",", quoted(provider), quoted(tool), request_json, quoted(destination)), F.lit("]")),
        256,
    )
