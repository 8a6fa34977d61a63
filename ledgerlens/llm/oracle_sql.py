"""DuckDB SQL for the registered queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from ledgerlens.llm import licenses, merkle

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, text_sha256
        FROM t WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op6_license_scan": licenses.oracle(),
    "op11_merkle_manifest": merkle.oracle(),
}
