"""DuckDB SQL for the training-data queries that SQL can express over whole tables.

The other operators learn, sample or permute: tests hold them against plain versions.
"""

from __future__ import annotations

# Fixed values of the contracts, as in the operators: what parts words, and what is folded.
SPACED = r"[^\x20\x09-\x0D]+"
FOLDED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({LOWER.format(f'coalesce({text}, {chr(39) * 2})')}, '{pattern}')"


def _runs(words: str, width: str) -> str:
    """All runs of ``width`` words, each as one text; none where there are fewer."""
    return f"list_transform(range(1, len({words}) - {width} + 2), lambda i: array_to_string(list_slice({words}, i, i + {width} - 1), ' '))"


OP1 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
first AS (SELECT payload_digest, min(page_id) AS least FROM h WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT h.page_id, h.payload_bytes, h.payload_digest,
  CASE WHEN least IS NULL OR least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN least <> page_id THEN least END AS refers_to
FROM h LEFT JOIN first ON h.payload_digest = first.payload_digest AND h.payload_bytes >= 100"""

#: Sets are compared where they share a shingle; labels spread along links until none is smaller.
OP3 = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_words("text", SPACED)} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN {_runs("w", "4")} ELSE [array_to_string(w, ' ')] END)) AS token FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (token) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT reach.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id"""

OP7 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_words("text", FOLDED)} AS w FROM documents),
b AS (SELECT item_id, {_words("text", FOLDED)} AS w FROM benchmark),
items AS (SELECT item_id, least(len(w), 13) AS width, w FROM b WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT DISTINCT item_id, width, unnest({_runs("w", "width")}) AS said FROM items),
widths AS (SELECT DISTINCT width FROM windows),
runs AS (SELECT doc_id, width, unnest({_runs("w", "width")}) AS said, unnest(range(1, len(w) - width + 2)) AS place FROM d, widths WHERE len(w) >= width),
hits AS MATERIALIZED (SELECT doc_id, place, runs.width, item_id FROM runs JOIN windows ON windows.width = runs.width AND windows.said = runs.said),
hit_words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(place, place + width)) AS word FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)"""

ORACLES = {
    "op1_seekable_bundles": OP1,
    "op3_ngram_jaccard_join": OP3,
    "op7_benchmark_decontamination": OP7,
}
