"""The registered queries of the training-data operators, and SQL where SQL can express one over whole tables."""

from lattica.llm import oracles
from lattica.llm.chat import op2_chat_formatting
from lattica.llm.fingerprints import op6_fingerprints
from lattica.llm.language import op9_language_id
from lattica.llm.lm import op5_lm_scoring
from lattica.llm.manifest import op12_merkle_manifest
from lattica.llm.mixing import op3_source_mixing
from lattica.llm.ngram_join import op1_ngram_jaccard_join
from lattica.llm.packing import op10_packing
from lattica.llm.quality import op4_quality_rules
from lattica.llm.repair import op11_conversation_repair
from lattica.llm.simhash import op13_simhash_dedup
from lattica.llm.substring_dedup import op7_substring_dedup
from lattica.llm.token_output import op8_token_output

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_source_mixing": op3_source_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_fingerprints": op6_fingerprints,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_output": op8_token_output,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_simhash_dedup": op13_simhash_dedup,
}

#: The others' rows hold hashes of this library, subword ids, or what models make.
ORACLES: dict[str, str] = {
    "op2_chat_formatting": oracles.OP2,
    "op11_conversation_repair": oracles.OP11,
    "op12_merkle_manifest": oracles.OP12,
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s FROM cut
), keyed AS (
    SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS node, s FROM sets
), nodes AS (
    SELECT node, min(n) AS n, min(doc_id) AS least, any_value(s) AS s FROM keyed WHERE node IS NOT NULL GROUP BY node
), shingles AS (
    SELECT node, n, unnest(s) AS x FROM nodes
), links AS (
    SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.node <> b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached AS (
    SELECT node AS root, node FROM nodes UNION SELECT r.root, l.b FROM reached r JOIN links l ON l.a = r.node
), classes AS (
    SELECT r.root, min(m.least) AS component_id FROM reached r JOIN nodes m ON m.node = r.node GROUP BY r.root
)
SELECT k.doc_id, k.n AS n_shingles, coalesce(c.component_id, k.doc_id) AS component_id FROM keyed k LEFT JOIN classes c ON c.root = k.node
""",
}
