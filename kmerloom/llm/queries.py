"""The queries of this subpackage, and their SQL where it can express them."""

from . import bpe, lm, media, nearcopies, packing, pii, quality, secrets, tokenfiles, urls

QUERIES = {
    "op1_deleted_interpolation": lm.op1_deleted_interpolation,
    "op2_sanitise": pii.op2_sanitise,
    "op3_packing": packing.op3_packing,
    "op4_bpe_trie": bpe.op4_bpe_trie,
    "op5_jaccard_join": nearcopies.op5_jaccard_join,
    "op6_token_files": tokenfiles.op6_token_files,
    "op7_secrets": secrets.op7_secrets,
    "op8_url_filter": urls.op8_url_filter,
    "op9_matroska": media.op9_matroska,
    "op10_quality_rules": quality.op10_quality_rules,
}
ORACLE_SQL = {**nearcopies.SQL, **secrets.SQL, **urls.SQL, **quality.SQL}
