"""Queries and SQL oracles of the training-data operators."""

from __future__ import annotations

from . import licenses, lines, ogg, packing, pieces, pii, quality, sharding, simhash, substrings


def queries():
    return {
        "op1_length_buckets": packing.op1_length_buckets,
        "op2_line_chunks": lines.op2_line_chunks,
        "op3_bilstm_crf_pii": pii.op3_bilstm_crf_pii,
        "op4_ogg_media": ogg.op4_ogg_media,
        "op5_ngram_quality": quality.op5_ngram_quality,
        "op6_piece_lattice": pieces.op6_piece_lattice,
        "op7_simhash_groups": simhash.op7_simhash_groups,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_debruijn_repeats": substrings.op9_debruijn_repeats,
        "op10_rendezvous_shards": sharding.op10_rendezvous_shards,
    }


def oracle_sql():
    return {"op1_length_buckets": packing.OP1_SQL, "op2_line_chunks": lines.OP2_SQL, "op9_debruijn_repeats": substrings.OP9_SQL}
