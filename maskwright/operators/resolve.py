"""Overlap resolution: greedy by rank, inside each row.

Candidates are taken by rank (most confident, earliest, longest, first rule); one is kept when it
overlaps nothing kept before. Touching spans do not overlap. The result does not reduce to "no
better span overlaps me": a span may survive because its better rival lost to a third one.

Candidates are sorted by ``sort_array``: ``array_sort`` interprets a comparison that builds an ordering anew for every pair.

Long documents: overlaps never cross a point no candidate covers, so the candidates are cut there
into blocks and the (quadratic) greedy step runs per block. A block that cannot be cut, such as one
span covering thousands of others, is taken in chunks; each chunk's kept spans sit under a
bounding box, so a candidate looks into the few boxes it touches.
"""

from __future__ import annotations

from maskwright.functions.expr import empty_array, joined, let, running
from maskwright.operators.detect import SPAN_TYPE

_CHUNK = 64
_CLASH = "get({srt}, v_i).s < get({srt}, v_k).e AND get({srt}, v_k).s < get({srt}, v_i).e"
_INTS = empty_array("INT")


def _greedy(indexes: str, srt: str) -> str:
    """Indexes into the ranked candidates ``srt`` that survive, taken in order."""
    return (f"aggregate({indexes}, {_INTS}, (v_a, v_i) ->"
            f" if(exists(v_a, v_k -> {_CLASH.format(srt=srt)}), v_a, {joined('v_a', 'array(v_i)')}))")


def _greedy_small(block: str) -> str:
    picked = _greedy("sequence(0, size(v_srt) - 1)", "v_srt")
    return let("v_srt", f"sort_array({block})", f"transform({picked}, v_i -> get(v_srt, v_i))")


def _greedy_chunked(block: str) -> str:
    chunk = (f"sequence(int(v_j * {_CHUNK}),"
             f" least(int(v_j * {_CHUNK} + {_CHUNK - 1}), size(v_srt) - 1))")
    free = (f"filter({chunk}, v_i -> NOT exists(v_boxes, v_b -> get(v_srt, v_i).s < v_b.hi"
            f" AND v_b.lo < get(v_srt, v_i).e AND exists(v_b.ks, v_k -> {_CLASH.format(srt='v_srt')})))")
    box = """if(size(v_kept) = 0, v_boxes, flatten(array(v_boxes, array(named_struct(
        'lo', array_min(transform(v_kept, v_k -> get(v_srt, v_k).s)),
        'hi', array_max(transform(v_kept, v_k -> get(v_srt, v_k).e)), 'ks', v_kept)))))"""
    boxes = f"""aggregate(sequence(0, (size(v_srt) - 1) div {_CHUNK}),
        {empty_array('STRUCT<lo: INT, hi: INT, ks: ARRAY<INT>>')},
        (v_boxes, v_j) -> {let('v_kept', _greedy(free, 'v_srt'), box)})"""
    picked = f"flatten(transform({boxes}, v_b -> v_b.ks))"
    return let("v_srt", f"sort_array({block})", f"transform({picked}, v_i -> get(v_srt, v_i))")


def _independent_blocks(candidates: str) -> str:
    """Cut the candidates, in text order, where nothing reaches across.

    Of the possible cuts, the first in each run of ``_CHUNK`` candidates is used.
    """
    by_start = _by_places(candidates, "'s', v_c.s, 'e', v_c.e")
    reach = running("transform(v_bs, v_c -> v_c.e)", "0", "greatest(v_l, v_r)")
    cuts = ("filter(sequence(0, size(v_bs) - 1), v_i ->"
            " if(v_i = 0, true, get(v_bs, v_i).s >= get(v_reach, v_i - 1)))")
    used = (f"filter(v_cuts, (v_i, v_n) ->"
            f" if(v_n = 0, true, v_i div {_CHUNK} <> get(v_cuts, v_n - 1) div {_CHUNK}))")
    blocks = ("transform(v_used, (v_i, v_n) -> slice(v_bs, v_i + 1,"
              " coalesce(get(v_used, v_n + 1), size(v_bs)) - v_i))")
    return let("v_bs", by_start, let("v_reach", reach, let("v_cuts", cuts, let("v_used", used, blocks))))


def _in_text_order(candidates: str) -> str:
    return _by_places(candidates, "'s', v_c.s")


def _by_places(candidates: str, places: str) -> str:
    """Candidates by ``places``, those at one place by rank. Structs in the key would be compared by an ordering built for each pair."""
    order = f"sort_array(transform(v_ranked, (v_c, v_i) -> named_struct({places}, 'i', v_i)))"
    return let("v_ranked", f"sort_array({candidates})", f"transform({order}, v_p -> get(v_ranked, v_p.i))")


#: No candidate of ``v_bs``, in text order, reaches into the next one.
_APART = "NOT exists(sequence(1, size(v_bs) - 1), v_i -> get(v_bs, v_i).s < get(v_bs, v_i - 1).e)"


def resolved_spans(candidates: str) -> str:
    """Non-overlapping spans in text order, as ``ARRAY<SPAN_TYPE>``."""
    kept = f"""CASE
        WHEN size(v_cs) <= {_CHUNK} THEN {_greedy_small('v_cs')}
        ELSE flatten(transform({_independent_blocks('v_cs')}, v_blk -> CASE
            WHEN size(v_blk) <= {2 * _CHUNK} THEN {_greedy_small('v_blk')}
            ELSE {_greedy_chunked('v_blk')} END)) END"""
    # most texts have few candidates, none over another: the ranks need not be looked at
    first, second = "get(v_cs, 0)", "get(v_cs, 1)"
    in_order = f"""CASE
        WHEN size(v_cs) = 1 THEN v_cs
        WHEN size(v_cs) = 2 AND {first}.s < {second}.s AND {first}.e <= {second}.s THEN v_cs
        WHEN size(v_cs) = 2 AND {second}.s < {first}.s AND {second}.e <= {first}.s THEN array({second}, {first})
        WHEN size(v_cs) = 2 THEN {let('v_kept', kept, _in_text_order('v_kept'))}
        WHEN size(v_cs) <= {_CHUNK} THEN {let('v_bs', _in_text_order('v_cs'),
            f"if({_APART}, v_bs, {let('v_kept', kept, _in_text_order('v_kept'))})")}
        ELSE {let('v_kept', kept, _in_text_order('v_kept'))} END"""
    spans = f"""CAST(transform({in_order}, v_c -> named_struct(
        'start', v_c.s, 'end', v_c.e, 'original', v_c.txt, 'replacement', v_c.rep,
        'category', v_c.cat, 'label', v_c.lab, 'confidence', -v_c.nc)) AS ARRAY<{SPAN_TYPE}>)"""
    return let("v_cs", candidates,
               f"CASE WHEN size(v_cs) = 0 THEN {empty_array(SPAN_TYPE)}"
               f" ELSE {spans} END")
