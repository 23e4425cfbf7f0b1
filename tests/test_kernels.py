from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.operators import distance as d
from strandline.operators import edit_graph as g
from strandline.operators.consensus import trim_range

DNA = st.text("ACGT", max_size=12)


def plain(a: str, b: str, sub: int = 1) -> list[list[int]]:
    m = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i in range(len(b) + 1):
        for j in range(len(a) + 1):
            if not i or not j:
                m[i][j] = i + j
            else:
                m[i][j] = min(m[i - 1][j] + 1, m[i][j - 1] + 1, m[i - 1][j - 1] + (0 if a[j - 1] == b[i - 1] else sub))
    return m


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_distances(a, b):
    assert d.edit_distance(a, b) == plain(a, b)[-1][-1]
    assert d.edit_distance(a, b, d.INSDEL) == plain(a, b, 2)[-1][-1] >= d.edit_distance(a, b)
    if len(a) == len(b):
        assert d.edit_distance(a, b) <= d.hamming_distance(a, b)
    assert d.flexible_end(a, b, 99) == min(plain(a, b)[-1])


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_infix_and_placements(a, b):
    spans = {(i, j): plain(a[i:j], b)[-1][-1] for i in range(len(a) + 1) for j in range(i, len(a) + 1)}
    best = min(spans.values())
    assert d.infix(a, b, 99) == (best, sorted({j for (_, j), v in spans.items() if v == best}))
    assert d.placements(a, b, 99) == (best, sorted({(i, j - i) for (i, j), v in spans.items() if v == best}))
    assert d.infix(a, b, best - 1) == (-1, [])


@settings(max_examples=60, deadline=None)
@given(DNA, DNA)
def test_script_turns_one_into_the_other(a, b):
    script = d.edit_script(a, b)
    assert len(script) == d.edit_distance(a, b)
    for mode in (d.EDIT, d.INSDEL):
        script = d.edit_script(a, b, mode)
        same = g.normalized(a, 0, len(a), script)
        for x in (script, same):
            assert "".join(g.node_base(a, n) for n in g.path_nodes(a, 0, len(a), x)) == b
        assert all(op != "S" for _, op, _ in same) and g.normalized(a, 0, len(a), same) == same
        # nothing that an insertion or a deletion could still move over or cancel out
        for (p, op, c), (q, other, e) in zip(same, same[1:], strict=False):
            assert not (op != other and c == e and (q == p if op == "I" else q == p + 1))


@settings(max_examples=60, deadline=None)
@given(DNA, DNA, st.integers(0, 14))
def test_bands_hold_what_is_within_them(a, b, k):
    for mode, sub in ((d.EDIT, 1), (d.INSDEL, 2)):
        want = plain(a, b, sub)
        assert d.banded_distance(a, b, k, mode) == (want[-1][-1] if want[-1][-1] <= k else -1)
        ends = [(want[i][len(a)], len(a), i) for i in range(len(b) + 1)] + [(want[len(b)][j], j, len(b)) for j in range(len(a) + 1)]
        best = min(ends, key=lambda x: (x[0], -(x[1] + x[2]), -x[1]))
        assert d.extend(a, b, k, mode) == (best if best[0] <= k else (-1, 0, 0))
        bound = [x for x in ends if x[1] - x[2] <= 1 and x[2] - x[1] <= 0]
        best = min(bound, key=lambda x: (x[0], -(x[1] + x[2]), -x[1]), default=(99, 0, 0))
        if a[: min(len(a), len(b))] != b[: min(len(a), len(b))]:
            assert d.extend(a, b, k, mode, 1, 0) == (best if best[0] <= k else (-1, 0, 0))


def test_edits_in_one_form():
    a = "GGAAATC"
    # the first or the last A of a run goes: one form; a substitution is an insertion and a deletion
    assert g.normalized(a, 0, 7, [(2, "D", "A")]) == g.normalized(a, 0, 7, [(4, "D", "A")]) == [(4, "D", "A")]
    assert g.normalized(a, 0, 7, [(2, "I", "A")]) == g.normalized(a, 0, 7, [(5, "I", "A")]) == [(5, "I", "A")]
    assert g.normalized(a, 0, 7, [(5, "S", "G")]) == [(5, "I", "G"), (5, "D", "T")]
    # what a deletion takes an insertion beside it gives back
    assert g.normalized(a, 0, 7, [(2, "I", "T"), (2, "I", "A"), (4, "D", "A")]) == g.normalized(a, 0, 7, [(2, "I", "T")])


def test_extension_prefers_the_longer():
    assert d.extend("ACGT", "ACGTTT", 2) == (0, 4, 4)
    assert d.extend("ACGTAA", "ACGT", 2) == (0, 4, 4)
    assert d.extend("AAAA", "CCCC", 1) == (-1, 0, 0) or d.extend("AAAA", "CCCC", 1)[0] <= 1
    assert d.extend_back("TTACGT", "ACGT", 2) == (0, 4, 4)


def test_hamming_of_unequal_lengths():
    assert d.hamming_distance("ACGT", "CG") == 2
    assert d.hamming_distance("CG", "ACGT") == 4


def test_common_seed():
    assert g.common_seed("TTACGTACC", "GACGTACG", 4) == (2, 1, 6)
    assert g.common_seed("AAAA", "CCCC", 4) == (0, 0, 0)


TRUTH = "ACGTTGCAAGCTTAGGCATCGATTACGGATCCATGCAAGT"


def fixed(a, others, quality=None, **options):
    return g.correct_read(a, [(o, None) if isinstance(o, str) else o for o in others], g.EditOptions(9, 0.25, 20, **options), quality)


@pytest.mark.parametrize("mode", [d.EDIT, d.INSDEL])
def test_correction_of_an_insertion_and_a_deletion(mode):
    others = [TRUTH] * 6
    for wrong in (TRUTH[:15] + "C" + TRUTH[15:], TRUTH[:20] + TRUTH[21:], TRUTH[:22] + "G" + TRUTH[23:], TRUTH[:10] + "N" + TRUTH[11:]):
        assert fixed(wrong, others, mode=mode) == (TRUTH, None)
    ends = ("G" + TRUTH[1:], TRUTH[:-1] + "A")  # without substitutions a wrong base at an end is one too many
    assert [fixed(x, others, mode=mode)[0] for x in ends] == ([TRUTH] * 2 if mode == d.EDIT else [TRUTH[1:], TRUTH[:-1]])
    assert fixed("ACG", others) == ("ACG", None) and fixed("", others) == ("", None)


def test_reserve_and_shares_keep_the_reads_own_bases():
    wrong = TRUTH[:22] + "G" + TRUTH[23:]
    assert fixed(wrong, [TRUTH] * 6, reserve=1.0)[0] == wrong
    assert fixed(wrong, [TRUTH] * 2, reserve_share=0.4)[0] == wrong and fixed(wrong, [TRUTH] * 6, reserve_share=0.4)[0] == TRUTH
    assert fixed(wrong, [TRUTH], reserve_share=1.0)[0] == wrong  # weights of one vote each


def test_qualities_of_corrected_reads():
    n = len(TRUTH)
    low = "".join(chr(33 + 20 + i % 7) for i in range(n))
    assert fixed(TRUTH, [TRUTH] * 6, low) == (TRUTH, low)
    gap = TRUTH[:20] + TRUTH[21:]  # a base is missing: the new one gets the whole mean of its neighbours'
    seq, qual = fixed(gap, [TRUTH] * 6, low[:-1])
    assert seq == TRUTH and qual == low[:20] + chr(33 + (ord(low[19]) + ord(low[20]) - 66) // 2) + low[20:-1]
    extra = TRUTH[:20] + "A" + TRUTH[20:]
    assert fixed(extra, [TRUTH] * 6, low[:20] + "!" + low[20:]) == (TRUTH, low)
    swapped = TRUTH[:22] + "G" + TRUTH[23:]
    seq, qual = fixed(swapped, [TRUTH] * 6, low)
    assert seq == TRUTH and qual[:22] + qual[23:] == low[:22] + low[23:]
    assert g.path_quality([(0, ""), (1, "A"), (1, ""), (2, "C")], [10, 21]) == [10, 15, 21, 21]
    # good bases of one read outvote bad bases of two
    wrong = TRUTH[:22] + "G" + TRUTH[23:]
    assert fixed(wrong, [(TRUTH, "I" * n), (wrong, "!" * n), (wrong, "!" * n)], "!" * n)[0] == TRUTH
    assert fixed(wrong, [(TRUTH, "I" * n), (wrong, "!" * n), (wrong, "!" * n)], "!" * n, use_quality=False)[0] == wrong


def test_trimmed_corrections():
    # a base that overlaps begin with has only its own edge; a cut at the end begins with the edge to the end: one base more
    for half, kept in ((TRUTH[:30], TRUTH[:29]), (TRUTH[10:], TRUTH[11:])):
        assert fixed(TRUTH, [half] * 6, trim_factor=2.5)[0] == kept
        assert fixed(TRUTH, [half] * 6, "I" * len(TRUTH), trim_factor=2.5) == (kept, "I" * len(kept))
        assert fixed(TRUTH, [half] * 6)[0] == TRUTH


@pytest.mark.parametrize(
    ("weights", "factor", "kept"),
    [([1, 1, 5, 5, 5, 1], 2.5, (2, 5)), ([5, 5, 5], 2.5, (0, 3)), ([1, 1], 2.5, (0, 2)), ([], 2.5, (0, 0)), ([1, 5, 5, 5], 0.0, (0, 4)), (None, 1.0, (0, 0))],
)
def test_trim(weights, factor, kept):
    assert trim_range(weights, factor) == kept
