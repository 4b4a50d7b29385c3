"""Tree builders against enumeration, and small known cases."""

import itertools

import numpy as np
import pytest

from ligature.operators import kernels as K
from ligature.operators import matching as M
from ligature.operators.selection import blocked_split
from ligature.operators.trees import postorder
from ligature.sources import forms


def all_trees(i, j):
    if j - i == 1:
        yield []
        return
    for k in range(i + 1, j):
        for a, b in itertools.product(all_trees(i, k), all_trees(k, j)):
            yield [*a, *b, (i, j, k)]


def affinity(n, seed):
    a = np.random.default_rng(seed).random((n, n))
    a = (a + a.T) / 2
    np.fill_diagonal(a, 1)
    return a


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_affinity_program_is_the_best_tree(n):
    a = affinity(n, n)
    value = lambda t: sum((n - (j - i)) * a[i:k, k:j].sum() for i, j, k in t)
    nodes, best = K.affinity_program(a)
    assert best[0, n] == pytest.approx(max(value(t) for t in all_trees(0, n)))
    assert value(nodes) == pytest.approx(best[0, n])


@pytest.mark.parametrize("weight", [0.0, 0.4, 1.0])
def test_boundary_program_is_the_best_tree(weight):
    n, balance = 6, 0.3
    a, c = affinity(n, 7), np.random.default_rng(1).random(n - 1)
    whole = K.denominator(a)

    def value(t):
        out = 0.0
        for i, j, k in t:
            out += (1 - weight) * (n - (j - i)) * a[i:k, k:j].sum() / whole
            out += (weight * np.log(j - i) / np.log(n) * c[k - 1] - balance * (abs((k - i) - (j - k)) / (j - i)) ** 2) / (n - 1)
        return out

    nodes, best = K.boundary_program(a, c, weight, balance)
    assert best[0, n] == pytest.approx(max(value(t) for t in all_trees(0, n)))
    assert value(nodes) == pytest.approx(best[0, n])
    assert value(K.boundary_linkage(a, c, weight, balance)) <= best[0, n] + 1e-9


def test_additive_program_is_the_best_tree():
    v = np.random.default_rng(3).random((6, 12))
    unit = lambda x: x / x.sum(axis=1, keepdims=True)

    def cost(t):
        return sum(np.linalg.norm(unit(v[i:k].sum(0)[None]) - unit(v[k:j].sum(0)[None])) for i, j, k in t)

    nodes, best = K.additive(v, unit)
    assert -best[0, 6] == pytest.approx(min(cost(t) for t in all_trees(0, 6)))
    assert cost(nodes) == pytest.approx(-best[0, 6])
    with pytest.raises(ValueError):
        K.additive(-v, unit)


def test_ties_go_to_the_middle_or_the_start():
    flat = np.ones((6, 6))
    assert K.affinity_program(flat)[0][-1] == (0, 6, 3)
    assert K.affinity_program(flat, "earliest")[0][-1] == (0, 6, 1)


def test_merge_orders_are_valid_trees():
    for nodes in (K.balanced(9), K.random_merges(9, "a"), K.average_linkage(affinity(9, 2))):
        assert len(nodes) == 8 and nodes[-1][:2] == (0, 9)
    assert K.random_merges(9, "a") == K.random_merges(9, "a")


def test_matching_prefers_pairs_then_small_errors():
    near = lambda tol: lambda p, r: abs(p - r) if abs(p - r) <= tol else None
    assert M.ordered_match([9, 11], [10], near(2)) == [(0, 0)]
    assert M.ordered_match([0, 4], [3, 5], near(3)) == [(0, 0), (1, 1)]
    assert M.assignment([9.0, 10.0], [0.0, 8.0, 16.0, 24.0]) == [1, 2]


def test_matching_against_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(60):
        p, r = np.sort(rng.integers(0, 20, 4)).tolist(), np.sort(rng.integers(0, 20, 3)).tolist()
        pairs = M.ordered_match(p, r, lambda a, b: abs(a - b) if abs(a - b) <= 3 else None)
        options = []
        for k in range(4):
            for x in itertools.combinations(range(4), k):
                for y in itertools.combinations(range(3), k):
                    gaps = [abs(p[i] - r[j]) for i, j in zip(x, y, strict=True)]
                    if all(g <= 3 for g in gaps):
                        options.append((-k, sum(gaps)))
        assert (-len(pairs), sum(abs(p[i] - r[j]) for i, j in pairs)) == min(options)


def test_edit_distance():
    tree = lambda rows: postorder([(d, 0, x) for d, x in rows])
    a = tree([(0, "r"), (1, "a"), (2, "b"), (1, "c")])
    assert K.edit_distance(a, a) == 0
    assert K.edit_distance(a, tree([(0, "r"), (1, "a"), (1, "c")])) == 1
    assert K.edit_distance(a, tree([(0, "x"), (1, "a"), (2, "b"), (1, "c")])) == 1
    assert K.edit_distance(a, []) == 4


def test_forms_and_brackets():
    events = forms.form_events("p", "measure,beat,l1\n1,1,A,x\n3,,,y\n10-13=1-4,,\n11,1,Z\nbad,1,q\nRepeat: 1-20,,\n")
    placed = {(m, level): (label, how, source) for _, m, _, level, label, how, source, _, issue in events if issue is None}
    assert placed[10, 1] == ("A", "copy", 1) and placed[10, 2] == ("x", "copy", 1) and placed[12, 2] == ("y", "copy", 3)
    assert placed[11, 1] == ("Z", "explicit", None)
    assert [r[-1] for r in events if r[-1]] == ["line 5: 'bad' names no measure"] and events[0][7] == 20
    tree = forms.form_tree("p", [(1, 1, "A"), (1, 2, "a"), (5, 2, "b"), (9, 1, "B")], 12)
    assert [(r[4], r[2], r[5], r[6]) for r in tree] == [("ROOT", None, 1, 12), ("A", 0, 1, 8), ("a", 1, 1, 4), ("b", 1, 5, 8), ("B", 0, 9, 12)]
    rows = forms.brackets("p", "[Exp [S~I [Th.i 4 4] [Th.ii 4]] [Tr 4]]")
    assert [(r[2], r[4]) for r in rows] == [(None, "Exp"), (0, "S~I"), (1, "Th.i"), (2, "4"), (2, "4"), (1, "Th.ii"), (5, "4"), (0, "Tr"), (7, "4")]
    with pytest.raises(ValueError):
        forms.brackets("p", "[a")


def test_blocked_split_is_seeded_and_complete():
    works = [f"w{i}" for i in range(16)]
    a = blocked_split(works, (10, 3, 3), 20260727)
    assert a == blocked_split(works[::-1], (10, 3, 3), 20260727)
    assert sorted(sum(a, [])) == sorted(works) and [len(x) for x in a] == [10, 3, 3]
