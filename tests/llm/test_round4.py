"""Findings of round 4: F1, near copies that are no links in op1."""

import random

import pytest

pytest.importorskip("folioquery.llm")
np = pytest.importorskip("numpy")

from folioquery.llm import ngram_join as J  # noqa: E402


def linked(a, b):
    return 100 * len(a & b) >= 75 * len(a | b)


def near_copies(r, base, count, most):
    """Sets of base with parts left out and others put in, beginnings of base, and base itself twice."""
    found = [set(base) - set(r.sample(base, r.randrange(most))) | set(r.sample(range(10**6), r.randrange(most))) for _ in range(count)]
    return [sorted(x) for x in found] + [base[:k] for k in range(1, len(base), 1 + len(base) // 9)] + [base, base]


@pytest.mark.parametrize("edges, table", [(255, 32 << 20), (3, 32 << 20), (16, 2000)])
def test_all_walkers_of_a_block_find_their_links(monkeypatch, edges, table):
    monkeypatch.setattr(J, "EDGES", edges)
    monkeypatch.setattr(J, "TABLE", table)
    r = random.Random(3)
    for size, apart in ((8, 2), (80, 5), (80, 90), (600, 90)):
        sets = near_copies(r, sorted(r.sample(range(10**6), size)), 50, 2 + size // 4)
        own = np.array([r.randrange(apart) for _ in sets])
        tree = J.Branches(sorted((np.array(s, ">u8").tobytes(), k, int(own[k])) for k, s in enumerate(sets)))
        got = {(i, int(w)) for i, _, found in tree.walk([np.array(s, np.uint64) for s in sets], own, np.arange(apart)) for w in found}
        assert got == {(i, w) for i, a in enumerate(sets) for w, b in enumerate(sets) if own[i] != own[w] and linked(set(a), set(b))}


def test_a_chain_of_sets_may_be_deeper_than_the_call_stack():
    sets = [list(range(k)) for k in range(1, 2000)]
    tree = J.Branches(sorted((np.array(s, ">u8").tobytes(), k, k) for k, s in enumerate(sets)))
    walker = np.arange(1990, dtype=np.uint64)
    got = {i for i, _, _ in tree.walk([walker], np.array([1999]), np.arange(2000))}
    assert got == {k for k, s in enumerate(sets) if 4 * len(s) >= 3 * len(walker) and 3 * len(s) <= 4 * len(walker)}


def test_unlinked_near_copies_are_not_joined_ngram_by_ngram(spark, monkeypatch):
    """Copies of a template, most of them too far apart, beyond FAMILY: each moves once for each block of the family, not of each n-gram."""
    r, base, texts = random.Random(4), [f"t{k}" for k in range(120)], []
    for k in range(150):
        words = list(base)
        for _ in range(r.randrange(2, 9)):
            words[r.randrange(len(words))] = f"e{k}x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert sum(root[i] == i for i in range(len(texts))) > 20
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "FAMILY", 64)
    monkeypatch.setattr(J, "TURNS", 0)
    copies, blocks = [], J.in_blocks

    def counted(rows):
        out = J.written(blocks(rows), "counted")
        copies.append(out.count())
        return out

    monkeypatch.setattr(J, "in_blocks", counted)
    got = {x.doc_id: x.component_id for x in J.ngram_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == root
    assert sum(copies) <= len(texts) * -(-len(texts) // 16), copies
