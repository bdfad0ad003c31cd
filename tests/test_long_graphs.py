"""Betweenness where path counts pass any float."""

import numpy as np
import pytest

from terraloom.operators import network as nw


def diamonds(k):
    """A chain of k diamonds: node 3 i is a cut, 3 i + 1 and 3 i + 2 lie between it and the next."""
    pairs = [e for i in range(k) for m in (1, 2) for e in ((3 * i, 3 * i + m), (3 * i + m, 3 * i + 3))]
    return 3 * k + 1, pairs


def test_counts_of_a_long_graph_do_not_overflow():
    n, pairs = diamonds(1100)
    src, dst = np.array([p for a, b in pairs for p in ((a, b), (b, a))]).T
    order = np.lexsort((dst, src))
    start = np.append(0, np.cumsum(np.bincount(src, minlength=n)))
    got = nw._dependencies(start, dst[order], n, np.array([0]))
    cuts = np.arange(3, n - 1, 3)
    assert np.allclose(got[cuts], n - 1 - cuts) and np.allclose(got[cuts - 1], (n - 1 - cuts + 1) / 2)


@pytest.mark.parametrize("full", [2.0**900, 8.0])
def test_far_apart_counts(monkeypatch, full):
    """A plain path as long as a chain of diamonds: one path beside very many, at the same hop."""
    k = 30
    n, pairs = diamonds(k)
    line = [0, *range(n, n + 2 * k - 1), n - 1]
    pairs = pairs + list(zip(line, line[1:]))
    m = n + 2 * k - 1
    src, dst = np.array([p for a, b in pairs for p in ((a, b), (b, a))]).T
    order = np.lexsort((dst, src))
    start = np.append(0, np.cumsum(np.bincount(src, minlength=m)))
    want = nw._dependencies(start, dst[order], m, np.arange(m))
    monkeypatch.setattr(nw, "_FULL", full)
    got = nw._dependencies(start, dst[order], m, np.arange(m))
    # from the first node, the last is reached by 2 ** k paths over the diamonds and one along the line
    own = nw._dependencies(start, dst[order], m, np.array([0]))
    assert np.allclose(got, want) and own[n] == pytest.approx(2 * k - 2 + 1 / (2**k + 1))


def test_scaled_counts_in_tables(spark, monkeypatch):
    n, pairs = diamonds(6)
    nodes, edges = spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(pairs, "src long, dst long")
    want = {r.node: r.betweenness for r in nw.betweenness(nodes, edges).collect()}
    monkeypatch.setattr(nw, "_FULL", 4.0)
    monkeypatch.setattr(nw, "materialize", lambda df: df.localCheckpoint())
    got = {r.node: r.betweenness for r in nw.betweenness(nodes, edges, local_edges=0).collect()}
    assert got == pytest.approx(want)
