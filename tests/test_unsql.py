"""Registered queries that no statement is held against: brute force over the same tables."""

import re

import pyarrow.parquet as pq
import pytest
from conftest import DATA
from test_linking import components

from lumenweir.operators.structure import clean_passage
from lumenweir.plans import catalog, graph_queries


def docs(sf_dir=DATA):
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("sf_dir", [DATA, "/root/testdata/sf0.01"])
def test_near_duplicates(spark, sf_dir):
    """No link below the measure; of pairs at it or above, all are joined (bands miss one in 20,000 at the measure itself)."""
    sets = {i: shingles(t) for i, t in docs(sf_dir).items()}
    holders, met = {}, set()
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    for h in holders.values():
        met.update((a, b) for k, a in enumerate(h) for b in h[:k])
    links = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    true = components(sets, links)
    got = {r["doc_id"]: r["component_id"] for r in catalog.queries()["minhash_near_duplicates"](spark, sf_dir).collect()}
    assert set(got) == set(sets) and all(true[i] == true[c] for i, c in got.items())
    joined = sum(got[a] == got[b] for a, b in links)
    assert links and joined >= 0.999 * len(links), (joined, len(links))


def test_diversified(spark):
    """The pool's rows picked one by one: the largest of 0.7 x score less 0.3 x the likeness to what is picked."""
    texts = docs()
    pool = {}
    for r in graph_queries._sparse(spark, DATA, 20).collect():
        pool.setdefault(r["query"], []).append((r["id"], r["score"]))
    want = set()
    for q, rows in pool.items():
        words = {i: set(re.findall(r"[^\s]+", texts[i].lower())) for i, _ in rows}
        picked, left = [], sorted(rows, key=lambda x: (-x[1], x[0]))
        while left and len(picked) < 5:
            like = lambda i: max((len(words[i] & words[p]) / len(words[i] | words[p]) for p in picked), default=0.0)  # noqa: B023, E731
            best = max(left, key=lambda x: 0.7 * x[1] - 0.3 * like(x[0]))
            picked.append(best[0])
            left.remove(best)
        want |= {(q, i, k) for k, i in enumerate(picked, 1)}
    got = {(r["query"], r["id"], r["place"]) for r in catalog.queries()["mmr_results"](spark, DATA).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got) == len(want)  # ties of rounded scores


def test_changed_chunks(spark):
    want = {(i, len(t), len(c)) for i, t in docs().items() if (c := clean_passage(t)) != t and len(c) >= 10}
    assert {tuple(r) for r in catalog.queries()["changed_chunks"](spark, DATA).collect()} == want and want


def test_sentence_chunks(spark):
    """Chunks hold whole sentences in order, each but the first begins with the last sentence of the one before, none grows past its size by more than that."""
    texts = docs()
    rows = {}
    for r in catalog.queries()["document_chunks"](spark, DATA).collect():
        rows.setdefault(r["doc_id"], []).append((r["chunk"], r["text"]))
    for i, t in texts.items():
        parts = [s.strip() for s in re.split(r"\n+", re.sub(r"([.!?])\s+", r"\1\n", t)) if s.strip()]
        chunks = [x for _, x in sorted(rows.get(i, []))]
        assert bool(parts) == bool(chunks)
        at, last = 0, None
        for c in chunks:
            if last is not None and c.startswith(parts[last] + " "):
                c = c[len(parts[last]) + 1 :]
            while c:
                assert c.startswith(parts[at]), (i, c[:50], parts[at][:50])
                c = c[len(parts[at]) :].removeprefix(" ")
                last = at
                at += 1
        assert at == len(parts)
