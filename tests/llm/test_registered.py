"""The registered queries over whole tables: their contracts' columns, held-out accuracy, and brute force."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import tokenizers
from conftest import DATA

from lumenweir.llm import line_dedup, packing, queries, simhash

LARGER, LARGEST = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def rows(name, sf_dir=DATA):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def area(scores, labels):
    """The share of pairs of a row of label 1 and one of label 0 that the scores put in order; ties count half."""
    scores, labels = np.asarray(scores), np.asarray(labels)
    one, zero = scores[labels == 1][:, None], scores[labels == 0][None, :]
    return ((one > zero) + 0.5 * (one == zero)).mean()


@pytest.mark.parametrize(("name", "label", "n", "out", "cut", "sf_dir"), [("op1_quality_classifier", "quality", 4, 2, 0.7, LARGER), ("op8_toxicity", "toxic", 5, 0, 0.5, LARGEST)])
def test_classifiers(spark, name, label, n, out, cut, sf_dir):
    got = {r["doc_id"]: r for r in queries.queries()[name](spark, sf_dir).collect()}
    docs, labels = {r["doc_id"] for r in rows("documents", sf_dir)}, {r["doc_id"]: r[label] for r in rows("labels", sf_dir)}
    assert set(got) == docs and {"doc_id", "held_out", "score", "predicted"} <= set(next(iter(got.values())).asDict())
    for i, r in got.items():
        assert r["held_out"] == (remainder(i, n) == out) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    held = [i for i in labels if i in got and got[i]["held_out"]]
    measured = area([got[i]["score"] for i in held], [labels[i] for i in held])
    assert measured > 0.9, measured


def test_language(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op4_language_id"](spark, LARGER).collect()}
    docs = {r["doc_id"]: r for r in rows("documents", LARGER)}
    assert set(got) == set(docs)
    learned = {d["lang"] for d in docs.values() if d["lang"]}
    for i, r in got.items():
        assert r["held_out"] == (remainder(i, 3) == 1) and 0 <= r["score"] <= 1 and r["lang_pred"] in {*learned, "und"}
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[i]["text"] or ""))
    held = [i for i in got if got[i]["held_out"] and got[i]["lang_pred"] != "und"]
    assert np.mean([got[i]["lang_pred"] == docs[i]["lang"] for i in held]) > 0.95


def test_simhash_query(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op2_simhash_near_dedup"](spark, DATA).collect()}
    docs = {r["doc_id"]: r["text"] for r in rows("documents")}
    prints = {i: simhash.fingerprint(None if t is None else t.encode()) for i, t in docs.items()}
    root = {i: i for i in docs}
    for _ in docs:  # least ids spread along links until nothing changes
        before = dict(root)
        for i in docs:
            for j in docs:
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    root[i] = min(root[i], root[j])
        if root == before:
            break
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{v:016x}" for i, v in prints.items()}


def test_line_dedup_query(spark):
    """A document keeps just the lines that no earlier one has in a run of eight words or more."""
    from test_llm_operators import _brute_line_dedup

    docs = sorted(((r["doc_id"], r["text"]) for r in rows("documents")), key=lambda x: x[0])
    got = {r["doc_id"]: r["text"] for r in queries.queries()["op10_line_dedup"](spark, DATA).collect()}
    assert [got[i] for i, _ in docs] == _brute_line_dedup(docs, line_dedup.MIN_WORDS)


def test_packing_query(spark):
    got = queries.queries()["op3_best_fit_packing"](spark, DATA).toPandas()
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.length.sum() <= 2048 and (part.offset == part.length.cumsum() - part.length).all()
    for _, part in got.sort_values("piece").groupby("doc_id"):
        assert part.piece.tolist() == list(range(len(part))) and (part.start == part.length.cumsum() - part.length).all() and (part.length[:-1] == 2048).all()
    docs, own = {r["doc_id"]: r["text"] for r in rows("documents")}, tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    assert set(got.doc_id) == set(docs)
    for i, part in got.sort_values("piece").groupby("doc_id"):
        ids = np.array([*own.encode(docs[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert part.length.sum() == len(ids) and part.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 2048].tobytes()) for k in range(0, len(ids), 2048)]


def test_fingerprint_query(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op6_document_fingerprints"](spark, DATA).collect()}
    docs = sorted((r["doc_id"], r["text"] or "") for r in rows("documents"))
    by_text = {}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        r, half = got[i], len(t) // 2
        assert r["n_chars"] == len(t) and by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        edited = t[: len(t) - half] + after[:half]
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == edited) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_next"] == 1) == (t == after)
        if len(t) > 200 and len(edited) == len(t):
            assert 0.4 <= r["near_edited"] <= 0.7 or t == edited  # half of the text is as it was
