import datetime as dt
import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_linking import components

from lumenweir.functions import queries as q
from lumenweir.functions import scores as s
from lumenweir.functions import text as t
from lumenweir.operators import access, analytics, chunking, documents, graph, near_duplicates, retrieval
from lumenweir.operators.components import connected_components
from lumenweir.plans import catalog
from lumenweir.sources import files
from lumenweir.streaming import state


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_mask_pii(spark):
    got = one(spark, t.mask_pii(F.col("a")), a="call 010-1234-5678 or 019 123 4567, card 1234-5678-9012-3456, id 900101-1234567, x.y@mail.example.com")
    assert got == "call [PHONE] or [PHONE], card [CARD], id [SSN], [EMAIL]"
    assert one(spark, t.mask_pii(F.col("a")), a="메일 user@x.com 또는 값user@x.co.kr") == "메일 [EMAIL] 또는 [EMAIL]"


def test_text_functions(spark):
    assert one(spark, t.squeezed(F.col("a")), a="  a \n\t b ") == "a b"
    assert one(spark, t.tokens(F.col("a")), a=None) == []
    assert one(spark, t.word_shingles(F.col("a")), a="A b") == ["a b"]
    assert one(spark, t.script_language(F.col("a")), a="회의 회의록 ok") == "ko"
    assert one(spark, t.normalized_term(F.col("a")), a=" Open_API  Key- ") == "open-api-key"
    assert one(spark, t.initials(F.col("a")), a="key performance indicator") == "KPI"
    assert one(spark, t.lexical_score(F.col("a"), F.col("b")), a="same", b="Same ") == 1.0
    assert one(spark, t.lead_summary(F.col("a")), a="가" * 60 + "다. " + "x" * 200) == "가" * 60 + "다."
    assert one(spark, t.lead_summary(F.col("a")), a="One. " + "x" * 300) == "One. " + "x" * 195
    assert one(spark, t.lead_summary(F.col("a")), a=" short ") == "short"
    assert one(spark, t.content_hash(F.col("a")), a="X\n\u3000") == one(spark, t.content_hash(F.col("a")), a="x")
    assert one(spark, t.specificity(F.col("a")), a="API api key") == pytest.approx(0.4 + 0.3 * 0.3 + 0.3)
    assert one(spark, t.clean_for_embedding(F.col("a")), a="<p>a\x00  b</p>\n\n\n\nc ") == "a b\n\nc"
    assert one(spark, t.truncated(F.col("a"), 3), a="abcdef") == "abc..."


def test_scores(spark):
    assert one(spark, s.wilson(F.col("a"), F.col("b")), a=0, b=0) == 0.5
    assert one(spark, s.exponential_freshness(F.col("a"), F.lit(10.0)), a=1000) == 0.1
    assert one(spark, s.step_freshness(F.lit(None).cast("int")), a=1) == 0.5
    assert one(spark, s.cosine_freshness(F.col("a"), F.lit(100.0)), a=100) == 0.0
    assert one(spark, s.crag_action(F.lit(0.9), F.col("a")), a=0) == "incorrect"
    assert [one(spark, s.tier(F.col("a")), a=x) for x in (85, 70, 50, 49)] == ["high", "medium", "low", "uncertain"]


def test_query_functions(spark):
    kind = lambda x: tuple(one(spark, q.classified(F.col("a")), a=x))
    assert kind("안녕하세요")[0] == "chitchat"
    assert kind("A 와 B 차이가 뭐야")[0] == "comparative"
    assert kind("먼저 A 다음 B, 담당자는")[0] == "multi_hop"
    assert kind(" ") == ("unknown", 0.0)
    assert kind("something") == ("factual", 0.5)
    assert one(spark, q.date_tokens(F.col("a")), a="2024.01.31 and 2024/13/01 and 1999-12-01") == ["2024-01-31", "1999-12-01"]


def test_first_seen_and_gate(spark):
    rows = spark.createDataFrame([(1, "x" * 600 + " a b c d e f g h i j"), (2, "x" * 600 + " a b c d e f g h i j"), (3, ""), (4, "short"), (5, "Deprecated " + "word " * 120), (6, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in documents.gate_action(documents.first_seen(documents.gate_checks(rows).withColumn("sha", F.sha2("text", 256)), "sha")).collect()}
    assert got[1]["action"] == "proceed" and got[2]["duplicate_of"] == 1 and got[2]["action"] == "reject"
    assert len(got) == 6 and got[6]["action"] == "reject"
    assert got[3]["ig03"] == "fail" and got[4]["ig12"] == "fail" and got[5]["action"] == "hold" and got[6]["ig03"] == "fail"


def test_quality_score(spark):
    metrics = dict(has_tables=True, has_code=False, has_headers=True, has_images=False, has_links=False)
    assert one(spark, documents.quality_score(F.lit("SILVER")), content_length=5000, **metrics) == 86.0
    assert one(spark, documents.quality_score(F.lit("NOISE")), content_length=0, **dict.fromkeys(metrics, False)) == 0.0
    assert one(spark, documents.quality_score(F.lit("NOISE")), content_length=None, **metrics) == 50.0


def test_idempotency_window(spark):
    rows = spark.createDataFrame([(i, "k", s) for i, s in enumerate((0, 50, 60, 70, 120, 131))], "id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    kept = analytics.first_in_window(rows, ["key"], "ts", "id", 60)
    assert sorted(r["s"] for r in kept.collect()) == [0, 70, 131]


def test_sentence_groups_and_sections(spark):
    rows = spark.createDataFrame([(1, "Aa bb. Cc dd. Ee ff."), (2, None), (3, "")], "doc_id long, text string")
    assert [r["text"] for r in chunking.chunks(rows, 13).orderBy("chunk").collect()] == ["Aa bb. Cc dd.", "Cc dd. Ee ff."]
    rows = spark.createDataFrame([(1, "# A\nx\n### C\ny\n## B\nz")], "doc_id long, text string")
    assert [r["heading_path"] for r in chunking.heading_sections(rows).orderBy("section").collect()] == ["A", "A > C", "A > B"]


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(200)]
    edited = [*base[:100], "new", *base[101:]]
    rows = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(base)), (4, " ".join(reversed(base))), (5, None), (6, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(rows).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert near_duplicates.near_duplicates(rows.limit(0)).count() == 0


def test_near_duplicates_brute(spark):
    """Near copies of a few texts, with up to four words replaced: around a measure of 0.8."""
    rng = np.random.default_rng(3)
    texts = []
    for base in range(4):
        words = [f"w{base}x{k}" for k in rng.integers(0, 400, 120)]
        for _ in range(60):
            own = list(words)
            for at in rng.integers(0, 120, rng.integers(0, 5)):
                own[at] = f"n{rng.integers(0, 1 << 30)}"
            texts.append(" ".join(own))
    sets = [near_duplicates.shingles_of(t, 5) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    true = components(range(len(texts)), pairs)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = near_duplicates.signatures(rows).withColumnRenamed("doc_id", "rep")
    for most in (16, 2048):
        found = near_duplicates.links(sigs.dropDuplicates(["sig"]), rows, most=most).collect()
        assert all(true[a] == true[b] for a, b in found)  # nothing but pairs of the measure joins
        sig_of = {r["rep"]: r["sig"] for r in sigs.collect()}
        rep = {s: i for i, s in sorted(sig_of.items(), reverse=True)}
        root = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(found, "a long, b long")).collect()}
        same = [root.get(rep[sig_of[i]], rep[sig_of[i]]) == root.get(rep[sig_of[j]], rep[sig_of[j]]) for i, j in pairs]
        assert len(pairs) > 500 and sum(same) >= 0.98 * len(pairs)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (102, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_graph(spark):
    edges = graph.both_ways(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e")], "src string, dst string"))
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["distance"]) for r in graph.neighbours(edges, seeds, 2).collect()} == {("b", 1), ("e", 1), ("c", 2)}
    path = graph.shortest_paths(edges, seeds, spark.createDataFrame([("d",)], "node string")).first()
    assert path["path"] == ["a", "b", "c", "d"]
    assert [r["node"] for r in graph.orphans(spark.createDataFrame([("a",), ("z",)], "node string"), edges).collect()] == ["z"]


def test_retrieval(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [])], "id long, vec array<float>")
    found = retrieval.dense_top_k(rows.where("id = 1").toDF("query", "vec"), rows, 2)
    assert [(r["id"], r["rank"]) for r in found.orderBy("rank").collect()] == [(1, 1), (3, 2)]
    pool = spark.createDataFrame([(1, 1, 0.9, ["a", "b"]), (1, 2, 0.89, ["a", "b"]), (1, 3, 0.8, ["c"])], "query long, id long, score double, words array<string>")
    assert [r["id"] for r in retrieval.mmr(pool, 2).orderBy("place").collect()] == [1, 3]
    assert retrieval.dense_top_k(rows.where("id > 9").toDF("query", "vec"), rows, 2).count() == 0


def test_rate_limit(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([("k", i, at(s)) for i, s in enumerate((0, 10, 20, 30, 61, 62))], "k string, id long, ts timestamp_ntz")
    assert [r["allowed"] for r in analytics.allowed_by_rate(rows, "k", "ts", "id", 2, 60).orderBy("id").collect()] == [True, True, False, False, True, False]


def test_streak(spark):
    rows = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "bad"), ("a", 3, "bad"), ("b", 1, "bad"), ("c", 5, "ok")], "k string, t int, s string")
    got = {r["k"]: r["streak"] for r in analytics.failure_streak(rows, "k", ["t"], F.col("s") == "bad").collect()}
    assert got["a"] == 2 and got["b"] == 1 and got["c"] == 0


def test_access(spark):
    rows = spark.createDataFrame([("doc", "read", "kr"), ("doc", "write", "kr"), ("doc", "read", None)], "resource string, action string, region string")
    policies = [{"resource": "doc", "action": "read", "effect": "allow", "conditions": [("region", "eq", "kr")]}]
    assert [r["effect"] for r in access.evaluated(rows, policies).collect()] == ["allow", "deny", "deny"]
    assert one(spark, access.valid_transition(F.col("a"), F.col("b")), a="draft", b="review") is True


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("가나".encode("euc-kr"))
    (tmp_path / "b.txt").write_bytes(b"plain")
    now = files.scan(spark, str(tmp_path), "*.txt")
    assert sorted(r["x"] for r in now.select(files.decoded(F.col("content")).alias("x")).collect()) == ["plain", "가나"]
    before = now.select("path", "sha256").where("path like '%b.txt'").withColumn("sha256", F.lit("old")).union(spark.createDataFrame([("gone", "x")], "path string, sha256 string"))
    assert sorted(r["change"] for r in files.changes(now, before).collect()) == ["changed", "deleted", "new"]
    (tmp_path / "p.jsonl").write_text('{"doc_id": "1", "text": "a"}\n{"doc_id": "1", "text": "b"}\n{"doc_id": "2", "te')
    assert [(r["doc_id"], r["text"]) for r in files.parsed_documents(spark, str(tmp_path / "p.jsonl")).collect()] == [("1", "b")]
    got = one(spark, files.front_matter(F.col("a")), a="---\ntitle: A: b\nowner: x\n---\nbody")
    assert got["meta"] == {"title": "A: b", "owner": "x"} and got["body"] == "body"


def test_html(spark):
    page = "<h1>T &amp; U</h1><p>a</p><table><tr><th>x</th><th>y|z</th></tr><tr><td>1</td><td>2</td></tr></table><a href='/q'>l</a><script>no()</script><pre>c</pre>"
    rows = spark.createDataFrame([(page,), (None,)], "html string").select(files.html_parts(F.col("html")).alias("p")).select("p.*", files.table_markdown(F.coalesce(F.get("p.tables", F.lit(0)), F.array().cast("array<array<string>>"))).alias("md")).collect()
    assert rows[0]["headings"][0]["title"] == "T & U" and rows[0]["links"] == ["/q"] and "no()" not in rows[0]["text"] and rows[0]["code"] == ["c"]
    assert rows[0]["md"] == "| x | y\\|z |\n|---|---|\n| 1 | 2 |"
    assert rows[1]["text"] == ""


def test_streams(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    beats = spark.createDataFrame([("a", at(0)), ("b", at(1)), ("b", at(40))], "k string, ts timestamp")
    beats.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(beats.schema).parquet(str(tmp_path / "in"))
    run = state.heartbeat_states(stream, "k", "ts").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r["k"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got >= {("a", "online"), ("b", "online"), ("a", "offline")} and ("b", "offline") not in got


def _links_of(spark):
    """(src, dst) of two kinds of nodes that share numbers; repeated and null ones too."""
    rng = random.Random(5)
    rows = [(rng.randrange(60), rng.randrange(25)) for _ in range(150)] + [(1, 2), (1, 2), (None, 3), (4, None)]
    return rows, spark.createDataFrame(rows, "src long, dst long")


def _hops(rows, start, side, hops):
    """{(side, node): distance} by breadth-first search."""
    seen, front = {(side, start): 0}, [(side, start)]
    for k in range(1, hops + 1):
        front = {("dst" if s == "src" else "src", r[s == "src"]) for s, n in front for r in rows if r[s == "dst"] == n and None not in r} - set(seen)
        seen |= dict.fromkeys(front, k)
    return {x: d for x, d in seen.items() if d}


def test_neighbours_across(spark):
    rows, edges = _links_of(spark)
    seeds = [1, 5, 9, 77]
    got = {}
    for r in graph.neighbours_across(edges, spark.createDataFrame([(i,) for i in seeds], "node long"), 3, 12).collect():
        assert (r["side"], r["node"]) not in got.setdefault(r["seed"], {})
        got[r["seed"]][r["side"], r["node"]] = r["distance"]
    whole = 0
    for i in seeds:
        want = _hops(rows, i, "src", 3)
        assert got.get(i, {}).items() <= want.items()
        order = sorted((d, x) for x, d in want.items())[:12]
        assert [x for _, x in order] == [x for _, x in sorted((d, x) for x, d in got.get(i, {}).items())][:12]
        whole += len(want) - len(got.get(i, {}))
    assert whole > 0  # a seed that has enough goes no farther


def test_reached_across(spark):
    rows, edges = _links_of(spark)
    for hops in (1, 2, 3, 5):
        want = {}
        for start in (3, 8):
            for (side, node), d in _hops(rows, start, "dst", hops).items():
                if side == "src":
                    want[node] = min(d, want.get(node, d))
        got = graph.reached_across(edges, spark.createDataFrame([(3,), (8,), (99,)], "node long"), hops).collect()
        assert {r["node"]: r["distance"] for r in got} == want and len(got) == len(want)


def test_shared_neighbours_follow_the_splits(spark):
    """Repeated edges count once; the tasks that hold edges are as many as the table's splits ask for."""
    rows, edges = _links_of(spark)
    nodes = spark.createDataFrame([(1,), (5,)], "node long")
    for splits in (2, 7):
        got = graph.shared_neighbours(edges.repartition(splits), nodes)
        want = {(a, b): len(x) for a in (1, 5) for b in {s for s, _ in rows} - {a, None} if (x := {d for s, d in rows if s == a} & {d for s, d in rows if s == b} - {None})}
        assert {(r["a"], r["b"]): r["shared"] for r in got.collect()} == want
        assert f", {16 * splits}" in got._jdf.queryExecution().optimizedPlan().toString()


def test_similar_by_shared_has_all_sources(spark):
    """Every source is held against all others, not only stated ones; repeated edges count once, nulls are no ends."""
    rows, edges = _links_of(spark)
    given = edges.union(spark.createDataFrame([(None, 1), (1, None), (None, None)], edges.schema))
    of = {a: {d for s, d in rows if s == a} - {None} for a in {s for s, _ in rows} - {None}}
    want = {(a, b): len(of[a] & of[b]) for a in of for b in of if a != b and of[a] & of[b]}
    got = graph.shared_by_all(given.repartition(5)).collect()
    assert {(r["a"], r["b"]): r["shared"] for r in got} == want and len(got) == len(want) > 0
    assert {r["a"] for r in catalog.queries()["similar_by_shared"](spark, DATA).collect()} == {r["l_suppkey"] for r in spark.read.parquet(f"{DATA}/lineitem.parquet").collect()}
