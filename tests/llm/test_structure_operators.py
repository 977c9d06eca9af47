"""Neighbours by collisions, periodic runs and conversation tries against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collisions, periodic, queries, turntrie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROOT_HASH = hashlib.sha256(b"").hexdigest()


# --- neighbours by collisions


def brute_neighbours(rows, k):
    ok = {}
    for key, v in rows:
        if key is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[(key, tuple(v))] = np.array(v, float)
    out = {}
    for (q, qv), a in ok.items():
        if q % 20 == 0:
            near = sorted((-float(np.dot(a, b)), key) for (key, v), b in ok.items() if key != q and len(v) == len(qv))
            out[q, qv] = [(key, -s) for s, key in near[:k]]
    return out


def vectors(n=1500, dims=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    rows = [(i, (rng.standard_normal(dims) * (1 + i % 3) + (centres[i % 6] if i % 2 else 0)).astype(np.float32).tolist()) for i in range(n)]
    hub = rows[40][1]
    rows += [(n + i, hub) for i in range(n // 2)]  # a third of all rows are copies
    rows += [(5000, None), (5020, [0.0] * dims), (5040, [float("nan")] * dims), (5060, [None] + [1.0] * (dims - 1)), (None, hub), (5080, [])]
    rows += [(6000 + i, [1.0, float(i), 2.0]) for i in range(60)] + [(7000, [1.0])] + [rows[7], rows[20], rows[20]]
    return rows


def test_neighbours_match_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("score", F.lit(1)).withColumn("id", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in collisions.nearest(df, F.col("id") % 20 == 0, 20, block_rows=700).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    expected = {q: near for (q, _), near in brute_neighbours(rows, 20).items()}
    known = {key: np.array(v, float) for key, v in rows if v and key is not None}
    assert set(got) == {q for q, near in expected.items() if near}
    found = total = 0
    for q, near in got.items():
        assert [x[0] for x in near] == list(range(1, len(near) + 1)) and len(near) == len(expected[q])
        assert [(-s, key) for _, key, s in near] == sorted((-s, key) for _, key, s in near)
        assert all(abs(s - float(known[q] @ known[key])) < 1e-9 * max(1, abs(s)) and key != q for _, key, s in near)
        found += len({key for _, key, _ in near} & {key for key, _ in expected[q]})
        total += len(near)
    assert found / total >= 0.95
    # equal scores come by the smaller id: copies of the hub
    hub = [key for _, key, s in got[40]][:20]
    if len({s for _, _, s in got[40]}) == 1:
        assert hub == sorted(hub)


def test_neighbours_of_few_and_no_rows(spark):
    kind = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])], kind)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in collisions.nearest(few, F.col("id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 2, 5.0), (0, 2, 1, 4.0)]
    assert collisions.nearest(spark.createDataFrame([], kind), F.col("id") % 20 == 0).count() == 0
    assert collisions.nearest(spark.createDataFrame([(0, [1.0])], kind), F.col("id") % 20 == 0).count() == 0


def test_slabs_of_queries_change_nothing(spark):
    df = spark.createDataFrame(vectors(400), "vec_id long, embedding array<float>")
    every = F.col("id") % 2 == 0  # so many queries that they are dealt out in slabs
    few, many = (collections.Counter(map(tuple, collisions.nearest(df, every, 5, block_rows=n).collect())) for n in (10_000, 60))
    assert sum((few & many).values()) >= 0.9 * sum(few.values()) and sum(few.values()) == sum(many.values())


def test_recall_on_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    expected = {q: {key for key, _ in near} for (q, _), near in brute_neighbours(rows, 20).items()}
    got = collections.defaultdict(set)
    for r in queries.op11_collision_neighbours(spark, "/root/testdata/sf0.01").collect():
        got[r.query_id].add(r.vec_id)
    assert set(got) == set(expected)
    assert sum(len(got[q] & near) for q, near in expected.items()) >= 0.95 * sum(map(len, expected.values()))


# --- periodic runs


def brute_runs(words, repeats=4, least=6):
    out = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            begin = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i - begin + q
            if i > begin and size >= max(least, repeats * q):
                out.setdefault((begin, size), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_rows(seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        vocabulary = [f"w{k}" for k in range(rng.choice([1, 2, 3, 8, 60]))]
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.6 and len(w) > 8:
            a = rng.randrange(len(w))
            p = 1 + (len(w) - a) // rng.choice([3, 4, 5, 6, 9])
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "a " * 5), (904, "a " * 6), (905, "a b " * 30_000), (None, "x y " * 5), (3, rows[3][1]), (906, " é " * 7)]
    return rows


@pytest.mark.parametrize("repeats, least", [(4, 6), (2, 2), (3, 5)])
def test_runs_match_brute_force(spark, repeats, least):
    rows = [(k, t) for k, t in periodic_rows() if t is None or len(t) < 50_000 or repeats == 4]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("runs", F.lit("clash")).withColumn("start", F.lit(0))
    expected = collections.Counter()
    for key, text in rows:
        w = WORD.findall(text or "")
        runs = [(0, 60_000, 2)] if key == 905 else brute_runs(w, repeats, least)
        expected[key, len(w), tuple(sorted(runs, key=lambda r: (r[0], r[2]))), collapsed(w, runs)] += 1
    got = collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(df, repeats, least).collect())
    assert got == expected
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_period_query_matches_brute_force(spark, tmp_path):
    rows = periodic_rows(5)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    expected = collections.Counter()
    for key, text in rows:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = sorted([(0, 60_000, 2)] if key == 905 and h % 10 else brute_runs(w), key=lambda r: (r[0], r[2]))
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        said = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        expected[key, len(runs), *best, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect())) == expected


def test_ends_stay_in_order_over_parts():
    ends, rng = periodic.Ends(0), random.Random(1)
    for e in rng.sample(range(1, 50_000), 9000):
        before, after = ends.add(e)
        assert before is not None and before < e and (after is None or e < after)
    assert list(ends) == sorted(ends) and ends.size == 9001


# --- conversation tries


def plain_trie(paths):
    """Nodes of {conv_id: [(role, text), ...]} by plain prefixes."""
    members = collections.defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = collections.Counter()

    def below(p):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        parts = [below(x) for x in children[p]]
        sums = sum(x[0] for x in parts) or 1, own + sum(x[1] for x in parts)
        ended = sorted(c for c in members[p] if len(paths[c]) == len(p))
        digest = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()
        out[min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), *sums, digest] += 1
        return sums

    if paths:
        below(())
    return out


def turns_of(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), digest, (r, t)))
    return {c: [t for _, _, t in sorted(x)] for c, x in convs.items()}


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = []
    for c in range(260):
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn, rng.choice(["user", None]), rng.choice(["hé", "yes", "no", None, ""])))
    hub = [(t, "user" if t % 2 else "bot", f"turn {t}") for t in range(30)]
    rows += [(1000 + i, *t) for i in range(120) for t in hub]  # copies
    rows += [(2000 + i, *t) for i in range(90) for t in hub[: i % 30]] + [(2000 + i, 40, "user", f"end {i % 7}") for i in range(90)]
    rows += [(3000, None, "a", "null turn first"), (3000, 1, "a", "b"), (3001, 1, "tie", "x"), (3001, 1, "tie", "w"), (3002, 5, "a", "é" * 5000), (None, 0, "x", "y"), (-7, 0, "bot", "turn 0"), (-5, 0, "bot", "turn 0")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [10**6, 40, 3])
def test_trie_matches_plain_prefixes(spark, talks, limit):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash")).withColumn("key", F.lit(1))
    got = turntrie.trie(turntrie.turn_paths(df), limit)
    assert collections.Counter(map(tuple, got.collect())) == plain_trie(turns_of(talks))


def test_trie_of_little(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert turntrie.trie(turntrie.turn_paths(spark.createDataFrame([], kind))).count() == 0
    empty = spark.createDataFrame([(1, None), (2, None)], "conv_id long, path array<struct<digest: binary, bytes: bigint>>")
    assert [tuple(r) for r in turntrie.trie(empty).collect()] == [(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,2").hexdigest())]


def test_trie_query_matches_plain_rebuilding(spark, talks, tmp_path):
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(2).write.parquet(str(tmp_path / "conversations.parquet"))
    own = turns_of(talks)
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    assert collections.Counter(map(tuple, queries.op13_prefix_trie(spark, str(tmp_path)).collect())) == plain_trie(rebuilt)
