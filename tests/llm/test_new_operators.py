"""Periodic runs, suffix dedup and sharded clustering against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starsift.llm import lloyd, periodic, queries, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "long text with several words. " * 4000
ODD = [
    (1, None),
    (2, ""),
    (3, "  \n\t"),
    (4, "one"),
    (4, "one"),
    (5, "éà 日本語 \U0001f600 don't  x² y\x1c\x85z"),
    (6, LONG),
    (7, LONG),
    (None, "a row without id"),
    (None, None),
]
CLASHES = ["row", "runs", "words", "n", "h", "chunk", "bucket", "n_bytes", "n_removed", "spans", "kept", "id", "cluster", "distance", "block", "label"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, a repeated row, and columns with clashing names."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASHES})


# --- periodic runs ---------------------------------------------------------------------------------------------------


def runs_by_force(words: list[str]) -> list[tuple[int, int, int]]:
    """Every stretch that is maximal for some lag, with its smallest lag."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed_by_force(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@st.composite
def repetitive(draw):
    """Words of a few pieces, each repeated some times and perhaps cut short."""
    words: list[str] = []
    for _ in range(draw(st.integers(0, 4))):
        letters = draw(st.sampled_from(["a", "ab", "abcdefgh"]))
        piece = draw(st.lists(st.sampled_from(letters), min_size=1, max_size=70))
        some = piece * draw(st.sampled_from([1, 2, 4, 5, 9]))
        words += some[: len(some) - draw(st.integers(0, len(piece) - 1))]
    return words


@settings(max_examples=150, deadline=None)
@given(st.lists(repetitive(), min_size=1, max_size=4))
def test_runs_equal_brute_force(group):
    for words, (runs, kept) in zip(group, periodic._found(group), strict=True):
        assert runs == runs_by_force(words)
        assert " ".join(kept) == collapsed_by_force(words, runs)


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100, 129, 1000])
def test_every_scale_finds_its_periods(period):
    rng = random.Random(period)
    piece = [str(rng.random()) for _ in range(period)]
    around = [str(rng.random()) for _ in range(50)]
    n = max(6, 4 * period)
    words = around + (piece * 6)[:n] + around[::-1]
    (runs, _), (short, _) = periodic._found([words, around + (piece * 6)[: n - 1] + around[::-1]])
    assert runs == [(50, n, period)]
    assert short == []


def test_long_documents_are_searched_in_linear_steps():
    words = ["a", "b"] * 150_000
    ((runs, kept),) = periodic._found([words])
    assert runs == [(0, 300_000, 2)]
    assert kept == ["a", "b"]


def test_op13_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    found = queries.op13_periodic_runs(spark, sf).toPandas().set_index("doc_id")
    assert len(found) == len(docs)
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        words = WORDS.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_by_force(words)
        row = found.loc[doc_id]
        assert row["n_runs"] == len(runs)
        if runs:
            start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
            assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == (start, length, period, 1000 * length // period)
        else:
            assert row[["start", "length", "period", "exponent_milli"]].isna().all()
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed_by_force(words, runs).encode()).hexdigest()


def test_strongest_run_breaks_ties_by_start_and_period(spark):
    rows = spark.createDataFrame([(1, [(5, 8, 2), (9, 16, 4), (30, 8, 2)]), (2, [(0, 9, 2), (4, 27, 6), (8, 14, 3)]), (3, []), (4, None)], f"k int, runs {periodic.RUNS}")
    best = {r.k: r.best and tuple(r.best) for r in rows.select("k", periodic.strongest().alias("best")).collect()}
    assert best == {1: (5, 8, 2), 2: (8, 14, 3), 3: None, 4: None}


def test_periodic_odd_documents(spark, odd):
    found = periodic.periodic_runs(odd)
    rows = found.collect()
    assert len(rows) == len(ODD)
    assert sorted(r.n_words for r in rows) == sorted(len(WORDS.findall(t or "")) for _, t in ODD)
    assert [len(r.runs) for r in rows if r.n_words > 1000] == [1, 1]
    assert {r.collapsed for r in rows if r.n_words > 1000} == {"long text with several words."}
    assert periodic.periodic_runs(odd.limit(0)).collect() == []
    assert np.all([r.runs == [] for r in rows if not r.n_words])


# --- sharded clustering ----------------------------------------------------------------------------------------------


def lloyd_by_force(rows: list[tuple[int, list[float]]], k: int, rounds: int, scale: int) -> tuple[dict, np.ndarray]:
    x = np.array([[int(np.floor(scale * float(v))) for v in vector] for _, vector in rows], dtype=object)
    order = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest())
    c = x[order[:k]].copy()

    def nearest():
        apart = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        best = [min(range(len(c)), key=lambda j: (a[j], j)) for a in apart]
        return best, [a[j] for a, j in zip(apart, best, strict=True)]

    for _ in range(rounds):
        best, _ = nearest()
        for j in range(len(c)):
            own = [i for i, b in enumerate(best) if b == j]
            if own:
                c[j] = [int(s) // len(own) for s in x[own].sum(axis=0)]
    best, distance = nearest()
    return {rows[i][0]: (best[i], distance[i]) for i in range(len(rows))}, c


def start():
    return F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)


@pytest.mark.parametrize(("n", "dims", "k", "spread"), [(300, 40, 7, 1.0), (50, 16, 60, 3.0), (80, 3, 5, 100_000.0), (200, 17, 9, 0.01)])
def test_clusters_equal_brute_force(spark, n, dims, k, spread):
    rng = np.random.default_rng(n)
    rows = [(i, [float(v) for v in rng.normal(0, spread, dims)]) for i in range(n)]
    found, centroids = lloyd.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), start(), k, 4, dims, 256, chunk=32)  # several chunks of a task
    expected, c = lloyd_by_force(rows, k, 4, 256)
    assert {r.vec_id: (r.cluster, r.distance) for r in found.collect()} == expected
    assert {r.cluster: r.centroid for r in centroids.collect()} == {j: list(map(int, c[j])) for j in range(len(c))}


def test_op11_equals_brute_force_on_the_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding) for r in table if r.embedding is not None and len(r.embedding) == 64 and all(v is not None and np.isfinite(v) for v in r.embedding)]
    expected, c = lloyd_by_force(rows, 40, 5, 256)
    found = queries.op11_sharded_lloyd(spark, sf).collect()
    assert {r.vec_id: (r.cluster, r.distance) for r in found} == expected
    inertia = sum(d for _, d in expected.values())
    for r in found:
        assert r.inertia == inertia
        assert r.cluster_inertia == sum(d for j, d in expected.values() if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_op11_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    expected = con.execute(f"select {', '.join(names)} from ({queries.oracle_sql()['op11_sharded_lloyd']})").fetchall()
    assert sorted(map(tuple, queries.op11_sharded_lloyd(spark, sf).select(names).collect())) == sorted(expected)


def test_clusters_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.5]), (1, [0.0, 0.5]), (None, [0.25, -0.1]), (3, None), (4, [1.0]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [None, 0.0]), (8, []), (9, [1.0, 2.0, 3.0]), (2, [-1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in [*CLASHES, "point", "start", "valid", "part"]})
    found, centroids = lloyd.cluster(table, start(), 2, 3, 2, 256)
    assert sorted((r.vec_id or 0) for r in found.collect()) == [0, 1, 1, 2]
    assert centroids.count() == 2
    found, centroids = lloyd.cluster(table.limit(0), start(), 2, 1, 2, 256)
    assert found.collect() == centroids.collect() == []


def test_components_too_large_for_a_long_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="not below"):
        lloyd.cluster(rows, start(), 1, 1, 2, 256)


# --- suffix dedup ----------------------------------------------------------------------------------------------------


def removed_by_force(rows: list[tuple[int | None, str | None]], need: int = 50) -> list[tuple]:
    """(id, bytes, spans, kept) of each row."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, float] = {}
    for i, t in texts:
        for p in range(len(t) - need + 1):
            s = t[p : p + need]
            first[s] = min(first.get(s, float("inf")), float("inf") if i is None else i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - need + 1):
            if first[t[p : p + need]] < (float("inf") if i is None else i):
                gone[p : p + need] = b"\1" * need
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(t), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def passages(seed: int) -> list[tuple[int | None, str | None]]:
    """Texts made of shared passages, edits, copies, periodic stretches and few letters."""
    rng = random.Random(seed)
    pool = ["".join(rng.choices(rng.choice(["ab", "abcdefgh ", "aé日"]), k=rng.randint(20, 400))) for _ in range(12)]
    rows: list[tuple[int | None, str | None]] = [(None, pool[0] * 2), (7, None), (3, ""), (900, "short")]
    for i in rng.sample(range(1000), 60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a, z = sorted(rng.choices(range(len(p) + 1), k=2))
            parts.append(rng.choice([p, p[a:z], p[:a] + "#" + p[a + 1 :], "x" * rng.randint(0, 120), "".join(rng.choices("abcdefgh ", k=30))]))
        rows.append((i, "".join(parts)))
        if rng.random() < 0.2:
            rows.append((rng.choice([i, i + 1000]), "".join(parts)))
    return rows


SMALL = suffix_dedup.Sizes(chunk=3000, step=700, segment=7, hot=4096, range=2000)


@pytest.mark.parametrize(("seed", "sizes"), [(0, SMALL), (1, suffix_dedup.Sizes(chunk=1500, step=300, segment=5, hot=3, range=500)), (2, suffix_dedup.Sizes(chunk=9000, hot=0)), (3, suffix_dedup.Sizes())])
def test_removed_bytes_equal_brute_force(spark, seed, sizes):
    rows = passages(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix_dedup.without_repeats(docs, sizes=sizes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[2])
    got = [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found]
    assert sorted(got, key=key) == sorted(removed_by_force(rows), key=key)
    assert all(r.n_removed == r.n_bytes - len(r.kept) for r in found)
    assert sum(r.n_removed for r in found) > 1000


def test_op12_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = {i: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in removed_by_force([tuple(r) for r in docs])}
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op12_suffix_merge(spark, sf).collect()}
    assert found == expected


def test_suffixes_of_odd_documents(spark, odd):
    found = suffix_dedup.without_repeats(odd).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in found) == sorted((i or 0, n, n - len(kept)) for i, n, _, kept in removed_by_force(ODD))
    assert suffix_dedup.without_repeats(odd.limit(0)).collect() == []
    with pytest.raises(TypeError):
        suffix_dedup.without_repeats(odd.withColumn("doc_id", F.lit("a")))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=8), max_size=12), max_size=7))
def test_loser_tree_merges_front_coded_runs(groups):
    runs = [sorted((b"\0" + x, x[:2], k, n) for k, x in enumerate(some)) for n, some in enumerate(groups)]
    coded = [suffix_dedup._run([suffix_dedup.encode_front(run[k : k + 3]) for k in range(0, len(run), 3)]) for run in runs]
    out = list(suffix_dedup.merged(coded))
    assert sorted(r for _, _, r in out) == sorted(r for run in runs for r in run)
    keys = [r[0] for _, _, r in out]
    assert keys == sorted(keys)
    assert [same for _, same, _ in out] == [suffix_dedup._common(a, b) for a, b in zip([b"", *keys], keys, strict=False)]


def test_merging_compares_no_known_prefix_again(monkeypatch):
    common, looked = suffix_dedup._common, []
    runs = [sorted((b"\0" + b"p" * 40 + bytes(random.Random(n * 100 + k).choices(b"abc", k=9)), b"", k, n) for k in range(50)) for n in range(8)]
    coded = [([common(run[k - 1][0], r[0]) if k else 0 for k, r in enumerate(run)], run) for run in runs]

    def counted(a, b, n=0):
        looked.append(common(a, b, n) - n)
        return looked[-1] + n

    monkeypatch.setattr(suffix_dedup, "_common", counted)
    out = list(suffix_dedup.merged(coded))
    # Each byte of a string is found equal once at most, however many comparisons the string is in.
    assert sum(looked) <= sum(len(r[0]) for _, _, r in out)
    assert len(looked) > len(out) / 2
