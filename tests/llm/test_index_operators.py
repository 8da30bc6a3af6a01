"""Cuckoo dedup, bag search and the Merkle manifest against brute force, their odd cases, and the given tables."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import bag_search, cuckoo, merkle
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.001"


# ---- exact duplicates


def sha(text) -> bytes:
    return hashlib.sha256(text if isinstance(text, bytes) else str(text).encode()).digest()


def test_filter_grows_from_keys_and_forgets():
    shard, digests = cuckoo.Shard(), [sha(i) for i in range(5000)]
    assert all(shard.add(d, d, 1, 1) for d in digests) and shard.resized > 3
    assert not any(shard.add(d, d, 2, 1) for d in digests)
    assert all(e[2:] == [2, 2] for e in shard.entries())
    assert all(shard.remove(d, d) for d in digests[::2]) and not any(shard.remove(d, d) for d in digests[::2])
    assert all(map(shard.filter.holds, digests[1::2]))
    assert {e[0] for e in shard.entries()} == set(digests[1::2])
    assert sum(shard.filter.holds(sha(-i)) for i in range(1, 10_000)) < 30  # 16-bit marks


def groups_of(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_dedup_equals_grouping(docs, weak):
    rng = random.Random(5)
    rows = ODD + [(100 + i, rng.choice(["a", "b", None, "", "A", "a ", "long " * 400, str(rng.randrange(40))])) for i in range(600)]
    digest = (lambda t: F.unhex(F.sha2((F.length(t) % 3).cast("string").cast("binary"), 256))) if weak else cuckoo.digest_of
    found = cuckoo.dedup(docs(rows), digest=digest)
    assert sorted((tuple(r)[:4] for r in found.collect()), key=str) == groups_of(rows)


def test_dedup_digests_and_empty_table(docs):
    got = {r["id"]: bytes(r["digest"]) for r in cuckoo.dedup(docs([(1, "é🙂"), (2, None)])).collect()}
    assert got == {1: sha("é🙂"), 2: sha("")}
    assert cuckoo.dedup(docs([])).count() == 0 and cuckoo.build(docs([])).entries.count() == 0


def test_index_inserts_and_deletes(docs):
    first, second = docs([(i, f"text {i % 50}") for i in range(200)]), docs([(i, f"text {i % 80}") for i in range(200, 360)])
    index = cuckoo.build(first).insert(second)
    whole = {(r["text"].decode(), r["keep"], r["n"]) for r in index.entries.collect()}
    want = defaultdict(list)
    for i, t in [(i, f"text {i % 50}") for i in range(200)] + [(i, f"text {i % 80}") for i in range(200, 360)]:
        want[t].append(i)
    assert whole == {(t, max(ids), len(ids)) for t, ids in want.items()}
    left = index.delete(docs([(0, f"text {i}") for i in range(0, 90, 2)]))
    live = {r["id"]: r["live"] for r in left.live(docs([(i, f"text {i}") for i in range(90)] + [(99, None)])).collect()}
    assert live == {**{i: i % 2 == 1 and i < 80 for i in range(90)}, 99: False}
    assert all(f["buckets"] * 8 == len(f["slots"]) for f in left.filters.collect())


# ---- bag search


def brute_search(rows, items, k):
    cut = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(i, Counter(cut(t))) for i, t in rows]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 12 * m)) for w in cut(text) if w in b)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [5, 100_000])
def test_search_equals_brute_force(spark, docs, block, monkeypatch):
    monkeypatch.setattr(bag_search, "HELD", 5000)
    rng = random.Random(9)
    words = ["Ärger", "ärger", "The", "the", "a1", "b", "c", "漢字", "zeta", "eta", "x_y", "don't"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(n))
    rows = ODD + [(100 + i, text(rng.randrange(1, 5))) for i in range(400)] + [(600 + i, "the eta zeta") for i in range(60)]
    items = [(i, text(rng.randrange(1, 6))) for i in range(12)] + [(20, None), (21, ""), (22, "unknownword"), (23, "word word")]
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id int, text string, rank int")
    found = bag_search.search(docs(rows), asked, k=20, block=block)
    assert sorted(map(tuple, found.collect()), key=str) == brute_search(rows, items, 20)


def test_search_without_terms(spark, docs):
    asked = spark.createDataFrame([(1, "word")], "item_id int, text string")
    assert bag_search.search(docs([]), asked).count() == 0
    assert bag_search.search(docs([(1, None), (2, " .,")]), asked).count() == 0
    assert bag_search.search(docs([(1, "word")]), asked.limit(0)).count() == 0


def test_scores_are_exact_beyond_doubles():
    import numpy as np

    best = bag_search.Best(np.array([45_000]), np.array([0, 1]), np.array([0]), np.array([3_000_001]), 1, 20)
    (score,) = best.scores([(100, np.array([0, 1_000_000], np.uint32).tobytes(), [1])])[0].tolist()
    assert score == 45_000 * (10**9 * 10**6 // (1000 * 10**6 + 1200)) * 3_000_001


# ---- Merkle manifest


def h(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(digests):
    """The levels from the leaves to the last node."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_audit(rows, tampered):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = defaultdict(list)
    for r in rows:
        low = None if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
        own = h(*map(frame, r))
        sources[r[1]].append(((r[0] is not None, r[0] or 0), own, h(*map(frame, [*r[:4], low])) if tampered(r[0]) else own, r[0]))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[1] for x in sorted(sources[s])]) for s in order}
    top = brute_tree([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for rank, (_, own, now, id_) in enumerate(sorted(sources[s])):
            proof = ""
            for levels, at in ((trees[s], rank), (top, place)):
                for level in levels[:-1]:
                    run, digit = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += "".join(run[:digit] + run[digit + 1 :])
                    now, at = h(*run[:digit], now, *run[digit + 1 :]), at // 16
            out.append((id_, own, trees[s][-1][0], top[-1][0], h(proof), now, now == top[-1][0]))
    return sorted(out, key=str)


def leaf_rows(rows):
    return [(i, s, "en", None if t is None else len(t), t) for i, s, t in rows]


CASES = {
    "odd": [(i, s, t) for (i, t) in ODD for s in (None, "", "é")],
    "one": [(5, "only", "Text")],
    "hot": [(i, "hot", f"Text {i}") for i in range(300)] + [(1000 + i, f"s{i}", "A") for i in range(20)] + [(7, "hot", "Text 7")],
    "run": [(i, None, "Same") for i in range(17)],
}


@pytest.mark.parametrize("case", CASES)
def test_audit_equals_brute_force(spark, case):
    rows = leaf_rows(CASES[case])
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, rank string, path string").repartition(3)
    found = merkle.audit(frame, F.col("doc_id") % 5 == 0)
    want = brute_audit(rows, lambda i: i is not None and i % 5 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert any(not r[-1] for r in want) or case != "hot"


def test_proofs_of_some_leaves_and_empty_table(spark):
    rows = leaf_rows(CASES["hot"])
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    manifest = merkle.build(frame, frame.select("source", F.col("doc_id").alias("id"), merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("leaf")))
    asked = manifest.leaves.where("id IN (3, 299, 1004)")
    shown = merkle.proofs(manifest, asked).withColumn("root", merkle.folded(F.col("leaf"), F.col("path")))
    root = manifest.root().first()["digest"]
    assert sorted((r["id"], r["known"] == r["leaf"], r["root"] == root) for r in shown.collect()) == [(3, True, True), (299, True, True), (1004, True, True)]
    assert merkle.audit(frame.limit(0), F.lit(True)).count() == 0


# ---- the given tables


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", ["op11_cuckoo_dedup", "op12_bag_search", "op13_merkle_manifest"])
def test_given_tables_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tallyframe.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(result.fetchall(), key=str)


# ---- the verdict of the compression bands


def brute_verdict(text, bands):
    """The method in other words: numpy interpolation over the logarithm of the length, chunks by slices."""
    import numpy as np
    import zstandard

    pack = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))
    lengths, lows, highs = (np.array(x, float) for x in zip(*bands.limits))
    side = lambda b: np.sign((pack(b) > np.interp(np.log(len(b)), np.log(lengths), highs)) * 1.0 - (pack(b) < np.interp(np.log(len(b)), np.log(lengths), lows)))
    data = (text or "").encode()
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return "base"
    if len(data) < 256:
        return "kept"
    if side(data):
        return "repetitive" if side(data) > 0 else "incompressible"
    chunks = [c for c in (data[s : s + 2048] for s in range(0, len(data), 2048)) if len(c) >= 256]
    return "bad chunks" if sum(side(c) != 0 for c in chunks) > 0.5 * len(chunks) else "kept"


def test_verdicts_equal_brute_force_and_all_occur(spark):
    pytest.importorskip("zstandard")
    import base64

    from tallyframe.llm.quality import Bands, with_quality

    rng = random.Random(4)
    plain = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] if os.path.isdir(FOLDER) else []
    noise = lambda n: " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(n))
    few = lambda n, words: " ".join(rng.choice(words) for _ in range(n))
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    halves = " ".join(f"{few(150, vocabulary[:60])} {noise(80)}" for _ in range(3))
    rows = [*plain, None, "", noise(60), noise(900), few(700, vocabulary[:40]), few(900, vocabulary), halves, few(55, ["a", "b", "cc", "d"])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    rated, name = with_quality(df)
    got = {r["doc_id"]: r["verdict"] for r in rated.select("doc_id", f"{name}.verdict").collect()}
    assert got == {i: brute_verdict(t, Bands()) for i, t in enumerate(rows)}
    assert {"base", "kept", "repetitive", "incompressible"} <= set(got.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_bands_reject_bad_held_out_rows_and_leave_good_ones(spark):
    from tallyframe.llm.quality import with_quality
    from tallyframe.llm.toxicity import held_out

    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    rated, name = with_quality(read("documents").where(held_out(F.col("doc_id"))))
    marks = read("labels").select("doc_id", F.col("quality").alias("good"))
    seen = rated.join(marks, "doc_id").where(f"NOT {name}.base_failed AND length(text) >= 1024").groupBy("good").agg(F.count("*").alias("n"), F.count_if(~F.col(f"{name}.kept")).alias("gone")).collect()
    found = {r["good"]: (r["gone"], r["n"]) for r in seen}
    assert found[1][0] <= 0.02 * found[1][1]
    assert found[0][0] >= 0.6 * found[0][1]
