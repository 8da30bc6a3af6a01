"""What the operators hold in worker processes: the pairs of large nodes, and memos of stages that are over."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallyframe.llm import chosen_path as N, common, packing as K, quality as Q, toxicity as T
from tallyframe.llm.queries import tokenizer_path


def node_of_copies(seed, n, least):
    """The rows of one node, whose signatures agree in ``least`` to 192 of 192 hashes with a common one."""
    rng = np.random.default_rng(seed)
    signature = np.tile(rng.integers(0, 256, 192, dtype=np.uint8), (n, 1))
    for row in signature:
        at = rng.choice(192, int(rng.integers(0, 193 - least)), replace=False)
        row[at] = rng.integers(0, 256, len(at), dtype=np.uint8)
    ids = [f"{i:016d}".encode() for i in rng.permutation(n).tolist()]
    return pa.table({"node": [1] * n, "set_id": pa.array(ids, pa.binary()), "n_shingles": [100] * n, "signature": pa.array([r.tobytes() for r in signature], pa.binary())})


def group_of_spanning_pairs(spark, monkeypatch):
    groups = []
    monkeypatch.setattr(N, "_per_node", lambda members, schema, group: groups.append(group) or members)
    N.spanning_pairs(spark.createDataFrame([], "node long, set_id binary, n_shingles long, signature binary"), N.Join())
    return groups[0]


@pytest.mark.parametrize("held", [100_000, 1])
def test_spanning_pairs_of_a_node_are_its_strongest(spark, monkeypatch, held):
    monkeypatch.setattr(N, "EDGES_A_NODE", held, raising=False)
    rows = node_of_copies(21, 150, 140)
    got = group_of_spanning_pairs(spark, monkeypatch)(rows)
    ids, sig = rows.column("set_id").to_pylist(), [np.frombuffer(b, "u1") for b in rows.column("signature").to_pylist()]
    edges = sorted((-int((sig[x] == sig[y]).sum()), x, y) for y in range(150) for x in range(y))
    similar = [e for e in edges if -e[0] >= 123 and (sig[e[1]][:48] == sig[e[2]][:48]).sum() >= 21]
    top, expected = list(range(150)), set()
    for _, x, y in similar:
        if top[x] != top[y]:
            expected.add((min(ids[x], ids[y]), max(ids[x], ids[y])))
            top = [top[y] if t == top[x] else t for t in top]
    assert 1000 < len(similar) < len(edges) and len(got["a"]) == len(expected) and set(zip(got["a"], got["b"])) == expected


def test_a_node_of_copies_takes_little_memory(spark, monkeypatch):
    """Before, every similar pair was held as Python objects: these 1400 vertices took 144 MB of a worker."""
    group, rows = group_of_spanning_pairs(spark, monkeypatch), node_of_copies(22, 1400, 180)
    tracemalloc.start()
    try:
        got = group(rows)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got["a"]) == 1399 and most < 40e6, most


def test_stages_drop_the_memos_of_others(spark, monkeypatch):
    """Before, what packing had learnt stayed in the workers while the next documents were rated and scored."""
    udfs, dropped = [], []
    monkeypatch.setattr(Q.F, "pandas_udf", lambda kind: lambda f: udfs.append(f) or (lambda *columns: None))
    Q.quality(F.lit("x"))
    T.scored(F.lit("x"), T.Model())
    for f in udfs:
        common.begin_memos("packing", lambda: dropped.append("packing"))
        f(pd.Series(["some words here", None]))
    assert len(udfs) == 2 and dropped == ["packing", "packing"]


def test_what_packing_has_learnt_is_dropped(docs, monkeypatch):
    """Before, a worker dropped the empty copy of the memos that had come with the task, not its own."""
    sent, path = [], tokenizer_path("word_bpe_49k.json")
    monkeypatch.setattr(K, "map_rows", lambda df, schema, rows: sent.append(rows))
    monkeypatch.setattr(K.TaskContext, "get", classmethod(lambda cls: cls()))
    monkeypatch.setattr(K.TaskContext, "partitionId", lambda self: 0)
    K.pieces(docs([]), path, K.Classes(), 2, "doc_id", "text")
    K._CODERS.clear()
    rows = cloudpickle.loads(cloudpickle.dumps(sent[0]))  # as a worker gets it
    for _ in range(2):
        assert [r[:3] for r in rows(iter([(7, "some words"), (8, None)]))][0][:2] == (7, 0)
        assert list(K._CODERS) == [path]
    common.begin_memos("quality")
    assert not K._CODERS
