"""What a Python worker takes while it compares clusters, counts, and between tasks."""

import pickle
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import dumps

from tonewright.llm import dac, jaccard


def near_copies(n: int, size: int):
    """Sets that share all but a few of their elements, as one large group of near copies."""
    rng = np.random.default_rng(4)
    value = np.sort(np.concatenate([np.tile(np.arange(1, size - 9, dtype=np.uint64), (n, 1)), rng.integers(1 << 40, 1 << 60, (n, 10)).astype(np.uint64)], 1), 1)
    return np.repeat(np.arange(n), size), value.ravel(), np.full(n, size)


def test_links_of_two_blocks_are_bounded():
    n = 2 * jaccard.BLOCK
    doc, value, size = near_copies(n, 100)
    tracemalloc.start()
    root, found = jaccard.links(doc, value, size, np.ones(n, np.int64), np.zeros(n, np.int64), False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6
    assert (root == 0).all() and (found == n - 1).all()


def test_links_at_the_threshold_are_exact():
    """80 of 100 elements shared links, 79 of 101 doesn't."""
    a, b, c = np.arange(1, 91), np.arange(11, 101), np.concatenate([np.arange(1, 80), np.arange(200, 211)])
    doc = np.repeat([0, 1, 2], [len(a), len(b), len(c)])
    root, found = jaccard.links(doc, np.concatenate([a, b, c]).astype(np.uint64), np.bincount(doc), np.ones(3, np.int64), np.zeros(3, np.int64), False)
    assert root.tolist() == [0, 0, 2] and found.tolist() == [1, 1, 0]


def test_a_worker_keeps_few_pretokens_between_tasks():
    import public_tokenizers

    encoder = dac.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = pa.array([" ".join(f"w{k}" for k in range(3000))])
    want = encoder(texts)[0].tolist()
    encoder.rest()
    assert 0 < encoder.n <= encoder.IDLE
    encoder.IDLE = encoder.n - 1
    encoder.rest()
    assert encoder.n == 0 and encoder(texts)[0].tolist() == want


def test_tasks_of_a_worker_share_one_encoder(spark, monkeypatch, tmp_path):
    """Each task gets a copy of its function, and of what that function's globals hold."""
    import public_tokenizers

    sent, built, begin = [], [], dac.PieceEncoder.__init__
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: sent.append(dumps(f)) or self)
    monkeypatch.setattr(dac.TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(dac.PieceEncoder, "__init__", lambda self, path: built.append(path) or begin(self, path))
    dac.write(docs, str(tmp_path / "ids"), public_tokenizers.path("byte_bpe_50k.json"))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": pa.array(["one two", None])})
    blocks = [next(pickle.loads(sent[0])(iter([batch]))) for _ in range(3)]
    assert len(built) <= 1
    assert blocks[0].equals(blocks[1]) and blocks[0].equals(blocks[2])
    assert len(dac.Reader(blocks[0]["payload"][0].as_py())) == sum(blocks[0]["counts"][0].as_py())
