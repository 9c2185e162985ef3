"""What a task holds while it works on batches of long texts."""

import weakref

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tessera.llm import common


class Rows:
    """Stands for a DataFrame, and gives the function that tasks run."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.StructType([T.StructField("text", T.StringType())])), T.StructField("text", T.StringType())])

    def mapInArrow(self, run, schema):
        return run


def batch(texts, first=0):
    ids = pa.array([None if i % 5 == 4 else i for i in range(first, first + len(texts))], pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.StructArray.from_arrays([pa.array(texts, pa.string())], ["text"]), pa.array(texts, pa.string())], ["doc_id", "row", "text"])


def task(chars):
    make = lambda: lambda texts: [(len(t or ""), t) for t in texts]
    return common.per_group(Rows(), make, [("n", T.LongType()), ("same", T.StringType())], ("doc_id", "row"), chars)


@pytest.mark.parametrize("chars", [0, 3, 1 << 20])
def test_results_of_long_texts_are_sent_on_before_their_batch_ends(monkeypatch, chars):
    monkeypatch.setattr(common, "SENT_CHARS", 12)
    texts = ["abcd" + chr(97 + i) for i in range(10)] + [None, "", None]
    batches = [batch(texts), batch([]), batch([None, ""], 50), batch(["x" * 99, "y"], 60)]
    out = list(task(min(chars, 12))(iter(batches)))
    assert [o.num_rows for o in out][:4] == [3, 3, 3, 4]
    rows = [r for o in out for r in o.to_pylist()]
    assert rows == [{"doc_id": r["doc_id"], "row": r["row"], "n": len(r["text"] or ""), "same": r["text"]} for b in batches for r in b.to_pylist()]


def test_a_batch_is_let_go_before_the_next_one_is_read():
    held = []

    def read():
        for i in range(3):
            b = batch(["a", None, "b"], 3 * i)
            seen = weakref.ref(b)
            yield b
            del b
            held.append(seen() is not None)

    assert sum(o.num_rows for o in task(0)(read())) == 9
    assert held == [False] * 3


def test_words_that_are_met_after_the_table_is_full_get_the_same_hash():
    few, many = common.WordHash(2), common.WordHash()
    words = [b"a", b"b", b"c", b"a", b"c", b"d"]
    assert few.of(words).tolist() == many.of(words).tolist() and len(few) == 2
