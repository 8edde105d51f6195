"""Python functions take rows in bounded batches and hand results back in bounded pieces."""

import os
import re
import time

import pyarrow as pa
import pytest

from postmill.plans import catalogue

DATA = "/root/testdata/sf0.001"
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST = 4 << 20


@pytest.fixture
def unset(spark):
    """The session without a bound of its own on batches."""
    before = spark.conf.get(KEY, None)
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def bound_of(spark) -> int:
    return int(spark.conf.get(KEY, "67108864").rstrip("b"))


def test_pieces_are_bounded_lazy_and_whole():
    from postmill.functions.rows import PIECE_BYTES, in_pieces

    texts = ["x" * 100_000] * 50 + [None, "", "y" * (3 * PIECE_BYTES)] + ["z"] * 1000
    called = []
    run = in_pieces(lambda x: called.append(x) or (x and x.upper()), pa.string())
    pieces = run(iter([pa.array(texts[:60]), pa.array(texts[60:])]))
    first = next(pieces)
    assert len(called) == len(first) < 15
    rest = list(pieces)
    assert [x for p in (first, *rest) for x in p.to_pylist()] == [x and x.upper() for x in texts]
    assert sorted(p.nbytes for p in (first, *rest))[-2] < 2 * PIECE_BYTES  # all but the long row's
    both = in_pieces(lambda a, b: {"s": a, "n": b}, pa.struct({"s": pa.string(), "n": pa.int64()}))
    assert pa.concat_arrays(both(iter([(pa.array(["a", None]), pa.array([1, None]))]))).to_pylist() == [{"s": "a", "n": 1}, {"s": None, "n": None}]
    assert list(run(iter([pa.array([], pa.string())]))) == []


def test_a_smaller_bound_stays(unset):
    from postmill.functions.rows import bounded_batches

    unset.conf.set(KEY, "1m")
    bounded_batches(unset)
    assert unset.conf.get(KEY) == "1m"


def batches_are_bounded(spark, name):
    catalogue.QUERIES[name](spark, DATA)
    return bound_of(spark) <= MOST


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_batches_of_mail_subject(unset):
    assert batches_are_bounded(unset, "mail_subject_rfc2047")


def test_long_subject(spark, tmp_path):
    import hashlib

    text = "wörd 字 " * 40_000 + "end"
    spark.createDataFrame([(1, text), (2, None), (3, "a" * 60)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    began = time.monotonic()
    found = dict(map(tuple, catalogue.QUERIES["mail_subject_rfc2047"](spark, str(tmp_path)).collect()))
    assert found == {k: hashlib.md5(v.encode()).hexdigest() for k, v in ((1, text), (2, ""), (3, "a" * 60))}
    assert time.monotonic() - began < 30


def goes_by_row(spark, name):
    """Whether all Python functions of a query's plan hand results back in pieces."""
    from pyspark.util import PythonEvalType

    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    return set(re.findall(r"ArrowEvalPython .*\], (\d+)", plan)) == {str(PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_markdown_links_go_by_row(unset):
    assert batches_are_bounded(unset, "html_markdown_links") and goes_by_row(unset, "html_markdown_links")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_tag_inventory_goes_by_row(unset):
    assert batches_are_bounded(unset, "html_tag_inventory") and goes_by_row(unset, "html_tag_inventory")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_convert_messages_goes_by_row(unset):
    assert batches_are_bounded(unset, "convert_messages") and goes_by_row(unset, "convert_messages")
