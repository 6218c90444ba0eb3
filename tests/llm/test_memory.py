"""What Python workers keep between batches and stages."""

import re
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from pactframe.llm import common


def anonymous_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_freed_memory_goes_back():
    held = [bytes([i % 256]) * 100_000 for i in range(2000)]
    last = held[-1] + b"y"  # above the others, so that the heap can't shrink by itself
    held = None
    before = anonymous_mb()
    common.release()
    assert before - anonymous_mb() > 100 and len(last) == 100_001


def test_every_batch_is_followed_by_a_release(spark, monkeypatch):
    docs = spark.createDataFrame([], "text string")
    runs, times = [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run))
    common.extend(docs, "text", lambda texts: [{"n": len(t)} for t in texts], "n long", "m")
    common.map_rows(docs, lambda parts: ({"n": [len(t) for t in p["text"]]} for p in parts), "n long")
    monkeypatch.setattr(common, "release", lambda: times.append(1))
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(x, pa.string())}) for x in (["a"] * 300, [], ["b"])]
    for run in runs:
        times.clear()
        assert sum(b.num_rows for b in run(iter(batches))) == 301
        assert len(times) == 3
