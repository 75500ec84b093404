"""What a worker process keeps from one task to the next."""

import subprocess
import sys

import pyarrow as pa

from helixframe.llm import common

_CODE = """
import re
import pyarrow as pa
from helixframe.llm import common

def mb():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

pa.array(["x"]).to_pylist()  # imports what Arrow needs for that
list(common.slices(iter([])))
before = mb()
kept = []
for i in range(40):
    text = pa.array(["x" * 5000] * 1000)
    kept.append(pa.array(["y"] * 10))
    kept.append(text.to_pylist()[:1])
del text, kept
left = mb() - before
list(common.slices(iter([])))
print(left, mb() - before)
"""


def test_a_task_drops_what_the_last_one_did_not_ask_for():
    batch = pa.RecordBatch.from_pydict({"a": list(range(1200))})
    made = []
    ask = lambda: common.held("of this test", lambda: made.append(1) or made)
    ask()
    assert [b.num_rows for b in common.slices(iter([batch]))] == [500, 500, 200]
    ask()
    assert len(made) == 1  # a task that follows finds it
    assert [b.num_rows for b in common.slices(iter([batch]), common.WHOLE)] == [1200]
    list(common.slices(iter([batch])))
    ask()
    assert len(made) == 2  # a task passed that had no use for it


def test_a_task_begins_without_the_memory_of_the_last():
    left, then = map(float, subprocess.run([sys.executable, "-c", _CODE], capture_output=True, text=True, check=True).stdout.split())
    assert then < 3, (left, then)
