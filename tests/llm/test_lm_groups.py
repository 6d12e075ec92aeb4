"""Counts over several groups of chunks, and how a text is dealt to them."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa

from quillgraph.llm import lm_scoring as lm

RUN = """
import sys
import pyarrow as pa
from quillgraph.llm import lm_scoring as lm
blocks, known = (pa.ipc.open_stream(name).read_all() for name in sys.argv[1:])
assert not hasattr(pa, "compute")  # a worker has it only once something else has loaded it
done = lm._filled(blocks, known)
(made,) = done.to_pylist()
assert list(lm._widened(made["word_counts"], 2)) == [30, 40] and list(lm._widened(made["pair_counts"], 2)) == [7, 8]
"""


def test_counts_of_all_groups_are_filled_in_a_fresh_worker(tmp_path):
    keys, one = np.array([3, 9], np.int64), np.ones(2, np.int64)
    blocks = pa.Table.from_arrays(*lm._rows(lm.BLOCKS, [(5, "0-0", False, 2, 2, lm._steps(keys), lm._steps(keys), lm._narrow(one), lm._narrow(one), b"")]))
    known = pa.table({"bucket": [5] * 4, "pair": [False, False, True, True], "h": [9, 3, 3, 9], "n": [40, 30, 7, 8], "gone": [0, 0, 0, 0]})
    for name, table in (("blocks", blocks), ("known", known)):
        with pa.ipc.new_stream(str(tmp_path / name), table.schema) as out:
            out.write_table(table)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path / "blocks"), str(tmp_path / "known")], cwd=root, capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr[-600:]


def test_a_bucket_grows_to_its_bound_before_chunks_are_dealt_to_groups():
    for size in (0, 10**6, 10**9, 10**10, 10**11, 10**12):
        buckets, groups = lm._dealt_to(size)
        assert 8 <= buckets <= lm.BUCKETS and size / 6 / (buckets * groups) <= lm.MOST_PER_BUCKET
    assert lm._dealt_to(864_000_000) == (144, 1)
    assert lm._dealt_to(10_400_000_000)[1] == 1  # a second round of sums and joins there took most of the disk
