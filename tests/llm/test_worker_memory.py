"""What Python workers hold, and how many of them a stage needs."""

import subprocess
import sys

import numpy as np

from sparkweft.llm import simhash


def test_class_table_takes_little_memory():
    code = """
import resource
import numpy, tokenizers
from sparkweft.llm import pretoken
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
table = pretoken.classes()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, *(int(table[ord(c)]) for c in "aé1 ²!\\u3000\\U00010400\\U0010ffff"))
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert got[1:] == ["1", "1", "2", "3", "2", "0", "3", "1", "0"]
    assert int(got[0]) < 50  # 209 MB when the library was asked for all code points at once


def _python_below(node, found):
    """Python steps between this node of a logical plan and the nearest shuffle or table."""
    if node.nodeName() == "MapInArrow":
        found += 1
    elif "Repartition" in node.nodeName() or node.nodeName() == "Aggregate":
        for c in _children(node):
            yield from _python_below(c, 0)
        return
    yield found
    for c in _children(node):
        yield from _python_below(c, found)


def _children(node):
    return [node.children().apply(i) for i in range(node.children().size())]


def test_no_stage_of_block_links_runs_two_python_steps(spark):
    prints = [np.uint64(x).byteswap().tobytes() for x in (0, 3, 7, 1 << 63, (1 << 64) - 1)]
    rows = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(prints)], "n bigint, fp binary")
    out = simhash.links(rows, 4, 2)
    assert max(_python_below(out._jdf.queryExecution().optimizedPlan(), 0)) == 1
    got = {frozenset((r.a, r.b)) for r in out.collect()}
    assert {frozenset((0, 1)), frozenset((1, 2)), frozenset((0, 3))} <= got and not any(4 in x for x in got)
