"""Every text query by itself: a fresh driver, a fresh JVM, and workers that have run nothing before."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from tests.conftest import ROOT, SF
from wavestack.llm.queries import QUERIES

RUN = """
import sys
import __spark_entry__ as entry
from wavestack.session import session
spark = session("local[2]", "fresh", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g")
spark.sparkContext.setLogLevel("OFF")
print("ROWS", entry.queries()[sys.argv[1]](spark, sys.argv[2]).count())
"""


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_runs_alone(name):
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", RUN, name, SF], cwd=ROOT, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS " in done.stdout and int(done.stdout.split("ROWS ")[1].split()[0]) > 0, done.stderr[-2000:]
