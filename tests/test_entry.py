"""The entry module must import wherever the tables and the package are."""

from __future__ import annotations

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_needs_no_file_of_the_installed_libraries():
    code = """
import glob, zipfile
import pyspark.sql, duckdb
def refuse(*a, **k):
    raise AssertionError(f"read at import: {a}")
zipfile.ZipFile, glob.glob = refuse, refuse
import __spark_entry__ as e
assert len(e.queries()) >= 66 and len(e.oracle_sql()) >= 63
"""
    run = subprocess.run(
        [sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120
    )
    assert run.returncode == 0, run.stderr


def test_stop_words_are_the_ones_spark_ships(spark):
    from pyspark.ml.feature import StopWordsRemover

    from textmatch.functions.stopwords import ENGLISH

    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")
