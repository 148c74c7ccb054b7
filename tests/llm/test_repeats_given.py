"""Removed repeats of all documents of sf0.01 against every 400-byte window counted."""

import collections
import hashlib
import os

import numpy as np
import pytest

from scrubline.llm import queries as L

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_windows_of_sf001(spark, n=400):
    data = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    windows = {i: np.array([hash(b[k:k + n]) for k in range(len(b) - n + 1)], np.int64) for i, b in data.items()}
    twice = collections.Counter(np.concatenate(list(windows.values())).tolist())
    want = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for k, h in enumerate(windows[i].tolist()):
            if twice[h] > 1:
                gone[k] += 1
                gone[k + n] -= 1
        gone = np.cumsum(gone)[:len(b)] > 0
        runs = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        want[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in L.op1_suffix_repeats(spark, SF).collect()}
    assert got == want and sum(0 < v[1] < v[0] for v in want.values()) > 20
