"""What runs in tasks must work on executors that have no copy of the package."""

import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle

from pricetrail.llm.arrays import _trim, once
from pricetrail.llm.lattice_lm import _vocabulary, lattice
from pricetrail.llm.pieces import _worker_state, encode
from pricetrail.llm.repair import _lines
from pricetrail.llm.simhash import bucket_keys
from pricetrail.llm.substrings import grams
from pricetrail.llm.token_counts import _encoder

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
TEXT = np.frombuffer(b"two words", dtype=np.uint8), np.array([0, 9])

CALLS = {
    "trim": lambda: _trim()(0) is not None,
    "golay": lambda: len(bucket_keys(np.array([5], dtype=np.uint64))[0]),
    "pieces": lambda: len(encode(*TEXT, *_worker_state(PIECES))[0]),
    "tokens": lambda: int(_encoder(BYTES).counts_of(*TEXT, 1000)[0]),
    "lattice": lambda: len(lattice(np.frombuffer(b"word", dtype=np.uint8), np.array([0, 4]), _vocabulary(PIECES)).nodes),
    "windows": lambda: len(grams(np.arange(60, dtype=np.uint64), 50)),
    "edits": lambda: _lines(0, 0 * 4 + 1, "system", "x.")[0],
}


@pytest.mark.parametrize("name", CALLS)
def test_functions_travel_by_value(tmp_path, name):
    wanted = CALLS[name]()
    assert once("told", lambda: "kept") == "kept"
    path = tmp_path / "call"
    path.write_bytes(cloudpickle.dumps(CALLS[name]))
    assert path.stat().st_size < 1_000_000  # what a process keeps doesn't go along
    code = (
        "import pickle, sys\n"
        "call = pickle.load(open(sys.argv[1], 'rb'))\n"
        "print(repr(call()), repr(call()), 'pricetrail' in sys.modules)"
    )
    said = subprocess.run([sys.executable, "-c", code, str(path)], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [repr(wanted), repr(wanted), "False"], said.stderr[-2000:]
