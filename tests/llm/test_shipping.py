"""What runs on executors travels by value: it loads where the package is not installed."""

import os
import subprocess
import sys

import pytest
from harvestlens.llm import byte_cnn, caps, chat, dom_model, mixing, passages, secrets, simhash, spelling, tiling, token_align
from pyspark import cloudpickle

SENT = [
    simhash._fingerprints, simhash._keyed, simhash._bucket_links, caps._listed, caps._compared, passages._paragraphs, passages._shingle_sets, passages._similar, passages._marks,
    passages._around, passages._extended, passages._cut_rows, tiling._seeds, tiling._tiled, chat._formatted, chat._read_back, byte_cnn.Scorer, mixing._member, mixing.rates_of, dom_model.main_text, secrets._found, spelling._cells, spelling._near, token_align._encoded, token_align._scored,
]


@pytest.mark.parametrize("sent", SENT, ids=lambda f: f"{f.__module__.rpartition('.')[2]}.{f.__name__}")
def test_loads_without_the_package(sent, tmp_path):
    held = tmp_path / "sent"
    held.write_bytes(cloudpickle.dumps(sent))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import pickle, sys; assert callable(pickle.load(open(sys.argv[1], 'rb'))); assert not [m for m in sys.modules if m.startswith('harvestlens') and getattr(sys.modules[m], '__spec__', None)]"
    subprocess.run([sys.executable, "-c", code, str(held)], cwd=tmp_path, env=env, check=True, capture_output=True)
