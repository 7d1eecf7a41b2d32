"""Functions travel to workers with their code: executors need no installed copy of the package."""

import pkgutil
import subprocess
import sys

from pyspark import cloudpickle

import reviewloom

CHILD = "import sys, pickle; f = pickle.loads(sys.stdin.buffer.read()); assert not any(m.startswith('reviewloom') for m in sys.modules), 'imported'; print(len(f))"


def test_every_function_travels_by_value(tmp_path):
    functions = []
    for found in pkgutil.walk_packages(reviewloom.__path__, "reviewloom."):
        module = __import__(found.name, fromlist=["_"])
        functions += [v for v in vars(module).values() if callable(v) and getattr(v, "__module__", "") == found.name]
    sent = cloudpickle.dumps(functions)
    done = subprocess.run([sys.executable, "-c", CHILD], input=sent, capture_output=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, timeout=300)
    assert done.returncode == 0 and int(done.stdout) == len(functions) > 100, done.stderr.decode()[-2000:]
