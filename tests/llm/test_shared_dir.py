import os
import subprocess
import sys

from tests.conftest import ROOT

RUN = """
from tidewater.session import local
from tidewater.llm.common import cut, shared_dir
s = local("2", 2)
assert s.conf.get("spark.checkpoint.dir", None) is None
assert cut(s.range(5), "five").count() == 5 and shared_dir(s) == shared_dir(s)
assert s.conf.get("spark.checkpoint.dir", None) is None
"""


def test_a_session_without_any_settings(tmp_path):
    """No core setting is changed, and a local master finds a folder of its own."""
    subprocess.run([sys.executable, "-c", RUN], cwd=ROOT, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, check=True, timeout=120)
