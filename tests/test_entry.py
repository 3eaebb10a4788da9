"""The entry module without its optional parts."""

import json
import subprocess
import sys

from workload.queries import all_queries

SCRIPT = """
import importlib.abc, json, sys, warnings

class Hidden(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in sys.argv[2:]:
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Hidden())
sys.path.insert(0, sys.argv[1])
warnings.simplefilter("ignore")
import __spark_entry__ as entry
print(json.dumps([sorted(entry.queries()), sorted(entry.oracle_sql())]))
"""


def listed(root, *hidden):
    out = subprocess.run([sys.executable, "-c", SCRIPT, root, *hidden], capture_output=True, text=True, check=True)
    return json.loads(out.stdout)


def test_core_queries_stay_without_the_optional_parts(pytestconfig):
    core = sorted(all_queries())
    for hidden in (["public_tokenizers"], ["latticemix.llm"], ["latticemix.llm", "corpus_pipeline"]):
        queries, sql = listed(str(pytestconfig.rootpath), *hidden)
        assert queries == core and sql == core
