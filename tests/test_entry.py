import shutil
import subprocess
import sys

ROOT = __file__.rsplit("/tests/", 1)[0]


def listed(folder):
    code = "import __spark_entry__ as e; print(sum(k.startswith('op') and k[2].isdigit() for k in e.queries()), len(e.queries()), len(set(e.oracle_sql()) - set(e.queries())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout
    return tuple(map(int, out.split()))


def test_entry_lists_the_rest_without_the_optional_folders(tmp_path):
    own = tmp_path / "repo"
    own.mkdir()
    shutil.copy(f"{ROOT}/__spark_entry__.py", own)
    shutil.copytree(f"{ROOT}/actweave", own / "actweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    gone = listed(own)
    assert gone[0] == 0 and gone[1] > 60 and gone[2] == 0
    (own / "actweave" / "llm" / "__pycache__").mkdir(parents=True)
    assert listed(own) == gone
