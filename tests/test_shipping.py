"""The package as executors get it."""

import subprocess
import sys
import zipfile
from pathlib import Path


def test_every_module_is_found_in_the_archive(tmp_path):
    top = Path(__file__).resolve().parent.parent / "provara"
    path = tmp_path / "provara.zip"
    modules = []
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
            modules.append(".".join(p.relative_to(top.parent).with_suffix("").parts).removesuffix(".__init__"))
    code = f"import sys, importlib.util; sys.path.insert(0, {str(path)!r}); print([m for m in {modules!r} if importlib.util.find_spec(m) is None])"
    # from a folder that has no package of this name beside it
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert told.stdout.strip() == "[]"
