"""Java sources compiled for tests, where there is a compiler."""

import os
import shutil
import subprocess

import pytest


def compiled(folder, sources, without=()):
    """Compile {path: source} below a folder and leave out the class files of ``without``; the folder of class files."""
    if not shutil.which("javac"):
        pytest.skip("no Java compiler")
    for path, source in sources.items():
        target = folder / "src" / path
        os.makedirs(target.parent, exist_ok=True)
        target.write_text(source)
    out = folder / "classes"
    subprocess.run(["javac", "-parameters", "-nowarn", "-d", str(out), *[str(folder / "src" / p) for p in sources]], check=True, timeout=120, capture_output=True)
    for name in without:
        os.remove(out / f"{name}.class")
    return str(out)
