"""Makes the package importable where tasks run."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends the package's code to the executors, once a session; a no-op where their search path already has it."""
    root = str(_PACKAGE.parent)
    places = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if os.path.realpath(root) in places or os.path.realpath(os.getcwd()) == os.path.realpath(root):
        return
    context = spark.sparkContext
    if getattr(context, "_seqweave_shipped", False):
        return
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    target = Path(tempfile.mkdtemp(prefix="seqweave-code-")) / "seqweave.zip"
    target.write_bytes(blob.getvalue())
    context.addPyFile(str(target))
    context._seqweave_shipped = True
